"""Products of articles by two extractors: labelled blocks and lines of a name and its publisher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators import blocks, publishing

#: Labels of a block, the first of which begins it, with the fields they give (fixed values).
LABELS = {"游戏名字": "name", "游戏公司": "publisher", "游戏类型": "type", "上线国家和地区": "regions", "平台": "platform"}
#: A line of a name, a gap of three and a publisher, both of which begin with a letter, and how lines begin that are none (fixed values).
INLINE = r"^(?:\d+\.)?([A-Za-z一-鿿][^\t\n]{1,70}?)[ \t ]{3,}([A-Za-z一-鿿][^\n\t]{1,100})\s*$"
NO_HEADER = ("![", "http", "#", "---", ">", "-", "*", "|")
#: Folders of accounts that nobody knows begin so (fixed value).
UNKNOWN_ACCOUNT = "未知公众号"


def body_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of each document's lines, trimmed, behind its leading block if that ends within 20 lines."""
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = blocks.lines(docs, key, text).select(key, "line_no", line.alias("line"))
    ends = rows.filter("line_no BETWEEN 0 AND 19 AND line = '---'").groupBy(key).agg(F.min("line_no").alias("first"), F.min(F.when(F.col("line_no") > 0, F.col("line_no"))).alias("end")).filter("first = 0 AND end IS NOT NULL").select(key, "end")
    return rows.join(ends, key, "left").filter("end IS NULL OR line_no > end").drop("end")


def structured(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, name, publisher, type, regions, platform): a label of a name begins a product, the last value of each other label counts."""
    label = F.regexp_extract("line", rf"^({'|'.join(LABELS)})[：:]", 1)
    value = F.trim(F.regexp_extract("line", rf"^(?:{'|'.join(LABELS)})[：:]\s*(.+)$", 1))
    told = F.when(value != "", F.nullif(label, F.lit("")))
    rows = blocks.records(lines, key, told, value, next(iter(LABELS)), list(LABELS))
    return rows.select(key, "block", *[F.col(f"`{label}`").alias(name) for label, name in LABELS.items()])


def inline(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, name, publisher, google_play, package_id, app_store, hints): a line of a name and a publisher owns the lines up to the next one."""
    head = F.regexp_extract("line", INLINE, 1)
    is_head = (head != "") & ~F.array_contains(F.array(*[F.col("line").startswith(s) for s in NO_HEADER]), True)
    cut = blocks.segment(lines, key, is_head).filter("block > 0").withColumn("head", is_head)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda s: s["line"]), "\n")
    rows = cut.groupBy(key, "block").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("line"), said.alias("said"))
    links = publishing.store_links("said")
    return rows.select(key, "block", F.trim(F.regexp_extract("line", INLINE, 1)).alias("name"), F.trim(F.regexp_extract("line", INLINE, 2)).alias("publisher"), *[links[c].alias(c) for c in ("google_play", "package_id", "app_store")], publishing.hints("said").alias("hints"))


def products(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The union of both extractors, one row per product, structured ones first: source, nth, and the fields of both.

    A name that a labelled block of the document has is no product of its own where it stands inline:
    its store links are the block's, of several the last that has one.
    """
    lines = body_lines(docs, key, text)
    named, other = structured(lines, key).filter("name IS NOT NULL"), inline(lines, key)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    links = other.groupBy(key, "name").agg(*[last(c) for c in ("google_play", "package_id", "app_store")])
    first = named.join(links, [key, "name"], "left").withColumn("source", F.lit("structured"))
    second = other.join(named.select(key, "name").distinct(), [key, "name"], "left_anti").withColumn("source", F.lit("inline"))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.select(key, "source", F.col("block").alias("nth"), "name", "publisher", "type", "regions", "platform", "google_play", "package_id", "app_store", "hints")


def of_known_account(path: Column | str) -> Column:
    """Whether an article's folder is one of an account that is known, for folders of one level: root/folder/index.md."""
    return ~F.element_at(F.split(path, "/"), -2).startswith(UNKNOWN_ACCOUNT)
