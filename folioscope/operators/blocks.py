"""Lines of documents as blocks: segmentation, fields and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import names
from folioscope.functions.text import _c, bind, distinct_filled


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of each document, line numbers from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def segment(rows: DataFrame, key: str, header: Column, line_no: str = "line_no") -> DataFrame:
    """rows with `block`: how many header lines of the document have come, so a header owns the lines up to the next; 0 before the first."""
    w = W.partitionBy(key).orderBy(line_no).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(F.coalesce(header, F.lit(False)).cast("long")).over(w))


def fields(rows: DataFrame, key: str) -> DataFrame:
    """(key, block, line_no, field, value) of the lines of blocks.

    A labelled line gives its value; a label without one takes the next line that is not blank, no
    image and no label itself; other lines have a null field and their clean text.
    """
    return _fields(rows, key, F.lit(False)).select(key, "block", "line_no", "field", "value").filter("value <> ''")


def _fields(rows: DataFrame, key: str, kept: Column) -> DataFrame:
    """The rows of fields() with their other columns, those of an empty value too, and the rows to be kept whatever they hold."""
    at = W.partitionBy(key, "block").orderBy("line_no")
    full = rows.filter(kept | (F.btrim("line", F.lit(names.WHITE)) != ""))
    head = F.regexp_extract(F.trim("line"), r"^#{1,6}\s+(.+?)\s*$", 1)
    parsed = full.withColumn("f", names.field_line("line")).withColumn("h", F.when(head != "", names.field_key(head))).withColumn("is_head", head != "")
    waits = F.when(F.col("is_head"), F.col("h")).when(F.col("f").isNotNull() & (F.col("f.value") == ""), F.col("f.key"))
    pending = F.lag(waits).over(at)
    plain = parsed.withColumn("pending", pending).filter(~F.col("is_head"))
    takes = F.col("pending").isNotNull() & ~F.col("line").startswith("!")
    field = F.when(F.col("f").isNotNull(), F.col("f.key")).when(takes, F.col("pending"))
    value = F.when(F.col("f").isNotNull(), F.col("f.value")).otherwise(names.clean_value("line"))
    return plain.withColumn("field", field).withColumn("value", value)


def _named_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, c) of the documents that name a product; c is the candidate of a line that does, whose text is left out.

    Candidates are looked for before lines become rows, so that only these documents are dealt anew.
    """
    def named(all_lines: Column) -> Column:
        found = F.transform(all_lines, names.candidate)
        rows = lambda cs: F.zip_with(all_lines, cs, lambda line, c: F.struct(F.when(c.isNull(), line).otherwise("").alias("line"), c.alias("c")))
        return bind(found, lambda cs: F.when(F.exists(cs, lambda c: c.isNotNull()), rows(cs)))

    of = docs.select(key, F.posexplode(bind(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), named)).alias("line_no", "l"))
    return of.select(key, "line_no", "l.line", "l.c")


def products(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str]], most: int = 600) -> DataFrame:
    """One row per product that a document names: name, publisher, candidates, platforms, links, highlights, differences, critique, description.

    A description is a summary of `most` characters, as the importer that takes it expects; all else is whole.
    A line that names a product stays among the lines of its block, so that texts are read and dealt once.
    """
    names_one = F.col("c").isNotNull()
    found = _fields(segment(_named_lines(docs, key, text), key, names_one).filter("block > 0"), key, names_one)

    def values(hit: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(hit & (F.col("value") != ""), F.struct("line_no", "value")))), lambda s: s["value"])

    urls = F.flatten(F.transform(values(F.col("value").contains("http")), lambda v: F.regexp_extract_all(v, F.lit(r"https?://[^\s)]+"), F.lit(0))))
    prose = values(F.col("field").isNull() & ~F.col("value").rlike("^(!|http)") & ~names.is_heading("value"))
    row = found.groupBy(key, "block").agg(F.max("c").alias("c"), *[values(F.col("field") == f).alias(f) for f in names.FIELDS if f != "links"], urls.alias("links"), prose.alias("prose"))
    none = F.array().cast("array<string>")
    inline = F.col("c.publisher")
    named = F.when(inline.isNotNull(), F.array(F.coalesce(names.detect(inline, rules), inline))).otherwise(none)
    listed = F.flatten(F.transform("publishers", lambda v: names.publishers_of(v, rules)))
    told = F.concat_ws("\n", "prose", "description")
    direct = F.array_distinct(F.concat(named, listed))
    guessed = names.detect(told, rules)
    every = bind(direct, lambda d: F.when(F.size(d) > 0, d).otherwise(bind(guessed, lambda g: F.when(g.isNotNull(), F.array(g)).otherwise(none))))
    about = F.when(F.size("description") > 0, F.col("description")).otherwise(F.col("prose"))
    return row.withColumn("candidates", every).select(
        key, "block", "c.name", names.resolve(F.col("candidates")).alias("publisher"), "candidates",
        F.array_distinct(F.flatten(F.transform("platforms", names.split_values))).alias("platforms"), F.array_distinct("links").alias("links"),
        "highlights", "differences", "critique", F.trim(F.left(F.array_join(about, " "), F.lit(most))).alias("description"),
    )


def records(rows: DataFrame, key: str, label: Column, value: Column, starts: str, wanted: list[str]) -> DataFrame:
    """One row per record of labelled lines: a line of the label `starts` begins one, the last value of each label counts."""
    marked = segment(rows.withColumn("label", label).withColumn("value", value), key, F.col("label") == starts).filter("block > 0")
    return marked.groupBy(key, "block").agg(*[F.max_by(F.when(F.col("label") == w, F.col("value")), F.when(F.col("label") == w, F.col("line_no"))).alias(w) for w in wanted])


def frontmatter(text: Column | str, key: str) -> Column:
    """A scalar of the leading --- block, without quotes; null if it is missing."""
    block = F.regexp_extract(_c(text), r"(?s)^﻿?---\r?\n(.*?)\r?\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.nullif(F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def merge_sources(rows: DataFrame, keys: list[str], seq: str, arrays: list[str], text: str) -> DataFrame:
    """One row per key: arrays as ordered unions, the first filled text."""
    def union(c: str) -> Column:
        held = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))))
        return distinct_filled(F.flatten(F.transform(held, lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))))

    filled = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text))
    return rows.groupBy(*keys).agg(*[union(c).alias(c) for c in arrays], F.min_by(filled, F.when(filled.isNotNull(), F.col(seq))).alias(text))
