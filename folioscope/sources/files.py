"""Readers of exports, JSON lines and embeddings, and writers with a staged commit."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioscope.operators.blocks import frontmatter
from folioscope.operators.extractors import of_known_account
from folioscope.session import cut_lineage


def read_articles(spark: SparkSession, root: str, name: str = "index.md") -> DataFrame:
    """(path, modified, text) of every article file below root; hidden folders and image folders are left out, nothing is capped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    rows = files.select(F.url_decode("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.filter(~F.col("path").rlike(r"/(\.[^/]+|images)/"))


def read_articles_one_level(spark: SparkSession, root: str, name: str = "index.md") -> DataFrame:
    """(path, modified, text) of the article files in the folders right below root, without those of accounts that nobody knows."""
    files = spark.read.text(f"{root}/*/{name}", wholetext=True)
    rows = files.select(F.url_decode("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.filter(of_known_account(F.col("path")))


def manifest(articles: DataFrame) -> DataFrame:
    """(path, modified, title, account, publish_date, url) of the articles that name a URL, the latest first."""
    parts = F.split("path", "/")
    rows = articles.select("path", "modified", frontmatter("text", "title").alias("title"), F.coalesce(frontmatter("text", "account"), F.element_at(parts, -3)).alias("account"), frontmatter("text", "date").alias("publish_date"), frontmatter("text", "url").alias("url"))
    return rows.filter("url is not null").orderBy(F.desc("modified"), "path")


def read_local(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): articles with a title and a date, and the others with the reason."""
    rows = articles.withColumn("title", frontmatter("text", "title")).withColumn("date", frontmatter("text", "date")).withColumn("url", frontmatter("text", "url"))
    ok = F.col("title").isNotNull() & F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
    bad = rows.filter(~ok).select("path", F.when(F.col("title").isNull(), "no title").otherwise("no date").alias("reason"))
    return rows.filter(ok).drop("text"), bad


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of a fixed schema; strict: a bad line is an error, else it goes."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def first_bad_lines(lines: DataFrame, bad: Column) -> DataFrame:
    """(file, line): the first line of each file for which bad holds, counted from 1, where there is one.

    lines are those of spark.read.text. Each split of a file counts its own lines and finds its own
    first bad one; running sums of the counts over a file's splits give the places. No line is moved.
    """
    own = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min(F.when(bad, F.col("id"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a split
    placed = splits.select("file", (before + F.col("bad") - F.col("first") + 1).alias("line"))
    return placed.filter("line IS NOT NULL").groupBy(F.url_decode("file").alias("file")).agg(F.min("line").alias("line"))


def read_json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines; blank lines and other JSON values go, a line that is no JSON is an error that names file and line.

    Lines are looked through before they are read, in the splits in which they are read: a file of any size is many tasks.
    """
    lines = spark.read.text(path)
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    found = first_bad_lines(lines, bad).orderBy("file").first()
    if found:
        raise ValueError(f"{found.file}:{found.line}: no JSON")
    changed = F.raise_error(F.concat(F.url_decode("_metadata.file_path"), F.lit(": no JSON"))).cast("string")
    checked = lines.select(F.when(bad, changed).otherwise(F.col("value")).alias("line"))
    return checked.filter(F.ltrim("line").startswith("{")).select(F.from_json("line", schema).alias("o")).select("o.*")


def read_json_lines_split(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of a schema, and the lines that are none. The lines are parsed once for both."""
    kept = cut_lineage(spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path))
    return kept.filter("_bad is null").drop("_bad"), kept.filter("_bad is not null").select(F.col("_bad").alias("line"))


def aligned(rows: DataFrame, vectors: DataFrame, pos: str = "pos") -> DataFrame:
    """rows with their vectors by position; a row or a vector alone is an error when the result is read."""
    both = rows.withColumn("__row", F.lit(True)).join(vectors.withColumn("__vector", F.lit(True)), pos, "full")
    whole = F.col("__row").isNotNull() & F.col("__vector").isNotNull()
    return both.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("rows and vectors do not align")).cast("boolean"))).drop("__row", "__vector")


def renumber(rows: DataFrame, order: str, into: str = "pos") -> DataFrame:
    """rows with positions 0, 1, ... by order: ranges are sorted apart and their sizes added up, no single task sees all rows.

    The ranges are written once: two runs of the exchange need not draw the same bounds.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    local = F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("__n", local).join(F.broadcast(starts), "__part").withColumn(into, F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")


def _digest(df: DataFrame) -> tuple:
    """Rows and an order-free hash of a table, combined on the executors. A map is hashed as its JSON."""
    own = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*own)), F.sum(F.pmod(F.xxhash64(F.lit(1), *own), F.lit(1 << 31)))).first())


def write_staged(df: DataFrame, target: str, fmt: str = "parquet", least_rows: int = 0, after: Callable[[str], None] | None = None) -> int:
    """Write to a staging folder, check that its rows are those of df, then put it in the target's place; the number of rows.

    df is computed once. The old folder is kept aside until after(target), such as an index that is
    built anew, has succeeded; if that or the exchange fails, the old folder is put back. Formats
    that do not keep a row as it is (csv, text) are checked by their count alone.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    stage, aside = f"{target}.staged", f"{target}.before"
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    held = cut_lineage(df)
    held.write.mode("overwrite").format(fmt).save(stage)
    staged = spark.read.format(fmt).schema(df.schema).load(stage)
    want, got = _digest(held), _digest(staged)
    n = got[0]
    if n < least_rows or (want != got if fmt in ("parquet", "orc", "json") else want[0] != n):
        fs.delete(path(stage), True)
        raise ValueError(f"{n} rows staged, {want[0]} written, at least {least_rows} wanted")
    fs.delete(path(aside), True)
    had = fs.exists(path(target))
    if had and not fs.rename(path(target), path(aside)):
        raise OSError(f"{target} cannot be set aside")
    try:
        if not fs.rename(path(stage), path(target)):
            raise OSError(f"{target} cannot be replaced")
        if after is not None:
            after(target)
    except BaseException:
        fs.delete(path(target), True)
        if had:
            fs.rename(path(aside), path(target))
        raise
    fs.delete(path(aside), True)
    return n


def rewrite_aligned(rows: DataFrame, keep: Column, target: str, order: str = "pos", after: Callable[[str], None] | None = None) -> int:
    """Rows with their vectors that are kept, numbered anew in order and committed as one table, so that they cannot part."""
    kept = rows.filter(keep)
    return write_staged(renumber(kept.withColumnRenamed(order, "__was"), "__was", order).drop("__was").select(*rows.columns), target, after=after)


def append_aligned(stored: DataFrame, new: DataFrame, target: str, order: str = "pos") -> int:
    """stored and new rows with vectors as one committed table: new ones are numbered on by their own order."""
    last = stored.agg(F.coalesce(F.max(order), F.lit(-1))).first()[0]
    more = renumber(new.withColumnRenamed(order, "__was"), "__was", order).drop("__was").withColumn(order, F.col(order) + last + 1)
    return write_staged(stored.unionByName(more.select(*stored.columns)), target)


def write_table(df: DataFrame, target: str, fmt: str) -> None:
    """CSV with a header, JSON lines or Parquet; nested columns of CSV go as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]) if fmt == "csv" else df
    flat.write.mode("overwrite").format(fmt).option("header", True).option("escape", '"').save(target)


#: Rows and characters of a cell that the format holds (fixed values).
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767


def write_sheet(df: DataFrame, target: str, name: str = "Sheet1") -> int:
    """One spreadsheet file (xlsx) with a header row; the number of rows. Rows come to the driver one by one and are never held together.

    Numbers stay numbers, booleans too; other values are text. More rows than a sheet holds, or a
    text longer than a cell holds, are an error that names the place: nothing is cut. The file is put
    in place only when it is whole. It is one file on the driver's disk, of 1,048,575 rows at most;
    larger tables go through write_table.
    """
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    n = 0

    def cell(value, kind: str) -> str:
        if value is None:
            return "<c/>"
        if kind == "boolean":
            return f'<c t="b"><v>{int(value)}</v></c>'
        if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") and str(value) not in ("nan", "inf", "-inf"):
            return f"<c><v>{value}</v></c>"
        plain = re.sub(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", str(value))
        if len(plain) > CELL_CHARS:
            raise ValueError(f"row {n}: a cell holds {CELL_CHARS} characters, not {len(plain)}")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fixed = {
        "[Content_Types].xml": f'<Types xmlns="{parts}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{parts}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{parts}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    fresh = f"{target}.staged"
    try:
        with zipfile.ZipFile(fresh, "w", zipfile.ZIP_DEFLATED) as book:
            for path, body in fixed.items():
                book.writestr(path, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData><row>{"".join(cell(c, "string") for c in df.columns)}</row>'.encode())
                for row in df.toLocalIterator():
                    n += 1
                    if n >= SHEET_ROWS:
                        raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
                    sheet.write(f"<row>{''.join(map(cell, row, kinds))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")
        os.replace(fresh, target)
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)
    return n
