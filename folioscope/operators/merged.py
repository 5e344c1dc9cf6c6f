"""Tables of keyed rows that are merged bucket by bucket, not rewritten."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import blocks, records
from folioscope.session import cut_lineage

#: Buckets of a new table, and the file that keeps their number and key.
BUCKETS, ABOUT = 256, "_buckets.json"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _about(spark: SparkSession, target: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{ABOUT}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    raw = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(raw, "UTF-8"))
    finally:
        raw.close()


def _tell(spark: SparkSession, target: str, about: dict) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{ABOUT}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(about).encode()))
    finally:
        out.close()


def read(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a bucketed table, without its bucket column."""
    about = _about(spark, target)
    if about is None:
        raise ValueError(f"{target} is no bucketed table")
    return spark.read.schema(about["schema"] + ", bucket int").parquet(target).drop("bucket")


def latest(keys: list[str], seq: str) -> Merge:
    """Of each key the stored row gives way to the last new one by seq, which is not stored."""
    return lambda old, new: records.upsert(old, new, keys, seq)


def with_sources(keys: list[str], seq: str, arrays: list[str], text: str) -> Merge:
    """A key's arrays become the ordered union of the stored ones and the new ones, its text the first that is filled: the stored one stays."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        place = lambda stored, c: F.struct(F.lit(stored).alias("later"), c.alias("seq"))
        kind = new.schema[seq].dataType
        rows = old.withColumn(seq, place(0, F.lit(None).cast(kind))).unionByName(new.select(*old.columns, place(1, F.col(seq)).alias(seq)))
        return blocks.merge_sources(rows, keys, seq, arrays, text).select(*old.columns)

    return merge


def merge_into(spark: SparkSession, target: str, new: DataFrame, keys: list[str], merge: Merge, stored: str, buckets: int = BUCKETS) -> int:
    """Merge new rows into the table below target, whose stored columns have the schema `stored`; how many buckets were written.

    A row's bucket is the hash of its key. Only buckets that new rows fall into are read, merged and
    exchanged for new files; all others keep theirs. The number of buckets is the table's own, fixed
    when it is made, and bounds what the driver hears of: the touched numbers.
    """
    about = _about(spark, target)
    fresh = about is None
    about = about or {"buckets": buckets, "keys": keys, "schema": stored}
    if about["keys"] != keys or about["schema"] != stored:
        raise ValueError(f"{target} has the keys {about['keys']} and the columns {about['schema']}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(about["buckets"])).cast("int").alias("bucket")
    rows = cut_lineage(new)
    touched = sorted(r.bucket for r in rows.select(bucket).distinct().collect())
    if fresh:
        old = spark.createDataFrame([], stored)
    else:
        old = spark.read.schema(stored + ", bucket int").parquet(target).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = cut_lineage(merge(old, rows).select("*", bucket))
    if touched:
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        if fresh:
            _tell(spark, target, about)
    return len(touched)
