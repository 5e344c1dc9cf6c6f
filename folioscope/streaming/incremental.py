"""Incremental scans: high watermarks, bounded overlap, and the same over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

DAY = 86400


def overlap_policy(last_success: Column, now: Column) -> Column:
    """Struct (days, pages) of the overlap: 7 days over the gap, 14 to 45; a page more per week over 14, from 6. No success: 45."""
    gap = F.when(last_success > 0, F.greatest(F.lit(0), F.ceil((now - last_success) / DAY))).otherwise(F.lit(45))
    days = F.least(F.lit(45), F.greatest(F.lit(14), gap + 7)).cast("long")
    pages = F.least(F.lit(12), 6 + F.ceil(F.greatest(F.lit(0), days - 14) / 7)).cast("long")
    return F.struct(days.alias("days"), pages.alias("pages"))


def high_watermark(rows: DataFrame, account: str, ts: str, aid: str) -> DataFrame:
    """(account, watermark, ids): the largest time and the sorted distinct ids at it; accounts without a positive time are left out."""
    top = rows.groupBy(account).agg(F.max(ts).alias("watermark")).filter("watermark > 0")
    at = rows.select(account, F.col(ts).alias("__at"), F.col(aid).alias("__id")).join(top, account).filter("__at = watermark").select(account, "watermark", "__id").distinct()
    return at.groupBy(account, "watermark").agg(F.array_sort(F.collect_list("__id")).alias("ids"))


def crosses(ts: Column, aid: Column, watermark: Column, ids: Column) -> Column:
    """Whether an article shows that the scan reached what is known: older, or of the same second and known."""
    return (ts < watermark) | ((ts == watermark) & F.array_contains(ids, aid))


def overlap_floor(watermark: Column, days: Column, hard_floor: Column) -> Column:
    return F.greatest(hard_floor, watermark - days * DAY)


def scan_pages(pages: DataFrame, account: str, page: str, crossed: str, oldest: str, required: Column, floor: Column) -> DataFrame:
    """The pages that a scan reads: up to the first page, inclusive, at which the watermark was crossed, `required` pages followed and the floor was reached.

    pages: one row per account and page with crossed (whether it crosses) and oldest (its smallest time).
    """
    so_far = W.partitionBy(account).orderBy(page).rowsBetween(W.unboundedPreceding, 0)
    first = F.min(F.when(F.col(crossed), F.col(page))).over(so_far)
    stop = first.isNotNull() & (F.col(page) - first >= required) & (F.min(oldest).over(so_far) <= floor)
    marked = pages.withColumn("stop", F.coalesce(stop, F.lit(False)))
    last = F.min(F.when(F.col("stop"), F.col(page))).over(W.partitionBy(account))
    return marked.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")


def advance_errors(pages: DataFrame, account: str, page: str, offset: str, most: int = 1_000_000) -> DataFrame:
    """Pages whose offset did not advance over the page before, or is out of range."""
    before = F.lag(offset).over(W.partitionBy(account).orderBy(page))
    return pages.withColumn("__b", before).filter((F.col(offset) <= F.col("__b")) | (F.col(offset) > most)).drop("__b")


def dedup_stream(events: DataFrame, ts: str, keys: list[str], lateness: str = "45 days") -> DataFrame:
    """A stream without repeats of a key within the lateness; ts is cast to a timestamp, as a zone-less one is no event time."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def watermark_stream(events: DataFrame, account: str, ts: str, aid: str, state_dir: str, checkpoint: str) -> StreamingQuery:
    """Keep each account's high watermark in state_dir, one folder per batch; a batch that runs again writes the same folder.

    Each batch meets the state of the batch before, so late rows change nothing but what they should.
    Folders before that one are removed: a batch that runs again needs no older one.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = high_watermark(batch.withColumn("__ts", F.col(ts).cast("timestamp").cast("long")), account, "__ts", aid)
        if number:
            old = spark.read.parquet(f"{state_dir}/batch={number - 1}")
            flat = old.unionByName(new).select(account, "watermark", F.explode("ids").alias("__id"))
            new = high_watermark(flat, account, "watermark", "__id")
        new.write.mode("overwrite").parquet(f"{state_dir}/batch={number}")
        old_state = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/batch={number - 2}")
        old_state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old_state, True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
