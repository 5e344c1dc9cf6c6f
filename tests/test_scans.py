"""Scans as a stateful stream against the batch result, also after a restart."""

import pytest
from pyspark.sql import Window as W, functions as F

from folioscope.streaming import incremental, scans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scans.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_equal_batches(rocks, tmp_path):
    """Two scans of each account of events: a first whole one, and one that stops at what the first has seen."""
    spark = rocks
    (tmp_path / "in").mkdir()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("account"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("id"))
    cut = events.agg(F.percentile_approx("at", 0.7)).first()[0]

    def pages(rows, day):
        place = F.row_number().over(W.partitionBy("account").orderBy(F.desc("at"), "id")) - 1
        paged = rows.withColumn("page", F.floor(place / 5).cast("long")).groupBy("account", "page").agg(F.sort_array(F.collect_list(F.struct("at", "id")), False).alias("x"))
        full = paged.select("account", "page", F.col("x.at").alias("at"), F.col("x.id").alias("ids"))
        ends = full.groupBy("account").agg((F.max("page") + 1).alias("page")).select("account", "page", F.array().cast("array<long>").alias("at"), F.array().cast("array<string>").alias("ids"))
        return full.unionByName(ends).withColumn("seen_at", F.to_timestamp(F.lit(day)) + F.expr("INTERVAL 1 MINUTE") * F.col("page"))

    stream = scans.scan_stream(spark.readStream.schema(scans.PAGES).option("maxFilesPerTrigger", 1).parquet(src), required=1, overlap_days=3, lateness="0 seconds")
    first = pages(events.filter(F.col("at") <= cut), "2024-03-01")
    first.filter("page < 2").coalesce(1).write.mode("append").parquet(src)
    run(stream, out, ck)
    first.filter("page >= 2").coalesce(1).write.mode("append").parquet(src)
    run(stream, out, ck)  # the scan goes on after a restart
    second = pages(events, "2024-03-02")
    second.coalesce(1).write.mode("append").parquet(src)
    run(stream, out, ck)
    got = spark.read.parquet(out)
    whole = {(r.account, r.page): r.reason for r in got.join(first, ["account", "page"]).select("account", "page", "reason").collect()}
    assert whole.keys() == {(r.account, r.page) for r in first.collect()}
    marks = incremental.high_watermark(events.filter(F.col("at") <= cut), "account", "at", "id")
    read = second.filter(F.size("at") > 0).join(marks.withColumnRenamed("ids", "known"), "account", "left")
    crossed = F.exists(F.arrays_zip("at", "ids"), lambda x: incremental.crosses(x["at"], x["ids"], F.col("watermark"), F.col("known")))
    p = read.select("account", "page", "watermark", F.array_min("at").alias("oldest"), F.coalesce(crossed, F.lit(False)).alias("crossed"))
    floor = incremental.overlap_floor(F.col("watermark"), F.lit(3), F.lit(0))
    want = {(r.account, r.page, r.oldest, r.crossed, r.stop) for r in incremental.scan_pages(p, "account", "page", "crossed", "oldest", F.lit(1), floor).collect()}
    seen = got.filter("reason IS NULL OR reason = 'overlap'").exceptAll(spark.createDataFrame([], got.schema)).collect()
    first_run = {(r.account, r.page, min(r.at, default=None), False, False) for r in first.collect() if r["at"]}
    left = {(r.account, r.page, r.oldest, r.crossed, r.stop) for r in seen}
    assert left == want | first_run
    assert any(s for *_, s in want) and got.filter("reason = 'overlap'").count() == sum(s for *_, s in want)


def test_stops_errors_and_audits(rocks, tmp_path):
    spark = rocks
    (tmp_path / "in").mkdir()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    stream = scans.scan_stream(spark.readStream.schema(scans.PAGES).option("maxFilesPerTrigger", 1).parquet(src), required=1, overlap_days=0, hard_floor=50, audit_days=30, lateness="0 seconds")

    def arrive(day, *rows):
        shape = scans.PAGES.replace("seen_at timestamp", "day string")
        spark.createDataFrame([(*r, day) for r in rows], shape).withColumn("seen_at", F.to_timestamp("day")).drop("day").coalesce(1).write.mode("append").parquet(src)
        run(stream, out, ck)

    def told():
        return sorted(((r.account, r.page, r.stop, r.reason) for r in spark.read.parquet(out).collect()), key=str)

    arrive("2024-01-01", ("a", 1, [210], ["x"]), ("a", 0, [300, 300], ["p", "q"]), ("a", 1, [200], ["r"]), ("b", 0, [60], ["s"]), ("b", 2, [55], ["t"]), ("b", 1, [40], ["t"]), ("c", 0, [], []))
    assert told() == sorted([("a", 0, False, None), ("a", 1, False, None), ("a", 1, None, "not-advancing"), ("b", 0, False, None), ("b", 1, True, "date-floor"), ("c", 0, True, "complete")], key=str)
    arrive("2024-01-02", ("a", 2, [], []), ("a", 3, [1], ["late"]))
    arrive("2024-01-03", ("a", 0, [400, 300], ["u", "q"]), ("a", 1, [299], ["v"]), ("a", 2, [298], ["w"]))
    new = [r for r in told() if r[0] == "a"]
    assert ("a", 2, True, "complete") in new and ("a", 1, True, "overlap") in new and not [r for r in new if r[1] == 3] and ("a", 2, False, None) not in new
    arrive("2024-02-01", ("d", 0, [99], ["z"]))
    arrive("2024-02-15", ("d", 1, [98], ["y"]))
    due = [r[0] for r in told() if r[3] == "audit-due"]
    assert sorted(due) == ["a", "b", "c"]
