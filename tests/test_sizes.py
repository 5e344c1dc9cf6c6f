"""Steps that hold about every row of a table are dealt by its rows, not by the session's number of partitions alone."""

import re

from folioscope.operators import records
from folioscope.plans import catalog

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_parts_grow_with_rows(spark):
    rows = catalog.load(spark, SF, "lineitem").count()
    assert catalog.parts_of(spark, SF, "lineitem", 50) == -(-rows // 50)
    assert catalog.parts_of(spark, SF, "lineitem") == spark.sparkContext.defaultParallelism


def test_pages_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(catalog, "parts_of", lambda *_: 37)
    assert [n for _, n in exchanges(catalog.QUERIES["published_pages"](spark, SF))] == ["37"]


def test_new_counts_are_dealt_by_articles(spark):
    rows = spark.createDataFrame([("a", f"{m}_{k}") for m in range(40) for k in range(3)], "account string, aid string")
    stored = rows.filter("aid LIKE '%7_1'")
    dealt = records.new_counts(rows, stored, "account", "aid", 37)
    assert [len(k.split(",")) for k, n in exchanges(dealt) if n == "37"] == [3]
    assert sorted(dealt.collect()) == sorted(records.new_counts(rows, stored, "account", "aid").collect()) == [("a", 116, 36)]


def test_products_read_and_deal_texts_once(spark):
    df = catalog.QUERIES["product_extraction"](spark, SF)
    assert [k for k, _ in exchanges(df)] == [re.search(r"doc_id#\d+L", str(exchanges(df)))[0]]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
