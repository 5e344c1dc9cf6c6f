"""Bucketed merges against full rewrites; dictionaries against chains; both extractors."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import aliases, names
from folioscope.operators import extractors, merged, quality
from folioscope.sources import files


def files_of(root):
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.stat().st_ino) for p in root.rglob("part-*")}


def test_merges_touch_their_buckets_only(spark, tmp_path):
    r = random.Random(9)
    stored, held, keys = "k string, v long, note string", {}, ["k"]
    target = str(tmp_path / "t")
    for step in range(4):
        rows = [(f"k{r.randrange(60)}", step * 100 + n, r.choice(["a", None]), n) for n in range(0 if step == 3 else 12)]
        before = files_of(tmp_path / "t") if step else {}
        n = merged.merge_into(spark, target, spark.createDataFrame(rows, stored + ", seq int"), keys, merged.latest(keys, "seq"), stored, buckets=32)
        for k, v, note, _ in rows:
            held[k] = (k, v, note)
        assert sorted(map(tuple, merged.read(spark, target).collect())) == sorted(held.values())
        after = files_of(tmp_path / "t")
        same = {f for f in before if after.get(f) == before[f]}
        assert len({f.split("/")[0] for f in after if f not in same}) == n
        assert all(f in same or f.split("/")[0] in {g.split("/")[0] for g in after if g not in same} for f in before)
    assert before == after and n == 0
    with pytest.raises(ValueError, match="has the keys"):
        merged.merge_into(spark, target, spark.createDataFrame([], stored), ["v"], merged.latest(["v"], "seq"), stored)
    with pytest.raises(ValueError, match="no bucketed table"):
        merged.read(spark, str(tmp_path / "none"))


def test_stored_sources_come_first(spark, tmp_path):
    stored, keys, target = "k string, sources array<string>, text string", ["k"], str(tmp_path / "t")
    rule = merged.with_sources(keys, "seq", ["sources"], "text")
    for rows in ([("a", ["s1"], "", 1), ("b", ["s1"], "old", 1)], [("a", ["s2", "s1"], "new", 5), ("a", ["s3"], "late", 7), ("b", ["s0"], "new", 0)]):
        merged.merge_into(spark, target, spark.createDataFrame(rows, stored + ", seq int"), keys, rule, stored, buckets=4)
    assert {r.k: (r.sources, r.text) for r in merged.read(spark, target).collect()} == {"a": (["s1", "s2", "s3"], "new"), "b": (["s1", "s0"], "old")}


def test_dictionaries_equal_chains(spark):
    r = random.Random(4)
    words = [("".join(r.choice("abAé ") for _ in range(r.randint(1, 4))), f"n{r.randrange(30)}") for _ in range(60)] + [("", "empty")]
    texts = ["".join(r.choice("abAé cx") for _ in range(r.randint(0, 25))) for _ in range(200)] + [None, "", "ABA É"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    once = {w: n for w, n in reversed(words) if w}
    once = {w: once[w] for w, _ in words if w}
    any_case, exact = aliases.shared_words(spark, words), aliases.shared_words(spark, words, ignore_case=False)
    got = df.select("t", aliases.first_name("t", any_case).alias("a"), aliases.first_name("t", exact).alias("b"), aliases.all_names("t", exact).alias("c"), names.detect("t", [], dict(reversed([(w, n) for w, n in words if w][:1]))).alias("chain")).collect()
    for x in got:
        if x.t is None:
            assert (x.a, x.b, x.c) == (None, None, None)
            continue
        hits = [n for w, n in words if w and w in x.t]
        assert x.b == (hits[0] if hits else None) and x.c == list(dict.fromkeys(n for w, n in once.items() if w in x.t))
        low = [n for w, n in words if w and w.lower() in x.t.lower()]
        assert x.a == (low[0] if low else None)
        assert x.chain == (words[0][1] if words[0][0].lower() in x.t.lower() else None)
    none = aliases.shared_words(spark, [])
    assert {(v.a, tuple(v.c)) for v in df.filter("t IS NOT NULL").select(aliases.first_name("t", none).alias("a"), aliases.all_names("t", none).alias("c")).collect()} == {(None, ())}
    with pytest.raises(ValueError, match="characters of words"):
        aliases.shared_words(spark, [("x" * 11, "n")], most=10)
    with pytest.raises(ValueError, match="characters of words"):
        aliases.words_of(spark.createDataFrame([("x" * 11, "n", 1)], "w string, n string, r int"), "w", "n", "r", most=10)


def test_ten_thousand_aliases_in_one_pass(spark):
    words = [(f"Brand{k}X", f"n{k}") for k in range(10_000)]
    shared = aliases.shared_words(spark, words)
    df = spark.range(2000).select(F.concat(F.lit("some prose of BRAND"), F.col("id") * 7 % 10_000, F.lit("x and brand9999x")).alias("t"), F.concat(F.lit("n"), F.col("id") * 7 % 10_000).alias("want"))
    assert df.filter(aliases.first_name("t", shared) != F.col("want")).count() == 0


def test_both_extractors(spark):
    text = """---
title: "A"
---
Pre     Fix Co
游戏名字：One
游戏公司：Firm 1
游戏公司：Firm 2
平台：
One   Other Firm
https://play.google.com/store/apps/details?id=x.y
One   Third
https://apps.apple.com/app/id7
 > Quote     Firm
游戏类型：RPG
游戏名字：Two
"""
    got = [tuple(r)[1:] for r in extractors.products(spark.createDataFrame([(1, text), (2, None), (3, "游戏公司：alone")], "i int, t string"), "i", "t").collect()]
    link = "https://play.google.com/store/apps/details?id=x.y"
    assert sorted(got, key=str) == sorted([
        ("structured", 1, "One", "Firm 2", "RPG", None, None, link, "x.y", "https://apps.apple.com/app/id7", None),
        ("structured", 2, "Two", None, None, None, None, None, None, None, None),
        ("inline", 1, "Pre", "Fix Co", None, None, None, None, None, None, []),
    ], key=str)


def test_folders_of_one_level(spark, tmp_path):
    for path in ("a/index.md", "未知公众号_x/index.md", "b/c/index.md", "d/other.md", "index.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    assert [r.path.rsplit("/", 2)[1] for r in files.read_articles_one_level(spark, str(tmp_path)).collect()] == ["a"]


def test_report(spark):
    mentions = spark.createDataFrame([("A", k, f"t{k % 13:02d}", k % 2 == 0) for k in range(40)] + [("B", 1, "x", True)], "publisher string, article int, title string, single boolean")
    products = spark.createDataFrame([("B", "p1", 1), ("B", "p1", 2), ("C", "p0", 0), ("未知", "u", 3), ("", "e", 4)], "publisher string, name string, seq int")
    rows = quality.report(mentions, products)
    got = {r.publisher: r for r in rows.collect()}
    assert got["A"].titles == [f"t{k:02d}" for k in range(10)] and (got["A"].articles, got["A"].alone, got["A"].rank_by_articles) == (40, 20, 1)
    assert got["B"].product_names == ["p1"] and (got["B"].products, got["B"].names, got["B"].rank_by_products) == (2, 1, 1) and got["C"].articles == 0 and set(got) == {"A", "B", "C"}
    gate = quality.gate(quality.metrics(products.select(F.col("seq").alias("k"), "name", "publisher", F.array().cast("array<string>").alias("candidates")), mentions.select(F.col("article").alias("k")), "k"))
    told = quality.report_text(rows, gate)
    assert told.startswith("# Products") and "| 1 | A | 40 | 20 | 0 | 0 |" in told and "## B\n\n- **p1**\n- x" in told
