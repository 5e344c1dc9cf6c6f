"""Golden cases of record, ingest, block, quality, incremental and file operators."""

import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks, graphs, ingest, linkage, lookups, quality, records
from folioscope.sources import files, formats
from folioscope.streaming import incremental


def counts(spark, rows, stored):
    a = spark.createDataFrame([("b", x) for x in rows], "account string, aid string")
    s = spark.createDataFrame([("b", x) for x in stored], "account string, aid string")
    got = records.new_counts(a, s, "account", "aid").first()
    return (got.articles, got.messages) if got else (0, 0)


def test_counts(spark):
    assert counts(spark, ["100_1", "100_2", "101_1"], []) == (3, 2)
    assert counts(spark, ["100_1", "100_2"], ["100_1"]) == (1, 0)
    assert counts(spark, ["100_1"], ["100_2"]) == (1, 0)
    assert counts(spark, ["100_1", "100_1"], []) == (1, 1)
    one = spark.range(1)
    assert one.select(records.reconciled_total(F.lit(31), F.lit(31), F.lit(1)), records.reconciled_total(F.lit(40), F.lit(31), F.lit(1))).first()[:] == (32, 40)


def test_recover_is_greedy(spark):
    rows = [("a", "k1", "u1", 1), ("a", "k1", "u2", 2), ("a", "k2", "u2", 3), ("a", "k3", "u9", 4), ("a", "k9", "u4", 5)]
    df = spark.createDataFrame(rows, "account string, key string, link string, seq int")
    stored = spark.createDataFrame([("k9", "u9")], "key string, link string")
    assert sorted(r.seq for r in records.recover(df, stored, "account", "key", "link", "seq").collect()) == [1, 3]


def test_recover_against_a_walk(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([f"k{r.randrange(60)}", None]) if r.random() < 0.1 else f"k{r.randrange(90)}", f"u{r.randrange(90)}", n) for n in range(200)]
    stored = [("a", f"k{n}", f"u{n + 3}", n) for n in range(0, 60, 6)]
    want, seen = [], set()
    for a, k, u, n in rows:
        if k not in {x[1] for x in stored} and u not in {x[2] for x in stored} and not {(a, "k", k), (a, "u", u)} & seen:
            seen |= {(a, "k", k), (a, "u", u)}
            want.append(n)
    shape = "account string, key string, link string, seq int"
    got = records.recover(spark.createDataFrame(rows, shape), spark.createDataFrame(stored, shape), "account", "key", "link", "seq")
    assert sorted(x.seq for x in got.collect()) == want


def walked(rows):
    """seq of the rows that a walk keeps: (group, key, link, seq)."""
    seen, kept = set(), []
    for a, k, u, n in sorted(rows, key=lambda x: x[3]):
        if not {(a, "k", k), (a, "u", u)} & seen:
            seen |= {(a, "k", k), (a, "u", u)}
            kept.append(n)
    return kept


def test_greedy_in_rounds(spark, monkeypatch):
    """The same rows as a walk, by rounds alone and with a walk of what is left, on random graphs and on chains."""
    r = random.Random(21)
    shape = "a string, k string, u string, seq int"
    graphs_of = [[(r.choice(["x", None]), r.choice([f"k{r.randrange(n // 2)}", None]), f"u{r.randrange(n // 2)}", m) for m in r.sample(range(n), n)] for n in (60, 300)]
    graphs_of.append([("x", f"k{m // 2}", f"u{(m + 1) // 2}", m) for m in range(14)])
    for walk_rows in (0, 20):
        monkeypatch.setattr(graphs, "WALK_ROWS", walk_rows)
        for rows in graphs_of:
            got = graphs.greedy(spark.createDataFrame(rows, shape), [["a", "k"], ["a", "u"]], "seq")
            assert sorted(x.seq for x in got.collect()) == walked(rows)
    assert graphs.greedy(spark.createDataFrame([], shape), [["a", "k"]], "seq").collect() == []


def test_a_hot_account_is_spread(spark, monkeypatch):
    monkeypatch.setattr(graphs, "WALK_ROWS", 1000)
    rows = [("hot", f"k{(n * 7919) % 30_000}", f"u{(n * 104729) % 30_000}", n) for n in range(50_000)]
    got = graphs.greedy(spark.createDataFrame(rows, "a string, k string, u string, seq int"), [["a", "k"], ["a", "u"]], "seq")
    assert sorted(x.seq for x in got.collect()) == walked(rows)


def test_chains(spark):
    rows = [("long", "" if n == 0 else f"b{n}", f"b{n + 1}", n < 99, n) for n in range(100)]
    rows += [("gap", "", "x", True, 0), ("gap", "y", "z", True, 1), ("gap", "z", None, False, 2)]
    rows += [("loop", "", "p", True, 0), ("loop", "p", "q", True, 1), ("loop", "q", "r", True, 2), ("loop", "r", "p", True, 3)]
    rows += [("self", "", "", True, 0), ("headless", "m", "n", False, 0), ("null", None, "x", True, 0), ("null", "", None, True, 1)]
    rows += [("twice", "", "t", True, 0), ("twice", "t", None, False, 1), ("twice", "t", None, False, 1), (None, "", "n", True, 0), (None, "n", None, None, 1)]
    r = random.Random(2)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at string, nxt string, more boolean, n int").repartition(3)
    got = {}
    for x in graphs.chained(df, "g", "at", "nxt", "more").collect():
        got.setdefault(x.g, []).append((x.n, x.place, x.reason))
    got = {g: sorted(v, key=str) for g, v in got.items()}
    assert sorted(got["long"], key=lambda v: v[0]) == [(n, n, None) for n in range(100)]
    assert got["gap"] == [(0, 0, "broken"), (1, None, "unreached"), (2, None, "unreached")]
    assert got["loop"] == [(0, 0, None), (1, 1, None), (2, 2, None), (3, 3, "loop")]
    assert got["self"] == [(0, 0, "loop")] and got["headless"] == [(0, None, "unreached")]
    assert got["null"] == [(0, None, "unreached"), (1, 0, "broken")]
    assert got["twice"] == [(0, 0, None), (1, 1, None), (1, None, "repeated")]
    assert got[None] == [(0, 0, None), (1, 1, None)]


def test_components(spark):
    edges = [(n, n + 1) for n in range(20)] + [(40, 30), (30, 35), (50, 50)]
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**{n: 0 for n in range(21)}, 30: 30, 35: 30, 40: 30}


def test_link_catalog_of_one_hot_title(spark):
    """One title for all: dates alone, dates tied by paths that hold another entry's date."""
    r = random.Random(5)
    for days in (3, 9, 25):
        day = [f"2025-03-{d:02d}" for d in range(1, days + 1)]
        entries = [(k, "T", r.choice(day)) for k in range(60)]
        files = [(f"/{k}/{r.choice(day).replace('-', '') if r.random() < 0.6 else 'x'}/{r.choice(day).replace('-', '') if r.random() < 0.1 else ''}", "T", r.choice(day)) for k in range(40)]
        free, want = {f: d for f, _, d in files}, {}
        for k, _, d in entries:
            found = next(((x[0], n) for n, x in enumerate(([f for f in free if free[f] == d], [f for f in free if d.replace("-", "") in f])) if len(x) == 1), None)
            want[k] = (found[0], "matched" if free.pop(found[0]) == d else "date-mismatch", linkage.TIERS[found[1]]) if found else (None, "ambiguous" if free else "missing", None)
        got = linkage.link_catalog(spark.createDataFrame(entries, "entry int, title string, date string"), spark.createDataFrame(files, "file string, title string, date string"), "2025-01-01").collect()
        assert {x.entry: (x.file, x.status, x.tier) for x in got} == want, days


def test_link_catalog(spark):
    """Against a walk over all entries in order, with titles that several entries and files share."""
    r = random.Random(8)
    titles = ["One, two", "One  two", "ONE TWO", "Three!", "Three?", "four", "Five", "six"]
    for round_ in range(6):
        days = [f"2025-0{m}-0{d}" for m in (1, 2) for d in (1, 2, 3)]
        entries = [(k, r.choice(titles), r.choice(days)) for k in range(r.randint(1, 14))]
        files = [(f"/{k}/{r.choice(days).replace('-', '') if r.random() < 0.4 else 'x'}", r.choice(titles), r.choice(days)) for k in range(r.randint(0, 12))]
        boundary = r.choice(["2025-01-01", "2025-01-03"])

        def exact(t):
            return " ".join(t.split())

        def relaxed(t):
            return re.sub(r"[\W_]+", "", t.lower())

        todo = [e for e in entries if e[2] >= boundary]
        used, want = set(), {}
        for k, t, day in todo:
            own = [f for f in files if exact(f[1]) == exact(t) and f[0] not in used]
            found = None
            for tier, some in ((0, [f for f in own if f[2] == day]), (1, [f for f in own if day.replace("-", "") in f[0]]), (2, own if sum(exact(x[1]) == exact(t) for x in todo) == 1 else [])):
                if found is None and len(some) == 1:
                    found = (some[0], linkage.TIERS[tier])
            if found is None and not own:
                some = [f for f in files if relaxed(f[1]) == relaxed(t) and f[0] not in used]
                if len(some) == 1 and sum(relaxed(x[1]) == relaxed(t) for x in todo) == 1:
                    found = (some[0], linkage.TIERS[3])
            if found:
                used.add(found[0][0])
                want[k] = (found[0][0], "matched" if found[0][2] == day else "date-mismatch", found[1])
            else:
                want[k] = (None, "ambiguous" if own else "missing", None)
        c = spark.createDataFrame(entries, "entry int, title string, date string")
        got = linkage.link_catalog(c, spark.createDataFrame(files, "file string, title string, date string"), boundary).collect()
        assert {x.entry: (x.file, x.status, x.tier) for x in got} == want, round_


def test_catalog_problems(spark):
    entries = spark.createDataFrame([("a", 1, "2025-02-02"), ("a", 2, "2025-01-05"), ("a", 3, "2024-12-30"), ("b", 1, "2025-01-01"), ("b", 2, "2025-01-02")], "account string, at int, date string")
    shape = "account string, loaded int, initial int, initial_oldest string, oldest string, steps int, reached boolean"
    facts = spark.createDataFrame([("a", 3, 2, "2025-01-05", "2024-12-30", 1, True), ("b", 2, 2, "2025-01-01", "2025-01-02", 0, True), ("c", 0, None, None, None, None, None)], shape)
    got = {}
    for x in linkage.catalog_problems(entries, "account", "at", "date", facts, "2025-01-01").collect():
        got.setdefault(x.account, set()).add(x.problem)
    assert got == {"b": {"dates rise", "initial date differs", "no scroll", "no growth", "boundary not crossed"}, "c": {"no entries", "no initial count", "boundary not crossed"}}


def test_repairs_compare_before_they_set(spark):
    page = '---\ntitle: "x"\nurl: "https://o"\n---\nurl: body'
    df = spark.createDataFrame([(page,)], "p string")
    assert df.select(linkage.patched_frontmatter("p", "url", F.lit("https://o"), F.lit('a"b'))).first()[0] == '---\ntitle: "x"\nurl: "a\\"b"\n---\nurl: body'
    for key, have in (("url", "https://other"), ("date", "")):
        with pytest.raises(Exception, match="changed since|not one line"):
            df.select(linkage.patched_frontmatter("p", key, F.lit(have), F.lit("z"))).collect()


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "nickname string, x int")
    assert lookups.one_row(df, F.col("nickname") == "b")["x"] == 2 and lookups.any_row(df, F.col("x") > 1) and not lookups.any_row(df, F.col("x") > 2)
    assert lookups.accounts_named(df, "a")[1] == 1
    for call in (lambda: lookups.one_row(df, F.col("x") == 9), lambda: lookups.accounts_named(df, "A")):
        with pytest.raises(LookupError):
            call()


def test_messages(spark):
    def item(mid, idx, host="mp.weixin.qq.com", flag=0):
        return {"title": f"t{idx}", "content_url": f"https://{host}/s?mid={mid}&amp;idx={idx}", "del_flag": flag}

    page = json.dumps({"list": [{"comm_msg_info": {"id": 1, "datetime": 1757347200}, "app_msg_ext_info": item(100, 1) | {"multi_app_msg_item_list": [item(100, 2), item(100, 3, flag=4), item(100, 4, "evil.example")]}}]})
    df = spark.createDataFrame([("a", page, 1), ("a", "not json", 2)], "account string, general_msg_list string, seq int")
    got = ingest.messages(df, "seq", hosts=("mp.weixin.qq.com",)).orderBy("aid").collect()
    assert [(r.aid, r.create_time) for r in got] == [("100_1", 1757347200), ("100_2", 1757347200)]
    ok = spark.range(1).select(ingest.page_valid(F.lit(10), F.lit(10)), ingest.page_valid(F.lit(10), F.lit(1_000_001)), ingest.page_valid(F.lit(10), F.lit(20))).first()
    assert ok[:] == (False, False, True)


def test_replies(spark):
    kind = "array<struct<create_time:bigint,text:string>>"
    df = spark.range(1).select(F.from_json(F.lit('[{"create_time":2,"text":"b"},{"create_time":1,"text":"a"},{"create_time":2,"text":"c"}]'), kind).alias("e"), F.from_json(F.lit("[]"), kind).alias("s"))
    got = df.select(ingest.replies_or_embedded(F.col("s"), F.col("e")).alias("x"), ingest.replies_or_embedded(F.slice("e", 1, 1), F.col("e")).alias("y")).first()
    assert [r.text for r in got.x] == ["a", "b", "c"] and [r.text for r in got.y] == ["b"]


def test_products(spark):
    body = "intro\n### Royal Match\n发行商：Dream、Studio甲\n平台: iOS, Android\n\n亮点：\n好玩\n链接：https://a.b/c\n一段描述。\nMerge Mansion   Supercell\n其他内容在这里。"
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc long, body string")
    got = {r.name: r for r in blocks.products(df, "doc", "body", [("[Ss]upercell", "Supercell")]).collect()}
    a, b = got["Royal Match"], got["Merge Mansion"]
    assert a.candidates == ["Dream", "Studio甲"] and a.publisher == "冲突待审" and a.platforms == ["iOS", "Android"] and a.links == ["https://a.b/c"] and a.description == "一段描述。"
    assert b.publisher == "Supercell" and b.description == "其他内容在这里。" and len(got) == 2


def test_records_and_frontmatter(spark):
    df = spark.createDataFrame([(1, "name: a\nkind: x\nname: b\nkind: y\nkind: z\nother")], "doc long, t string")
    rows = blocks.lines(df, "doc", "t")
    label, val = F.regexp_extract("line", r"^(\w+): ", 1), F.regexp_extract("line", r": (.*)$", 1)
    got = blocks.records(rows, "doc", label, val, "name", ["name", "kind"]).orderBy("block").collect()
    assert [(r.name, r.kind) for r in got] == [("a", "x"), ("b", "z")]
    md = "---\ntitle: \"T: x\"\ndate: 2025-01-02\nurl: https://u\n---\nbody\ntitle: no"
    one = spark.createDataFrame([(md,)], "t string").select(blocks.frontmatter("t", "title"), blocks.frontmatter("t", "url"), blocks.frontmatter("t", "none")).first()
    assert one[:] == ("T: x", "https://u", None)


def products(spark, rows):
    return spark.createDataFrame(rows, "article string, name string, publisher string, candidates array<string>")


def test_quality(spark):
    articles = spark.createDataFrame([("a",), ("b",)], "article string")
    clean = [("a", f"Merge Go {k}", "P", ["P"]) for k in range(30)]
    m = quality.gate(quality.metrics(products(spark, [*clean, ("a", "亮点", "P", ["P"])]), articles, "article")).first()
    assert m.status == "fail" and m.failures == ["suspicious_product_names"] and m.warnings == ["articles_without_products"] and m.suspicious_name_count == 1
    m = quality.gate(quality.metrics(products(spark, [("a", "Same Game", "P", ["P"]), ("b", "same game", "Q", ["Q"]), *[("a", f"Game No {k}", "未知", []) for k in range(5)]]), articles, "article")).first()
    assert m.status == "pass" and m.warnings == ["unknown_publisher_ratio_exceeded", "publisher_conflict_ratio_exceeded"] and m.publisher_conflict_count == 1
    m = quality.gate(quality.metrics(products(spark, []), articles.limit(0), "article")).first()
    assert (m.unknown_publisher_ratio, m.suspicious_name_ratio, m.publisher_conflict_ratio) == (1.0, 1.0, 0.0) and m.failures == ["no_articles", "no_products"]


def test_plan_digest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id long, t string")
    plan = quality.upsert_plan(old, new, "id", ["t"])
    assert {r.id: r.action for r in plan.collect()} == {1: "unchanged", 2: "updated", 3: "created"}
    assert quality.plan_digest(plan, "id").first() == quality.plan_digest(plan.repartition(5), "id").first()


def test_overlap(spark):
    def policy(last):
        return tuple(spark.range(1).select(incremental.overlap_policy(F.lit(last).cast("long"), F.lit(1_000_000_000)).alias("p")).first().p)

    assert policy(1_000_000_000 - 86400) == (14, 6) and policy(None) == (45, 11) and policy(0) == (45, 11)
    c = spark.range(1).select(*[incremental.crosses(F.lit(t), F.lit(i), F.lit(100), F.array(F.lit("x"))) for t, i in ((100, "x"), (99, "y"), (101, "x"), (100, "y"))]).first()
    assert c[:] == (True, True, False, False)


def test_scan_stops(spark):
    rows = [("a", 0, False, 90), ("a", 1, True, 80), ("a", 2, False, 70), ("a", 3, False, 60), ("a", 4, False, 50), ("b", 0, False, 90)]
    df = spark.createDataFrame(rows, "a string, page int, crossed boolean, oldest int")
    for required, floor, last in ((1, 75, 2), (2, 75, 3), (1, 55, 4)):
        got = incremental.scan_pages(df, "a", "page", "crossed", "oldest", F.lit(required), F.lit(floor)).collect()
        assert max(r.page for r in got if r.a == "a") == last and sum(r.a == "b" for r in got) == 1


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([(1, 10, "2024-01-01 00:00:05"), (1, 11, "2024-01-01 00:00:05"), (2, 12, "2024-01-02 00:00:00"), (1, 10, "2024-01-01 00:00:05")], "u long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    state, ck = f"{tmp_path}/state", f"{tmp_path}/ck"
    incremental.watermark_stream(stream, "u", "ts", "id", state, ck).awaitTermination()
    spark.createDataFrame([(1, 13, "2023-12-31 00:00:00"), (2, 14, "2024-01-03 00:00:00")], "u long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(1).write.mode("append").parquet(src)
    incremental.watermark_stream(stream, "u", "ts", "id", state, ck).awaitTermination()
    got = {r.u: r.ids for r in spark.read.parquet(f"{state}/batch=1").collect()}
    assert got == {1: [10, 11], 2: [14]}
    q = incremental.dedup_stream(stream, "ts", ["u", "id"]).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 5


def test_files(spark, tmp_path):
    for path, body in (("acct/title one/index.md", "---\ntitle: One\ndate: 2025-01-02\nurl: https://u/1\n---\nx"), ("acct/two/index.md", "no head"), ("acct/.hidden/index.md", "---\nurl: h\n---"), ("acct/two/images/index.md", "x")):
        f = tmp_path / "root" / path
        f.parent.mkdir(parents=True)
        f.write_text(body)
    articles = files.read_articles(spark, f"{tmp_path}/root")
    assert articles.count() == 2
    assert [(r.title, r.account, r.url) for r in files.manifest(articles).collect()] == [("One", "acct", "https://u/1")]
    good, bad = files.read_local(articles)
    assert good.count() == 1 and bad.first().reason == "no title"
    (tmp_path / "rows.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n')
    assert files.read_json_lines(spark, f"{tmp_path}/rows.jsonl", "id long", strict=False).count() == 2
    with pytest.raises(Exception, match="."):
        files.read_json_lines(spark, f"{tmp_path}/rows.jsonl", "id long").collect()
    ok, no = files.read_json_lines_split(spark, f"{tmp_path}/rows.jsonl", "id long")
    assert ok.count() == 2 and no.first().line == "broken"


def test_vectors_and_sinks(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(struct.pack("<II6f", 3, 2, 1, 2, 3, 4, 5, 6))
    v = formats.read_vectors(spark, f"{tmp_path}/v.bin")
    assert [r.embedding for r in v.orderBy("pos").collect()] == [[1, 2], [3, 4], [5, 6]]
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, t string")
    assert files.aligned(rows, v).count() == 3
    with pytest.raises(Exception, match="align"):
        files.aligned(rows.limit(2), v).collect()
    (tmp_path / "bad.bin").write_bytes(struct.pack("<II1f", 3, 2, 1))
    with pytest.raises(Exception, match="size"):
        formats.read_vectors(spark, f"{tmp_path}/bad.bin").collect()
    kept = files.renumber(rows.filter("pos <> 1").withColumnRenamed("pos", "old"), "old")
    assert [(r.t, r.pos) for r in kept.orderBy("pos").collect()] == [("a", 0), ("c", 1)]
    target = f"{tmp_path}/out"
    assert files.write_staged(rows, target) == 3 and files.write_staged(rows.limit(1), target) == 1 and spark.read.parquet(target).count() == 1
    with pytest.raises(ValueError, match="wanted"):
        files.write_staged(rows.limit(0), target, least_rows=1)
    assert spark.read.parquet(target).count() == 1
    files.write_table(rows.withColumn("a", F.array("t")), f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("pos").first().a == '["a"]'
    formats.write_files(rows, "t", "t", f"{tmp_path}/txt")
    assert sorted(p.name for p in (tmp_path / "txt").iterdir()) == ["a", "b", "c"]
