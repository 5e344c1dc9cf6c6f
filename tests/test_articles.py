"""Golden cases of article rows, output paths and run control."""

import hashlib
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.functions import html, select
from folioscope.operators import articles, paths
from folioscope.plans import control
from folioscope.sources import files


def plan(spark, rows, existing=None):
    df = spark.createDataFrame([(a, t, "2026-07-11", u, k) for k, (a, t, u) in enumerate(rows)], "account string, title string, date string, url string, seq int")
    ex = None if existing is None else spark.createDataFrame(existing, "path string, url string")
    out = paths.plan_paths(df, ex)
    assert paths.clashing_paths(out).count() == 0
    return {r.url: r.path for r in out.collect()}


def test_paths(spark):
    got = plan(spark, [("acct", "title", "https://u/1"), ("acct", "title", "https://u/2")])
    assert got["https://u/1"] == "acct/title" and got["https://u/2"].startswith("acct/title--20260711-") and len(got["https://u/2"]) == len("acct/title--20260711-") + 8
    assert plan(spark, [("a", "t", "u"), ("a", "other", "u")]) == {"u": "a/t"}
    got = plan(spark, [("a", "t", "u"), ("A/B", "x", "v")], [("old/place", "u"), ("A-B/x", None)])
    assert got["u"] == "old/place" and got["v"].startswith("A-B/x--20260711-")
    one = spark.range(1).select(paths.from_template("${account}/${YYYY}-${MM}/${title}", F.lit("A b"), F.lit("x/y"), F.lit("1_1"), F.lit(None).cast("string"), F.lit(1757347200), 12).alias("x")).first().x
    assert one == "A_b/2025-09/"
    scope = spark.createDataFrame([("/r/a/t/index.md",), ("/r/_x/t/index.md",), ("/r/b/t/index.md",), ("/q/a/t/index.md",), ("/r/a/t/x.md",)], "p string")
    assert [r.p for r in scope.filter(paths.in_scope("p", "/r", ["a"])).collect()] == ["/r/a/t/index.md"]


def test_search_results(spark):
    page = """<ul class="news-list"><li d="d1"><h3><a href="/link?url=x&amp;y=1"><em>Ti</em>tle</a></h3><div class="s-p"><span class="all-time-y2">Acct</span><span class="s2"><script>document.write(timeConvert('1757347200'))</script></span></div></li>
    <li d="d2"><h3><a href="/l2">T2</a></h3><span class="all-time-y2">Other</span></li><li d="d3"><h3>none</h3></li><li d="d4"><h3><a href="/l4">T4</a></h3><span class="all-time-y2">Acct</span></li></ul>"""
    df = spark.createDataFrame([(page, 1), (page, 2), (None, 3)], "p string, at int")
    got = articles.ranked_candidates(df, "p", "Acct", F.lit(1700000000), "at").collect()
    assert [(r.document_id, r.title, r.url, r.epoch) for r in got] == [("d1", "Title", "/link?url=x&y=1", 1757347200), ("d4", "T4", "/l4", 0)]
    assert [r.url for r in articles.mirror_links(df, "p", "Title").collect()] == ["/link?url=x&y=1"]


def test_pages(spark):
    page = '<meta property="og:title" content="A &amp; B"><meta name="description" content="d"><a id="js_name"> N <b>x</b></a><script>var biz = "" || "Mz==";var mid = 12; var oriCreateTime = \'1757347200\';</script>'
    m = spark.createDataFrame([(page,)], "p string").select(articles.article_meta("p").alias("m")).first().m
    assert (m.title, m.account, m.digest, m.biz, m.mid, m.create_time) == ("A & B", "N x", "d", "Mz==", "12", 1757347200)
    about = spark.createDataFrame([("<dl><dt>主体</dt><dd> X 公司 </dd></dl>",)], "p string").select(articles.about_fields("p", {"owner": "主体", "none": "无"}).alias("a")).first().a
    assert about[:] == ("X 公司", "")
    pages = {
        "url += 'https://a.b/s?x=1'; url += '\\x26y=2@';": "https://a.b/s?x=1&y=2@",
        "url += 'https://a.b/s?u=me@x.y&q=\\x41B'; url += '\\x3d1'": "https://a.b/s?u=me@x.y&q=AB=1",
        "myurl += 'no'; url+='a\\u0026\\uD83D\\uDE00'; url  += '\\'\\\\\\/\\q'": "a&\U0001f600'\\/\\q",
        "none": "",
    }
    got = spark.createDataFrame([(k,) for k in pages], "p string").select("p", articles.joined_redirect("p").alias("r")).collect()
    assert {r.p: r.r for r in got} == pages


def test_text_by_kind(spark):
    shape = "struct<title:string,item_show_type:int,content_noencode:string,is_pay_subscribe:int,text_page_info:struct<content_noencode:string,is_user_title:int>,pay_subscribe_info:struct<desc:string>>"
    rows = ['{"title":"T","item_show_type":0,"content_noencode":"<p>a &amp; b</p>"}', '{"title":"T","item_show_type":10,"text_page_info":{"content_noencode":"long text that goes on and on"}}', '{"title":"T","item_show_type":0,"is_pay_subscribe":1,"pay_subscribe_info":{"desc":"D"}}', '{"item_show_type":5}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string").select("k", articles.article_text(F.from_json("j", shape)).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["T\n\na & b", "long text that goes \n\nlong text that goes on and on", "T\n\n[付费文章]\nD", "(unknown)\n\n"]


def test_rows(spark):
    one = spark.createDataFrame([("b", None)], "fakeid string, title string")
    r = articles.article_rows(one, aid=F.lit("1_1")).first()
    assert (r.fakeid, r.title, r.aid, r.itemidx, r.is_deleted) == ("b", "", "1_1", 1, False)
    album = spark.createDataFrame([('{"getalbum_resp":{"article_list":{"title":"a"}}}',), ('{"getalbum_resp":{"article_list":[{"title":"a"},{"title":"b"}]}}',), ("x",)], "j string").select(F.size(articles.album_list("j")).alias("n"))
    assert sorted(r.n for r in album.collect()) == [0, 1, 2]
    docs = spark.createDataFrame([(["products", "x"], "active", "analysis"), (["x"], "active", "analysis")], "tags array<string>, status string, source_type string")
    assert docs.filter(articles.is_active_document("analysis")).count() == 1
    r = articles.mark_rejected(docs, F.array_contains("tags", "products"), "noise").filter("status = 'rejected'").first()
    assert r.tags == ["x", "rejected"] and r.reason == "noise"
    raw = spark.createDataFrame([('{"usefor":"app","accounts":[{"fakeid":"a","nickname":"n"},{"fakeid":""}]}',), ('{"usefor":"no","accounts":[{"fakeid":"b"}]}',)], "json string")
    assert [(x.fakeid, x.articles) for x in articles.import_accounts(raw, "app").collect()] == [("a", 0)]
    assert spark.range(1).select(articles.confidence(F.lit("X (韩国)")), articles.confidence(F.lit("可能 Y")), articles.confidence(F.lit("a/b"))).first()[:] == ("Confirmed", "Probable", "Strongly linked")
    legacy = spark.createDataFrame([("web-research", "profile", "X产品档案（公众号文章）", "公众号"), ("web-research", "profile", "X", "公众号")], "origin string, synthesis_type string, title string, content string")
    assert legacy.filter(articles.is_legacy_row()).count() == 1


def test_recovered(spark):
    base = "https://mp.weixin.qq.com/s?__biz=Mzg5MTcwMTI5Nw%3D%3D&mid=2247502242"
    biz = "Mzg5MTcwMTI5Nw=="
    entry = ("Example", "王董的新游戏", f"{base}&idx=1&sn=test#rd", "2025-09-09", 0)

    def rows(*changes, biz=biz, canonical=False):
        names = ("title", "account", "url", "publish_date", "mtime_ms")
        found = [tuple((dict(zip(names, entry, strict=True)) | c)[k] for k in names) for c in changes]
        df = spark.createDataFrame(found, "title string, account string, url string, publish_date string, mtime_ms long")
        return [(x.aid, x.itemidx, x.create_time, x.link) for x in articles.recovered(df, "王董的新游戏", biz, canonical).collect()]

    (aid, index, at, link), = rows({})
    assert (aid, index, at) == ("2247502242_1", 1, 1757347200) and "#rd" not in link
    assert rows({}, biz="wrong-biz") == []
    short = {"url": "https://mp.weixin.qq.com/s/short-token"}
    h = 0
    for c in short["url"]:
        h = (h * 31 + ord(c)) % 2**32
    assert [r[0] for r in rows(short, short)] == [f"local-{h}_1"] * 2 and rows(short, canonical=True) == []
    assert [r[0] for r in rows({"url": base}, {"url": f"{base}&idx=0"}, {"url": base.replace("mid=2247502242", "appmsgid=7&itemidx=3")})] == ["2247502242_1", "2247502242_1", "7_3"]
    assert rows({"url": base}, {"url": f"{base}&idx=0"}, {"url": base.replace("2247502242", "0") + "&idx=1"}, canonical=True) == []
    assert [r[0] for r in rows({"account": "历史名称"})] == ["2247502242_1"] and rows({"account": "历史名称"}, biz="wrong-biz") == []
    for day in ("", "2025/09/09", "2025-02-30"):
        assert rows({"publish_date": day, "mtime_ms": 1767196800000}, canonical=True) == []
        assert [r[2] for r in rows({"publish_date": day, "mtime_ms": 1767196800999})] == [1767196800]
    assert rows({"url": "http://mp.weixin.qq.com/s/a"}, {"url": "https://example.com/s/a"}, {"url": "https://mp.weixin.qq.com:8443/s/a"}) == []


def test_suffixed_paths_are_free(spark):
    digits = hashlib.sha1(b"u2").hexdigest()
    row = [("A", "T", "u1"), ("A", "T", "u2")]
    first = f"A/T--20260711-{digits[:8]}"
    assert plan(spark, row, [("z", "other"), (first, "else")])["u2"] == f"A/T--20260711-{digits[:12]}"
    held = [(f"A/T--20260711-{digits[:n]}", None) for n in paths.HASH_LENGTHS]
    assert plan(spark, row, held)["u2"] == f"A/T--20260711-{digits}-2"
    assert plan(spark, row, [*held, (f"A/T--20260711-{digits}-2", "else")])["u2"] == f"A/T--20260711-{digits}-3"
    assert plan(spark, [*row, ("A", f"T--20260711-{digits[:8]}", "u3")])["u2"] == f"A/T--20260711-{digits[:12]}"


def test_control(tmp_path):
    assert control.listed_files({"files": ["a", ["b"]], "x": "c"}) == ["a", "b"] and control.listed_files({"x": {"y": "c"}}) == ["c"]
    assert control.subject_filter('["A b!"]') == {"a b!", "a-b"} and control.subject_filter("X_z\n\ny") == {"x_z", "x-z", "y"}
    with pytest.raises(ValueError, match="."):
        control.subject_filter("[1")
    assert control.next_source(3, True)["action"] == "finish-local-partial" and control.next_source(0, True)["source"] == "complete" and control.next_source(-1, False)["records"] == 0
    now = datetime(2026, 1, 1, tzinfo=UTC)
    args = ("d", "s", {}, "g", {"created": 1}, {"pass": True})
    r = control.receipt(*args, hours=24, now=now)
    assert control.receipt_errors(r, *args, now=now) == [] and control.receipt_errors(r, *args, now=now + timedelta(days=2)) == ["receipt_expired"]
    assert control.receipt_errors(r | {"expires_at": "x"}, "e", *args[1:], now=now) == ["data_mismatch", "receipt_expiry_invalid"]
    state = tmp_path / "state.json"
    state.write_text("{}")
    before = control.snapshot(state)
    gate = dict.fromkeys(control.GATES, True)
    for g in control.GATES:
        assert control.publish(state, {"a": 1}, gate | {g: "yes"}, before) == [f"gate:{g}"] and state.read_text() == "{}"
    assert control.publish(state, {"a": 1}, gate, before) == [] and control.publish(state, {"a": 2}, gate, before) == ["state-changed"]


def test_positions_of_a_large_table(spark):
    """Every position once, also where ranges are drawn from a sample of the rows."""
    n = 3_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), "id").repartition(16)
    got = files.renumber(rows, "k").agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.bit_xor(F.xxhash64("k", "pos"))).first()
    assert got[:4] == (n, n, 0, n - 1)
    small = files.renumber(rows.filter("id < 1000"), "k").orderBy("pos").collect()
    assert [r.k for r in small] == sorted(r.k for r in small) and [r.pos for r in small] == list(range(1000))


def test_selectors(spark):
    page = """<div class="a b" id="x"><p data-k="one two">P <b>1</b></p><p>Q<script>no()</script></p></div><section><div><p class="a">R</p></div></section><img alt="i">"""
    want = {
        ("p", "text"): "P 1", ("p", "texts"): ["P 1", "Q", "R"], ("div.a.b#x p", "texts"): ["P 1", "Q"], (".a", "texts"): ["P 1Q", "R"], ("section p.a", "text"): "R", ("[data-k]", "@data-k"): "one two", ('p[data-k*="e t"]', "text"): "P 1",
        ('p[data-k^="two"]', "text"): "", ("p[data-k$=two]", "text"): "P 1", ("img", "full"): False, ("section", "full"): True, ("nav", "full"): False, ("section div", "html"): '<p class="a">R</p>', ("img", "@alt"): "i", ("#y", "@id"): "",
    }
    fields = {f"f{k}": select.Field(*f) for k, f in enumerate(want)}
    df = spark.createDataFrame([(page,), (None,), ("",)], "p string")
    got = [r.f for r in df.select(select.select_fields("p", fields).alias("f")).collect()]
    assert got[1] is None and list(got[0]) == list(want.values()) and got[2].f0 == "" and got[2].f1 == []
    for bad in ("a > b", "p:first", "[", "x!y"):
        with pytest.raises(ValueError, match="no selector"):
            select.select_fields("p", {"f": select.Field(bad)})


def test_call_arguments():
    source = r"""f('a\x26b'); // f('x')
    f /* c */ ( {k: [1, -2], s: htmlDecode('a&amp;b')} ) ; g.f(1); xf(2); f(); f(h()); f(3, 4); f([ ; f("last")"""
    assert html.call_arguments(source, "f") == ["a&b", "x", {"k": [1, -2], "s": "a&b"}, "last"]
    assert html.call_arguments("f({__proto__: 1})", "f") == [] and html.call_arguments("", "f") == [] and html.call_arguments("f(" * 3000, "f") == []


def test_verified_articles(spark):
    good = '<meta property="og:title" content="T"><b id="js_name">N</b><script>var biz = "M"; var mid = 5; var idx = 1; var oriCreateTime = "1700000000";</script><div id="js_content">x</div>'
    pages = {good: None, good.replace("x</div>", "</div>"): "incomplete", good.replace('"1700000000"', '"17"'): "incomplete", good.replace('"M"', '"Z"'): "account differs", good + "访问过于频繁": "withheld", good.replace(">N<", "> <"): "no title or account", "": "account differs"}
    df = spark.createDataFrame([(p,) for p in pages], "p string")
    got = df.select("p", articles.verified_article("p", F.lit("M"), F.lit("https://mp.weixin.qq.com/s/q?a=1#f")).alias("a")).collect()
    assert {r.p: r.a.reason for r in got} == pages
    one = next(r.a for r in got if r.p == good)
    assert (one.aid, one.account, one.title, one.canonical_link, one.link) == ("5_1", "N", "T", "https://mp.weixin.qq.com/s?__biz=M&mid=5&idx=1", "https://mp.weixin.qq.com/s/q?a=1")
