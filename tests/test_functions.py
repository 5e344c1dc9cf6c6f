"""Golden cases of functions and rules."""

import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import html, names, text, urls

SITE = "mp.weixin.qq.com"


@pytest.fixture(scope="module")
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("x")).first().x

    return of


def test_dates(value):
    assert value(text.publish_epoch(F.lit("2025-09-09"))) == 1757347200
    for bad in ("", "2025/09/09", "2025-02-30", None):
        assert value(text.publish_epoch(F.lit(bad).cast("string"))) is None
    assert value(text.date_slug(F.lit("2026年7月11日"))) == "20260711"
    assert value(text.date_slug(F.lit("x"))) == ""
    assert value(text.normal_date(F.lit("2025/01/02 10:00"))) == "2025-01-02"
    assert value(text.seconds_from(F.lit(1757347200123))) == 1757347200
    assert value(text.floor_epoch(F.lit("2025-09-09"), F.lit(1800000000))) == 1757347200
    assert value(text.floor_epoch(F.lit("99999999999"), F.lit(1800000000))) == 1800000000 - 366 * 86400


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_of_a_time_without_zone(spark, value, zone):
    times = {
        "2024-01-05 00:00:00.999499": 1704412800, "2024-01-05 00:00:00.9995": 1704412801, "2024-03-10 02:30:00.1": 1710037800, "2024-11-03 01:30:00": 1730597400,
        "1969-12-31 23:59:59.9995": 0, "1969-12-31 23:59:58.2": -1, "1969-12-31 23:59:57.9995": -2,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert {t: value(text.epoch_of(F.lit(t).cast("timestamp_ntz"))) for t in times} == times
        assert value(text.epoch_of(F.lit(None).cast("timestamp_ntz"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_identity(value):
    short = f"https://{SITE}/s/short-token"
    assert value(text.hash31(F.lit(short))) == 1606272576
    assert value(urls.aid_of(F.lit(short))) == "local-1606272576_1"
    full = f"http://{SITE}/s?__biz=MzA%3D&mid=2247502242&idx=1&sn=ab&chksm=q&scene=1#rd"
    assert value(urls.aid_of(F.lit(full))) == "2247502242_1"
    assert value(urls.canonical(F.lit(full), urls.IDENTITY_KEYS, https=True)) == f"https://{SITE}/s?__biz=MzA%3D&idx=1&mid=2247502242&sn=ab"
    assert value(urls.stable_identity(F.lit(full), SITE)) == "MzA=:2247502242:1"
    for bad in (full.replace("mid=2247502242", "mid=0"), full.replace("idx=1", "idx=0"), full.replace(SITE, "example.org"), "no url"):
        assert value(urls.stable_identity(F.lit(bad), SITE)) is None
    assert value(urls.message_of(F.lit("100_2"))) == "100" and value(urls.message_of(F.lit("_2"))) == "_2"
    assert value(F.left(F.sha2(F.lit("MzkyMDcyNTEyNA=="), 256), F.lit(20))) == "98358f377fae9cfdde83"
    assert value(text.canonical_base64(F.lit("MzkyMDcyNTEyNA=="))) and not value(text.canonical_base64(F.lit("MzkyMDcyNTEyNA")))
    links = F.array(F.lit("https://apps.apple.com/us/app/x/id123?l=en"), F.lit("https://play.google.com/store/apps/details?id=com.A.b"))
    assert value(urls.store_identity(links, F.lit(""))) == "com.a.b" and value(urls.store_identity(links, F.lit("Own.Id"))) == "own.id"
    assert value(urls.store_identity(F.slice(links, 1, 1), F.lit(None).cast("string"))) == "app-store:123"


def test_text(value):
    assert value(text.collapse(F.lit("  a  b　\n c﻿"))) == "a b c"
    assert value(text.title_key(F.lit("Ａ　b"))) == "A b" and value(text.relaxed_title_key(F.lit("Ａ！b-C 《d》"))) == "abcd"
    assert value(text.path_segment(F.lit("A/B\x01 c"), "none", 80)) == "A-B- c" and value(text.path_segment(F.lit(" "), "none", 80)) == "none"
    assert value(text.duration_seconds(F.lit("3:07"))) == 187 and value(text.duration_seconds(F.lit("1:02:03"))) == 62 and value(text.duration_seconds(F.lit(""))) == 0
    assert value(text.format_elapsed(F.lit(3723))) == "1小时2分3秒" and value(text.format_elapsed(F.lit(0))) == "0秒"
    assert value(text.item_type(F.lit(5))) == "视频分享" and value(text.item_type(F.lit(99))) == "未识别"
    assert value(text.slug(F.lit(" Héllo,  World_游戏! "))) == "héllo-world-游戏" and value(text.short_slug(F.lit("Merge Go! 2"))) == "merge-go-2"
    assert value(text.format_bytes(F.lit(1536))) == "1.50 KB"
    assert value(text.region(F.lit("Foo Oyun A.S."))["region"]) == "土耳其" and value(text.region(F.lit("xyz"))["region"]) == "未知"
    red = value(text.redact(F.lit("https://x.y/?a=1&access_token=abc&monkey=2 Cookie: q; {\"password\": \"p q\"}")))
    assert red == 'https://x.y/?a=1&access_token=[REDACTED]&monkey=2 Cookie: [REDACTED] {"password": "[REDACTED]"}'
    assert value(text.distinct_filled(F.array(F.lit(" b"), F.lit("a"), F.lit(""), F.lit("b")))) == ["b", "a"]


def test_names(value):
    for good in ("合成大西瓜", "Merge Go!", "天天酷跑"):
        assert not value(names.is_noise(F.lit(good)))
    for bad in ("发行商：某某", "SLG 类", "x", "玩家可以", "这是一个句子。", "本期提到的用户更追求"):
        assert value(names.is_noise(F.lit(bad)))
    assert value(names.is_noise_old(F.lit("我的世界"))) and not value(names.is_noise(F.lit("我的世界")))
    assert value(names.suspicious(F.lit("亮点"))) == ["chapter_heading"] and value(names.suspicious(F.lit("Merge Go!"))) == []
    assert value(names.suspicious(F.lit("平台：iOS"))) == ["metadata_label"]
    c = lambda s: value(names.candidate(F.lit(s)))
    assert tuple(c("Merge Mansion   Metacore")) == ("Merge Mansion", "Metacore") and tuple(c("3\\. 合成庄园　　某公司")) == ("合成庄园", "某公司")
    assert c("**Merge Go!**").name == "Merge Go!" and c("### Royal Match").name == "Royal Match" and c("游戏名字：地铁跑酷").name == "地铁跑酷"
    assert c("## SLG类") is None and c("发行商：某某") is None and c("a plain sentence of words") is None and c("") is None
    rules = [("[Ss]upercell", "Supercell"), ("IGG", "IGG")]
    assert value(names.publishers_of(F.lit("made by supercell"), rules)) == ["Supercell"] and value(names.publishers_of(F.lit("甲、乙"), rules)) == ["甲", "乙"]
    assert value(names.detect(F.lit("IGG and Supercell"), rules)) == "Supercell" and value(names.detect(F.lit("habby!"), rules, {"Habby": "H"})) == "H"
    assert value(names.resolve(F.array().cast("array<string>"))) == "未知" and value(names.resolve(F.array(F.lit("a"), F.lit("b")))) == "冲突待审"


def test_html():
    assert html.to_markdown("<ul><li>x</li><li>y <em>z</em></li></ul>") == "-   x\n-   y *z*"
    assert html.to_markdown("<h2>T</h2><p>a <b>b</b> <a href='https://x.y'>c</a></p><pre>q\n r</pre>") == "## T\n\na **b** [c](https://x.y)\n\n```\nq\n r\n```"
    assert html.to_markdown("<table><tr onclick='x'><td>1</td></tr></table>") == "<table><tr><td>1</td></tr></table>"
    assert html.sanitise('<p onclick="x" style="a">t<script>bad()</script><a href=" java\nscript:x">l</a><img data-src="https://i/1"></p>') == '<p style="a">t<a>l</a><img data-src="https://i/1" src="https://i/1"></p>'
    page = html.sanitise("""<body><script>probe = true</script><a href="java\nscript:alert(1)" onclick="alert(1)">bad</a><img src="https://i.example/safe.png" onerror="alert(1)">
      <iframe src="https://v.example/player" srcdoc="<script>alert(1)</script>" allow="camera"></iframe><svg><a xlink:href="javascript:x">s</a></svg><img srcset="javascript:x"><img src="data:image/png;base64,x"><a href="data:image/png;base64,x">d</a>
      <form action="vbscript:x"><input name="n"></form><svg><style><img src=x onerror=y></style><animate attributeName="href" to="javascript:x"/></svg><noscript><p title="</noscript><img src=x onerror=y>">n</p></noscript></body>""")
    assert not re.search(r"<script|onclick|srcdoc|javascript:|vbscript:|allow=|<animate|<img src=x|<a href", page)
    assert 'src="https://i.example/safe.png"' in page and '<iframe src="https://v.example/player" sandbox="" referrerpolicy="no-referrer">' in page and '<input name="n">' in page and 'src="data:image/png;base64,x"' in page
    told = html.to_markdown("""<html><head><title>noise title</title><style>body { color: red; }</style></head><body><article><h1>H</h1><p>B</p><table><tbody><tr><td>C</td></tr></tbody></table></article>
      <div class="layout __bottom-bar__"><img src="data:image/svg+xml;base64,NOISE">read</div><div id="content_bottom_area">say</div><div id="js_article_bottom_bar">more</div></body></html>""")
    assert told == "# H\n\nB\n\n<table><tbody><tr><td>C</td></tr></tbody></table>"
    told = html.to_markdown("""<table onclick="steal()" style="background:url(https://tracker.test)"><tbody><tr><td onmouseover="steal()">safe<script>steal()</script><img src="javascript:steal()" onerror="steal()" alt="cover">
      <a href="javascript:steal()">link</a><div class="__bottom-bar__">bar</div></td></tr></tbody></table>""")
    assert "<table>" in told and "safe" in told and 'alt="cover"' in told and not re.search("steal|javascript:|onerror|style=|tracker|bar", told)
    told = html.to_markdown("""<table><tr><td><img src="images/001.png"><img src="../images/002.png"><img src="data:image/png;base64,iVBORw0KGgo="><img src="data:image/svg+xml;base64,PHN2Zz4="><a href="./details/page.html">d</a></td></tr></table><img src="data:image/svg+xml;base64,PHN2Zz4=">""")
    assert all(f'src="{x}"' in told for x in ("images/001.png", "../images/002.png", "data:image/png;base64,iVBORw0KGgo=")) and 'href="./details/page.html"' in told and "svg" not in told
    assert html.to_text("<div>a<script>x</script><p>b   c</p>d<br>e</div>") == "a\nb c\nd\ne"
    page = r"<script>window.cgiDataNew = {a: JsDecode('A\x26B'), 'n': '42' * 1, list: [1, -2.5, !0], q: {z: null}};</script>"
    assert html.script_value(page, "cgiDataNew") == '{"a": "A&B", "n": 42, "list": [1, -2.5, true], "q": {"z": null}}'
    for bad in ("x = alert('1')", "x = {__proto__: 1}", "x = {a: window.y}", "x = " + "[" * 500, "y = 1"):
        assert html.script_value(bad, "x") is None


def test_html_columns(value):
    assert value(html.comment_id(F.lit("var comment_id = '17' || '0';"))) == "17" and value(html.comment_id(F.lit("comment_id: JsDecode('9')"))) == "9" and value(html.comment_id(F.lit(""))) is None
    assert value(html.assigned(F.lit('var biz = "" || "Mz=="; var mid = 12;'), "biz")) == "Mz==" and value(html.assigned(F.lit("var mid = 12;"), "mid")) == "12"
    src = "<img data-src='https://i/1?a=1&amp;b=2'><link href=\"/s.css\"><p style=\"background: url('/b.png')\"><img src='https://i/1?a=1&amp;b=2'>"
    assert value(html.resources(F.lit(src))) == ["https://i/1?a=1&b=2", "/s.css", "/b.png"]
    assert value(html.html_script_value(F.lit("var x = [1,2]"), "x")) == "[1, 2]"
    assert value(html.content_status(F.lit("a gone b"), "body", "gone", "err")) == "Deleted"


def test_clean_values_are_trimmed_as_by_patterns(spark):
    ends = [*names.WHITE, "​", "᠎", "*", "`", "- ", "## ", "**", "__", "_**_", "\r\n", " *", ""]
    rows = spark.createDataFrame([(f"{a}{b}x y{a}z{b}{a}",) for a in ends for b in ends], "t string")
    s = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\s*[-+*]\s+", ""), r"^#{1,6}\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\*\*|__", ""), r"(?U)^\s+|\s+$", "")
    assert rows.filter(names.clean_value("t") != F.regexp_replace(s, r"^[*` \t]+|[*` \t]+$", "")).count() == 0
