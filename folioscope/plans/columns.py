"""Queries over single values: dates, URLs, hashes, names, pages and rows as they are adapted, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import html, names, text, urls
from folioscope.operators import articles, blocks, paths
from folioscope.plans.catalog import NOW, load, query


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y/%m/%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN '  ' || strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%d.%m.%Y') ELSE '' END AS d FROM events)
SELECT event_id, CASE WHEN regexp_matches(d, '^\\s*\\d{4}[-/]\\d{2}[-/]\\d{2}') THEN replace(substr(trim(d), 1, 10), '/', '-') ELSE '' END AS day FROM x""")
def normal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    d = F.when(n == 0, F.date_format("ts", "yyyy/MM/dd")).when(n == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(n == 2, F.concat(F.lit("  "), F.date_format("ts", "yyyy-MM-dd"))).when(n == 3, F.date_format("ts", "dd.MM.yyyy")).otherwise("")
    return load(spark, sf_dir, "events").select("event_id", text.normal_date(d).alias("day"))


@query(f"""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id BETWEEN 1 AND {NOW} THEN event_id ELSE {NOW} - 366 * 86400 END
WHEN 1 THEN CASE WHEN epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) - 28800 <= {NOW} THEN epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) - 28800 ELSE {NOW} - 366 * 86400 END ELSE {NOW} - 366 * 86400 END AS BIGINT) AS floor FROM events""")
def floor_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    given = F.when(n == 0, F.col("event_id").cast("string")).when(n == 1, F.date_format("ts", "yyyy-MM-dd")).when(n == 2, "soon")
    return load(spark, sf_dir, "events").select("event_id", text.floor_epoch(given, F.lit(NOW).cast("long")).cast("long").alias("floor"))


@query("""WITH x AS (SELECT event_id, (event_id * 37) % 20000 AS s FROM events),
p AS (SELECT event_id, s, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS r FROM x)
SELECT event_id, CASE WHEN h > 0 THEN h || '小时' ELSE '' END || CASE WHEN m > 0 THEN m || '分' ELSE '' END || CASE WHEN r > 0 OR (h = 0 AND m = 0) THEN r || '秒' ELSE '' END AS elapsed,
CASE WHEN event_id % 2 = 0 THEN s ELSE s * 1000000 END // CASE WHEN event_id % 2 = 1 AND s * 1000000 > 10000000000 THEN 1000 ELSE 1 END AS seconds FROM p""")
def elapsed_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id") * 37 % 20000
    return load(spark, sf_dir, "events").select("event_id", text.format_elapsed(s).alias("elapsed"), text.seconds_from(F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000000)).alias("seconds"))


@query("""SELECT page_id, nullif(regexp_extract(split_part(url, '#', 1), '[?&]page=([^&]*)', 1), '') AS page,
regexp_matches(regexp_extract(url, '^https?://([^/?#]*)', 1), '(^|\\.)example\\.(com|org)$') AS allowed, contains(url, '/en/') AND regexp_matches(url, '^https') AS own FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = urls.path("url").contains("/en/") & (F.try_parse_url("url", F.lit("PROTOCOL")) == "https")
    return load(spark, sf_dir, "pages").select("page_id", urls.param("url", "page").alias("page"), urls.host_allowed("url", ("example.com", "example.org")).alias("allowed"), own.alias("own"))


@query("""WITH t AS (SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS t FROM pages),
h AS (SELECT page_id, list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(regexp_extract_all(t, '.', 0, 's'), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, u: (a * 31 + u) % 4294967296) AS h FROM t)
SELECT page_id, CASE WHEN h = 0 THEN 1 ELSE h END AS hash FROM h""")
def title_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.hash31(html.title("html")).alias("hash"))


@query("""WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN to_base64(encode(url)) WHEN 1 THEN to_base64(encode(url)) || '=' WHEN 2 THEN url ELSE regexp_replace(to_base64(encode(url)), '=+$', '') END AS b FROM pages)
SELECT page_id, regexp_full_match(b, '([A-Za-z0-9+/]{4})*(|[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)') AS canonical FROM x""")
def base64_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("page_id") % 4, F.base64(F.col("url").cast("binary"))
    form = F.when(n == 0, b).when(n == 1, F.concat(b, F.lit("="))).when(n == 2, F.col("url")).otherwise(F.regexp_replace(b, "=+$", ""))
    return load(spark, sf_dir, "pages").select("page_id", text.canonical_base64(form).alias("canonical"))


LABELS = ("**开发商**：", "- 发行商: ", "## 平台 ： ", "备注：", "产品名称：")


@query(f"""WITH x AS (SELECT doc_id, doc_id % 5 AS n, source, [{', '.join(f"'{x}'" for x in LABELS)}][CAST(doc_id % 5 + 1 AS INTEGER)] || ' **' || source || '** ' AS line FROM documents)
SELECT doc_id, CASE n WHEN 0 THEN 'developers' WHEN 1 THEN 'publishers' WHEN 2 THEN 'platforms' END AS field, CASE WHEN n < 3 THEN source END AS value,
CASE n WHEN 0 THEN '开发商： ' || source WHEN 1 THEN '发行商:  ' || source WHEN 2 THEN '平台 ：  ' || source WHEN 3 THEN '备注： ' || source ELSE '产品名称： ' || source END AS clean FROM x""")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 5).cast("int")
    line = F.concat(F.array(*[F.lit(x) for x in LABELS])[n], F.lit(" **"), F.col("source"), F.lit("** "))
    f = names.field_line(line)
    return load(spark, sf_dir, "documents").select("doc_id", f["key"].alias("field"), f["value"].alias("value"), names.clean_value(line).alias("clean"))


NAMED = ("1. Game {}    Some Studio Name", "**Game {}**", "### Game {}", "产品名称：Game {}", "Some Thing {}", "总结", "发行商：Firm {}", "第1章", "https://x.example/{}", "这个游戏{}可以通过玩家目前整体主要的。")


@query(f"""WITH x AS (SELECT doc_id, CAST(doc_id % {len(NAMED)} AS INTEGER) AS n, lang FROM documents)
SELECT doc_id, CASE WHEN n < 4 THEN 'Game ' || lang WHEN n = 4 THEN 'Some Thing ' || lang END AS name, CASE WHEN n = 0 THEN 'Some Studio Name' END AS publisher, n IN (0, 5, 6, 7) AS heading, n IN (2, 3, 4) AS plausible FROM x""")
def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % len(NAMED)).cast("int")
    line = F.replace(F.array(*[F.lit(x) for x in NAMED])[n], F.lit("{}"), F.col("lang"))
    rows = load(spark, sf_dir, "documents").select("doc_id", names.candidate(line).alias("c"), names.is_heading(F.when(n == 6, "发行商").otherwise(line)).alias("heading"), F.when(n == 3, F.lit("Game x")).otherwise(line).alias("l"), n.alias("n"))
    return rows.select("doc_id", "c.name", "c.publisher", "heading", (names.is_plausible("l") & F.col("n").isin(2, 3, 4)).alias("plausible"))


@query("""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<img\\s[^>]*?(?:data-)?src=["'']([^"'']+)["'']', 1, 'i')) AS u FROM pages
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<link\\s[^>]*?href=["'']([^"'']+\\.css[^"'']*)["'']', 1, 'i')) FROM pages
UNION ALL SELECT page_id, 'https://cdn.example/' || page_id % 7 || '.css' FROM pages UNION ALL SELECT page_id, 'https://cdn.example/x.png?a=1&b=' || page_id % 3 FROM pages)
SELECT DISTINCT page_id, replace(u, '&amp;', '&') AS resource FROM i""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat(F.lit('<link rel="x" href="https://cdn.example/'), F.col("page_id") % 7, F.lit('.css"><img alt="" data-src="https://cdn.example/x.png?a=1&amp;b='), F.col("page_id") % 3, F.lit('">'))
    return load(spark, sf_dir, "pages").select("page_id", F.explode(html.resources(F.concat("html", more))).alias("resource"))


@query("""SELECT page_id, regexp_extract(html, 'var t="([^"]*)"', 1) AS t, '{"n": ' || page_id || ', "s": "a"}' AS data, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS comment_id FROM pages""")
def script_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("<script>window.__data = {n: "), F.col("page_id"), F.lit(", 's': 'a',}; window.comment_id = '"), F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise(""), F.lit("'</script>"))
    return load(spark, sf_dir, "pages").select("page_id", html.assigned("html", "t").alias("t"), html.html_script_value(F.concat("html", own), "window.__data").alias("data"), html.comment_id(own).alias("comment_id"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || chr(10) || chr(10) || 'a & b ' || lang WHEN 1 THEN source || chr(10) || chr(10) || lang || '<b>' WHEN 2 THEN source || chr(10) || chr(10) || 'told ' || lang
WHEN 3 THEN source || chr(10) || chr(10) || '[付费文章]' || chr(10) || 'paid ' || lang ELSE '(unknown)' || chr(10) || chr(10) END AS text FROM documents""")
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    content = F.when(n == 0, F.concat(F.lit("<p>a &amp; b <i>"), "lang", F.lit("</i></p>"))).when(n == 1, F.concat("lang", F.lit("<b>"))).otherwise("")
    row = F.struct(
        F.col("source").alias("title"), F.when(n == 0, 0).when(n == 1, 8).when(n == 2, 10).when(n == 3, 0).otherwise(5).alias("item_show_type"), content.alias("content_noencode"), F.when(n == 3, 1).otherwise(0).alias("is_pay_subscribe"),
        F.struct(F.concat(F.lit("told "), "lang").alias("content_noencode"), F.lit(1).alias("is_user_title")).alias("text_page_info"), F.struct(F.concat(F.lit("paid "), "lang").alias("desc")).alias("pay_subscribe_info"),
    )
    return load(spark, sf_dir, "documents").select("doc_id", articles.article_text(row).alias("text"))


@query("""SELECT doc_id, source AS title, 'https://a.b/' || doc_id || '?x=''y''' AS url, CASE WHEN doc_id % 2 = 0 THEN lang END AS account FROM documents""")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("account: '"), "lang", F.lit("'\r\n"))).otherwise("account:\n")
    page = F.concat(F.lit('---\ntitle: "'), "source", F.lit('"\nurl:   https://a.b/'), "doc_id", F.lit("?x='y'\n"), account, F.lit("---\ntitle: none\n"), "text")
    return load(spark, sf_dir, "documents").select("doc_id", *[blocks.frontmatter(page, k).alias(k) for k in ("title", "url", "account")])


@query("""SELECT doc_id, 'https://a.b/s?x=' || doc_id || '&y=me@' || lang || '''中\\n=z' AS url, CASE WHEN doc_id % 4 = 0 THEN 'Confirmed' WHEN doc_id % 4 = 1 THEN 'Probable' ELSE 'Strongly linked' END AS confidence,
CASE doc_id % 4 WHEN 0 THEN '韩国' WHEN 1 THEN '芬兰' WHEN 2 THEN '可能香港/中国' ELSE '未知' END AS region, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN false END AS domestic FROM documents""")
def redirects_and_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    page = F.concat(F.lit("url += 'https://a.b/s?x='; url += '"), "doc_id", F.lit("\\x26y=me@'; url += '"), "lang", F.lit("\\'\\u4e2d\\\\n\\x3d'; url+='z';"))
    entity = F.when(n == 0, "X (韩国)").when(n == 1, "可能 Y").when(n == 2, "a/b").otherwise("Z")
    r = text.region(F.when(n == 0, "Wemade Co").when(n == 1, "Rovio Oy").when(n == 2, "Some Holdings").otherwise("Zed"))
    return load(spark, sf_dir, "documents").select("doc_id", articles.joined_redirect(page).alias("url"), articles.confidence(entity).alias("confidence"), r["region"].alias("region"), r["domestic"].alias("domestic"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":' || coalesce('"' || nullif(source, 'src1') || '"', 'null') || '}') AS content_hash,
CASE WHEN lang = source THEN lang ELSE lang || '|' || source END AS held, CAST(lang || '_' || CASE WHEN source IS NULL THEN '' ELSE source END || '/2024-01/' || doc_id AS VARCHAR) AS folder FROM documents""")
def hashes_and_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = text.distinct_filled(F.array("lang", F.concat(F.lit("  "), "lang"), F.lit(""), "source", F.lit(None).cast("string"), F.concat("source", F.lit("\t"))))
    folder = paths.from_template("${account}_${title}/${YYYY}-${MM}/${aid}", F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.lit(NOW))
    hashed = docs.withColumn("source", F.nullif("source", F.lit("src1"))).select("doc_id", "n_chars", "lang", "source").select("doc_id", text.content_hash("source", "n_chars", "lang", "doc_id").alias("content_hash"))
    return hashed.join(docs.select("doc_id", F.array_join(held, "|").alias("held"), folder.alias("folder")), "doc_id")


@query(f"""SELECT doc_id, source = 'src1' AND (n_chars % 3 = 0 OR {NOW} - n_chars * 100 >= {NOW} - 86400) AS wanted, source = 'src1' OR doc_id % 3 = 0 AS own, doc_id % 4 = 0 AS legacy, doc_id % 2 = 0 AND doc_id % 5 <> 0 AS active,
doc_id % 3 = 0 AND lang = 'en' AS in_scope, doc_id % 2 = 0 OR length(lang) < 2 AS noise_old FROM documents""")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    epoch = F.when(F.col("n_chars") % 3 == 0, F.lit(0).cast("long")).otherwise(NOW - F.col("n_chars") * 100)
    url = F.when(i % 3 == 0, "https://h/s?__biz=B&x=1").when(i % 3 == 1, "https://h/s").otherwise("none")
    file = F.when(i % 3 == 0, F.concat(F.lit("/r/"), "lang", F.lit("/t/index.md"))).when(i % 3 == 1, F.concat(F.lit("/r/"), "lang", F.lit("/_t/index.md"))).otherwise(F.concat(F.lit("/q/"), "lang", F.lit("/t/index.md")))
    docs = load(spark, sf_dir, "documents").withColumns({
        "origin": F.lit("web-research"), "synthesis_type": F.lit("profile"), "title": F.when(i % 2 == 0, "X产品档案（公众号文章）").otherwise("X"), "content": F.when(i % 4 == 0, "来自公众号").otherwise(F.lit(None).cast("string")),
        "source_type": F.lit("a"), "status": F.when(i % 5 == 0, "rejected").otherwise(F.lit(None).cast("string")), "tags": F.when(i % 2 == 0, F.array(F.lit("products"))).otherwise(F.lit(None).cast("array<string>")),
    })
    return docs.select(
        "doc_id", articles.wanted_candidate(F.col("source"), "src1", epoch, F.lit(NOW - 86400)).alias("wanted"), articles.of_account(F.col("source"), url, "src1", "B").alias("own"), articles.is_legacy_row().alias("legacy"),
        articles.is_active_document("a").alias("active"), paths.in_scope(file, "/r", ["en"]).alias("in_scope"), names.is_noise_old(F.when(i % 2 == 0, F.concat("lang", F.lit("的"))).otherwise(F.col("lang"))).alias("noise_old"),
    )


@query("""SELECT doc_id, lang AS fakeid, '' AS title, doc_id || '_1' AS aid, 1 AS itemidx, coalesce(n_chars, 0) AS create_time, CAST(0 AS BIGINT) AS update_time, false AS is_deleted, '' AS _status,
CASE WHEN doc_id % 3 = 0 THEN n_chars WHEN doc_id % 3 = 1 THEN doc_id ELSE CAST(0 AS BIGINT) END AS read_num FROM documents""")
def article_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    first, second = (F.from_json(x, "read_num string") for x in (F.when(i % 3 == 0, F.concat(F.lit('{"read_num": "'), "n_chars", F.lit('"}'))).otherwise("{}"), F.lit('{"other": 1}')))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fakeid"), F.col("n_chars").alias("create_time"), articles.first_metadata(first, second, old=F.when(i % 3 == 1, i), field="read_num").alias("read_num"))
    rows = articles.article_rows(docs.withColumn("link", i.cast("string")), aid=F.concat(i.cast("string"), F.lit("_1")))
    return rows.select(F.col("link").cast("long").alias("doc_id"), "fakeid", "title", "aid", "itemidx", "create_time", "update_time", "is_deleted", "_status").join(docs.select("doc_id", "read_num"), "doc_id")


@query("""SELECT doc_id, list_contains(['package', 'play', 'apple'], CASE doc_id % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'play' WHEN 2 THEN 'apple' ELSE '' END) AS known,
CASE doc_id % 4 WHEN 0 THEN 'com.' || lang WHEN 1 THEN 'app.' || doc_id WHEN 2 THEN 'app-store:' || (doc_id + 1) ELSE '' END AS identity FROM documents""")
def store_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    links = F.array(F.lit("https://x.example/?id=no"), F.when(i % 4 == 1, F.concat(F.lit("https://play.google.com/store/apps/details?id=APP."), i)).when(i % 4 == 2, F.concat(F.lit("https://apps.apple.com/us/app/x/id"), i + 1)).otherwise("https://play.google.com.evil.example/?id=y"))
    found = urls.store_identity(links, F.when(i % 4 == 0, F.concat(F.lit(" COM."), "lang")).otherwise(F.lit(None).cast("string")))
    return load(spark, sf_dir, "documents").select("doc_id", (found != "").alias("known"), found.alias("identity"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '未知' WHEN 1 THEN source ELSE CASE WHEN source = lang THEN source ELSE '冲突待审' END END AS publisher, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE lang || '|' || source END AS parts,
CASE WHEN regexp_matches(text, '(?i)apache') THEN 'Apache' WHEN contains(lower(text), 'the') THEN 'The' END AS detected FROM documents""")
def publisher_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    found = names.publishers_of(F.when(i % 3 == 0, " ").when(i % 3 == 1, F.concat(F.lit("- **"), "source", F.lit("**"))).otherwise(F.concat("lang", F.lit("、 "), "source", F.lit(";"))), [("^nobody$", "Nobody")])
    return load(spark, sf_dir, "documents").select("doc_id", names.resolve(found).alias("publisher"), F.array_join(found, "|").alias("parts"), names.detect("text", [("(?i)apache", "Apache")], {"the": "The"}).alias("detected"))


@query("""SELECT doc_id, source || chr(10) || lang || ' & bold go' || chr(10) || 'one' || chr(10) || doc_id || chr(10) || 'end' AS text,
'<h1>' || source || '</h1><p>' || lang || ' &amp; <b>bold</b> <a href="https://a.b/' || doc_id || '">go</a></p><style>p{}</style><ul><li>one</li><li>' || doc_id || '</li></ul><img src="https://i/1" alt="pic"><p>end</p>' AS clean,
'# ' || source || chr(10) || chr(10) || lang || ' & **bold** [go](https://a.b/' || doc_id || ')' || chr(10) || chr(10) || '-   one' || chr(10) || '-   ' || doc_id || chr(10) || chr(10) || '![pic](https://i/1)' || chr(10) || chr(10) || 'end' AS markdown FROM documents""")
def html_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    page = F.concat(
        F.lit("<script>x('</p>')</script><h1>"), "source", F.lit("</h1><p>"), "lang", F.lit(' &amp; <b>bold</b> <a href="https://a.b/'), i, F.lit('" onclick="x()">go</a></p><style>p{}</style><ul><li>one</li><li>'),
        i, F.lit('</li></ul><img src="https://i/1" alt="pic"><p>end</p>'),
    )
    return load(spark, sf_dir, "documents").select("doc_id", html.html_text(page).alias("text"), html.html_clean(page).alias("clean"), html.html_markdown(page).alias("markdown"))
