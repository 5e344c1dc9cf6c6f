"""Queries over rows that arrive, are linked, looked up and rolled up, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioscope.functions import aliases, names, render, text
from folioscope.operators import articles, blocks, extractors, ingest, linkage, lookups, merged, paths, publishing, quality, records
from folioscope.plans.catalog import load, query
from folioscope.session import shared_folder


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


@query("""WITH d AS (SELECT * FROM documents), a AS (
SELECT doc_id, 0 AS k, 'https://h.example/s?mid=' || doc_id || '&idx=1' AS link, source AS title, n_chars AS t FROM d WHERE doc_id % 5 <> 4
UNION ALL SELECT doc_id, 1, 'https://h.example/s?mid=' || doc_id % 50 || '&idx=2', lang, n_chars FROM d WHERE doc_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY doc_id DESC, k DESC) AS n, min(doc_id) OVER (PARTITION BY link) AS first FROM a)
SELECT regexp_extract(link, 'mid=(\\d+)', 1) || '_' || regexp_extract(link, 'idx=(\\d+)', 1) AS aid, link, title, t AS create_time, first FROM r WHERE n = 1""")
def messages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    item = '{"title":"%s","content_url":"https://h.example/s?mid=%s&amp;idx=%d","del_flag":%s}'
    primary = F.format_string(item % ("%s", "%s", 1, "%d"), F.col("source"), i, F.when(F.col("doc_id") % 5 == 4, 4).otherwise(0))
    child = F.when(F.col("doc_id") % 3 == 0, F.format_string(item % ("%s", "%s", 2, "0"), F.col("lang"), (F.col("doc_id") % 50).cast("string"))).otherwise('{"content_url":"","del_flag":0}')
    foreign = F.lit('{"content_url":"https://other.test/s?mid=1","del_flag":0}')
    body = F.concat(F.lit('{"list":[{"comm_msg_info":{"datetime":'), F.col("n_chars").cast("string"), F.lit('},"app_msg_ext_info":'), F.expr("substr(p, 1, length(p) - 1)"), F.lit(',"multi_app_msg_item_list":['), F.col("c"), F.lit(","), foreign, F.lit("]}}]}"))
    pages = doc(spark, sf_dir).withColumns({"p": primary, "c": child}).select(F.col("doc_id").alias("seq"), body.alias("general_msg_list"))
    found = ingest.messages(pages, "seq", hosts=("h.example",))
    return found.select("aid", "link", "title", "create_time", F.col("place.__i").alias("first"))


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(CAST(turn AS VARCHAR), ',' ORDER BY length(text), turn) ELSE string_agg('e' || turn, ',' ORDER BY turn) END AS replies FROM conversations GROUP BY conv_id""")
def reply_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.char_length("text").cast("long").alias("create_time"), F.col("turn").cast("string").alias("id"))
    other = F.struct(F.col("turn").alias("create_time"), F.concat(F.lit("e"), F.col("turn")).alias("id"))

    def by_turn(x: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("o"), x.alias("x")))), lambda s: s["x"])

    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(by_turn(one).alias("stored"), by_turn(other).alias("embedded"))
    stored = F.when(F.col("conv_id") % 2 == 0, F.col("stored"))
    return rows.select("conv_id", F.array_join(F.transform(ingest.replies_or_embedded(stored, F.col("embedded")), lambda r: r["id"]), ",").alias("replies"))


@query("""WITH RECURSIVE n AS (SELECT doc_id, lang, n_chars % 200 AS key, 'u' || doc_id * 7 % 300 AS link FROM documents WHERE doc_id % 10 <> 0), s AS (SELECT n_chars % 200 AS key, 'u' || doc_id * 7 % 300 AS link FROM documents WHERE doc_id % 50 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM n WHERE key NOT IN (SELECT key FROM s) AND link NOT IN (SELECT link FROM s)),
w AS (SELECT lang, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, false AS kept, CAST([] AS BIGINT[]) AS keys, CAST([] AS VARCHAR[]) AS links FROM f GROUP BY lang
UNION ALL SELECT lang, i, doc_id, ok, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, CASE WHEN ok THEN list_append(links, link) ELSE links END
FROM (SELECT f.*, w.keys, w.links, NOT list_contains(w.keys, f.key) AND NOT list_contains(w.links, f.link) AS ok FROM w JOIN f ON f.lang = w.lang AND f.i = w.i + 1))
SELECT doc_id, lang FROM w WHERE kept""")
def recoverable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).select("doc_id", "lang", (F.col("n_chars") % 200).alias("key"), F.concat(F.lit("u"), F.col("doc_id") * 7 % 300).alias("link"))
    return records.recover(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 50 = 0"), "lang", "key", "link", "doc_id").select("doc_id", "lang")


@query("""WITH c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations),
p AS (SELECT *, turn < m OR conv_id % 7 = 2 AS more FROM c WHERE NOT (conv_id % 5 = 1 AND turn = 2))
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 AND turn > 2 THEN NULL ELSE turn END AS place,
CASE WHEN conv_id % 5 = 1 AND turn > 2 THEN 'unreached' WHEN conv_id % 5 = 1 AND turn = 1 AND m >= 2 THEN 'broken' WHEN turn = m AND conv_id % 7 = 2 THEN CASE WHEN m = 0 OR conv_id % 5 = 1 AND m = 2 THEN 'broken' ELSE 'loop' END END AS reason FROM p""")
def comment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    c = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("m")), "conv_id").filter("NOT (conv_id % 5 = 1 AND turn = 2)")
    cursor = lambda t: F.when(t == 0, "").otherwise(F.concat(F.lit("b"), t))
    last = F.col("turn") == F.col("m")
    following = F.when(last & (F.col("conv_id") % 7 == 2), F.lit("b1")).otherwise(cursor(F.col("turn") + 1))
    pages = c.select("conv_id", "turn", cursor(F.col("turn")).alias("buffer"), following.alias("next_buffer"), (~last | (F.col("conv_id") % 7 == 2)).alias("continue_flag"))
    return ingest.pages_in_order(pages, "conv_id").select("conv_id", "turn", "place", "reason")


@query("""SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [source] WHEN 1 THEN [source, lang] ELSE [] END) AS title FROM documents""")
def album_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (F.format_string('{"title":"%s"}', F.col(c)) for c in ("source", "lang"))
    held = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))).otherwise("7")
    raw = F.concat(F.lit('{"getalbum_resp":{"article_list":'), held, F.lit("}}"))
    return doc(spark, sf_dir).select("doc_id", F.explode(articles.album_list(raw)).alias("a")).select("doc_id", "a.title")


@query("""SELECT DISTINCT lang || doc_id % 40 AS fakeid, CAST(0 AS BIGINT) AS articles, false AS completed FROM documents WHERE doc_id % 3 <> 2""")
def imported_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.concat("lang", F.col("doc_id") % 40)
    body = F.format_string('{"usefor":"%s","accounts":[{"fakeid":"%s","nickname":"n"},{"fakeid":""}]}', F.when(F.col("doc_id") % 3 == 2, "other").otherwise("app"), account)
    return articles.import_accounts(doc(spark, sf_dir).select(body.alias("json")), "app").select("fakeid", "articles", "completed")


PAGE = '<ul><li d="%s"><h3><a href="/l?u=%s&amp;v=1"><em>%s</em> &amp; x</a></h3><span class="all-time-y2">%s</span><script>timeConvert(\'%s\')</script></li><li><h3>none</h3></li></ul>'


@query("""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'd' || doc_id ELSE 'e' || doc_id % 40 END AS document_id, source || ' & x' AS title, n_chars % 100 + 450 AS epoch FROM documents WHERE lang = 'en' AND n_chars % 100 >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, CASE WHEN document_id = '' THEN title || '/' || epoch END ORDER BY doc_id DESC) AS n FROM h)
SELECT document_id, title, '/l?u=' || doc_id || '&v=1' AS url, epoch FROM r WHERE n = 1 ORDER BY epoch DESC, doc_id LIMIT 300""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    document = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("d"), i)).otherwise(F.concat(F.lit("e"), F.col("doc_id") % 40))
    pages = doc(spark, sf_dir).select("doc_id", F.format_string(PAGE, document, i, F.col("source"), F.col("lang"), F.col("n_chars") % 100 + 450).alias("page"))
    return articles.ranked_candidates(pages, "page", "en", F.lit(500), "doc_id").select("document_id", "title", "url", "epoch")


@query("""SELECT '/l?u=' || doc_id || '&v=1' AS url FROM documents WHERE source = 'src3' ORDER BY url LIMIT 5""")
def mirror_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    pages = doc(spark, sf_dir).select(F.format_string('<a href="/l?u=%s&amp;v=1"> <b>%s</b></a><a href="/x">%s x</a>', i, F.col("source"), F.col("source")).alias("page"))
    return articles.mirror_links(pages, "page", "src3")


@query("""SELECT doc_id, source || ' Ltd' AS owner, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS place FROM documents""")
def about_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<dt>地区：</dt><dd>"), "lang", F.lit("</dd>"))).otherwise("<dt>别的</dt>")
    page = F.concat(F.lit("<dl><dt>主体</dt><dd> "), "source", F.lit("  Ltd</dd>"), place, F.lit("</dl>"))
    return doc(spark, sf_dir).select("doc_id", articles.about_fields(page, {"owner": "主体", "place": "地区"}).alias("a")).select("doc_id", "a.owner", "a.place")


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'rejected' ELSE 'active' END AS status, CASE WHEN n_chars < 200 THEN lang || '|rejected' ELSE 'products|' || lang END AS tags, CASE WHEN n_chars < 200 THEN 'short' END AS reason,
CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source FROM documents""")
def rejected_and_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).select("doc_id", "source", F.lit("active").alias("status"), F.array(F.lit("products"), "lang").alias("tags"), "n_chars")
    changes = d.filter("doc_id % 3 = 0").select("doc_id", F.upper("source").alias("source"))
    marked = articles.mark_rejected(records.patch(d, changes, "doc_id"), F.col("n_chars") < 200, "short")
    return marked.select("doc_id", "status", F.array_join("tags", "|").alias("tags"), "reason", "source")


@query("""SELECT lang || '/' || source AS path, count(*) AS urls FROM documents GROUP BY ALL HAVING count(*) > 1""")
def path_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.clashing_paths(doc(spark, sf_dir).select(F.concat_ws("/", "lang", "source").alias("path"), F.col("doc_id").alias("url")))


@query("""SELECT doc_id, CAST(b AS BIGINT) AS block, CAST(b AS VARCHAR) || lang AS name, CASE WHEN b = 1 THEN source END AS developer, 'two' AS platform FROM documents, (SELECT unnest([1, 2]) AS b)""")
def record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("before\n产品名：1"), "lang", F.lit("\n开发商：old\n开发商："), "source", F.lit("\n平台：two\n产品名：2"), "lang", F.lit("\n平台：one\n平台：two"))
    rows = blocks.lines(doc(spark, sf_dir).withColumn("body", body), "doc_id", "body")
    parts = F.split("line", "：", 2)
    found = blocks.records(rows, "doc_id", F.trim(parts[0]), F.get(parts, F.lit(1)), "产品名", ["产品名", "开发商", "平台"])
    return found.select("doc_id", "block", F.col("产品名").alias("name"), F.col("开发商").alias("developer"), F.col("平台").alias("platform"))


@query("""SELECT doc_id, CAST(f.line_no AS INTEGER) AS line_no, f.field, CASE f.line_no WHEN 1 THEN source WHEN 3 THEN lang ELSE 'free text' END AS value
FROM documents, (VALUES (1, 'developers'), (3, 'platforms'), (4, NULL)) f(line_no, field)""")
def block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("head\n开发商: "), "source", F.lit("\n## 平台\n"), "lang", F.lit("\n- free text"))
    rows = blocks.segment(blocks.lines(doc(spark, sf_dir).withColumn("body", body), "doc_id", "body"), "doc_id", F.col("line_no") == 0)
    return blocks.fields(rows.filter("line_no > 0"), "doc_id").select("doc_id", "line_no", "field", "value")


@query("""SELECT lang, count(*) FILTER (WHERE doc_id % 3 = 1) AS messages, 1 AS found, CAST(0 AS INTEGER) AS missing FROM documents GROUP BY lang""")
def lookups_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir)
    least = lookups.one_row(d.select("doc_id").orderBy("doc_id"), F.col("doc_id") >= 0)["doc_id"]
    own, _ = lookups.accounts_named(d.select("lang").distinct(), lookups.one_row(d.orderBy("doc_id"), F.col("doc_id") == least)["lang"], "lang")
    found = int(lookups.any_row(d, F.col("doc_id") == least) and own.count() == 1)
    return d.withColumn("itemidx", F.col("doc_id") % 3).groupBy("lang").agg(ingest.message_count("itemidx").alias("messages")).select("lang", "messages", F.lit(found).alias("found"), F.lit(int(lookups.any_row(d, F.col("doc_id") < 0))).alias("missing"))


@query("""SELECT p_name, p_brand FROM part ORDER BY lower(p_name), p_name""")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_name(load(spark, sf_dir, "part").select("p_name", "p_brand"), "p_name")


@query("""SELECT count(*) AS products, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_google_play, count(*) FILTER (WHERE doc_id % 3 = 0) AS with_app_store, count(*) FILTER (WHERE lang = 'en') AS with_package_id, count(*) FILTER (WHERE n_chars > 500) AS with_hints FROM documents""")
def store_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return lookups.store_coverage(doc(spark, sf_dir).select(
        F.when(i % 2 == 0, "u").alias("google_play"), F.when(i % 3 == 0, "u").otherwise("").alias("app_store"), F.when(F.col("lang") == "en", F.col("source")).alias("package_id"), F.when(F.col("n_chars") > 500, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("hints"),
    ))


@query("""WITH c AS (SELECT lang, count(*) AS candidates, count(*) FILTER (WHERE doc_id % 2 = 0) AS exact_candidates, count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0) AS rejected, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN n_chars END) AS verified FROM documents GROUP BY lang),
r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'none' END AS lang, count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS pages, count(*) FILTER (WHERE event_id % 7 = 0) AS retries FROM events GROUP BY 1)
SELECT lang, coalesce(candidates, 0) AS candidates, coalesce(exact_candidates, 0) AS exact_candidates, coalesce(rejected, 0) AS rejected, coalesce(verified, 0) AS verified, coalesce(requests, 0) AS requests, coalesce(pages, 0) AS pages, coalesce(retries, 0) AS retries FROM c FULL JOIN r USING (lang)""")
def discovery_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    found = doc(spark, sf_dir).select("lang", (i % 2 == 0).alias("exact"), (i % 3 == 0).alias("verified"), F.col("n_chars").cast("string").alias("link"))
    asked = load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "en").otherwise("none").alias("lang"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 7 == 0).alias("retry"))
    return lookups.discovery_metrics(found, asked, "lang")


@query("""SELECT count(*) FILTER (WHERE doc_id % 50 <> 0 AND doc_id % 3 = 0) AS complete, count(*) FILTER (WHERE doc_id % 50 <> 0 AND doc_id % 3 <> 0) AS partial, count(*) FILTER (WHERE doc_id % 50 = 0) AS failed,
string_agg(CASE WHEN doc_id % 100 = 0 THEN lang ELSE 'a' || doc_id END || '（bad ' || source || '）', '、' ORDER BY 'a' || doc_id) FILTER (WHERE doc_id % 50 = 0) AS failures, 'error' AS state FROM documents""")
def sync_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return lookups.sync_rollup(doc(spark, sf_dir).select(
        F.concat(F.lit("a"), i).alias("account"), F.when(i % 100 == 0, F.col("lang")).otherwise("").alias("nickname"), F.when(i % 3 == 0, "complete").otherwise("partial").alias("coverage"), F.when(i % 50 == 0, F.concat(F.lit("bad "), "source")).alias("error"),
    ))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 'skip' WHEN doc_id % 2 = 0 THEN 'cached' ELSE 'remote' END AS state, count(*) AS targets FROM documents GROUP BY 1""")
def export_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lookups.export_state(F.when(F.col("doc_id") % 3 == 0, True), F.col("doc_id") % 2 == 0)
    return doc(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("targets"))


@query("""SELECT doc_id, '<section class="text_content">' || chr(10) || '<p class="text_content">' || replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(13) || chr(10), '<br />'), chr(10), '<br />') || '</p>' || chr(10) || '</section>' AS html FROM documents""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc(spark, sf_dir).select("doc_id", render.text_section("text_content", "text").alias("html"))


@query("""SELECT doc_id, '---' || chr(10) || 'title: x' || chr(10) || 'date: "2024-01-02"' || chr(10) || 'url: "https://n/' || doc_id || '?a=1&b=$1"' || chr(10) || '---' || chr(10) || text || chr(10) || 'url: old' AS text FROM documents""")
def repaired_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("---\ntitle: x\ndate: 2024-01-01\nurl: 'https://o/"), "doc_id", F.lit("'\n---\n"), "text", F.lit("\nurl: old"))
    dated = linkage.patched_frontmatter(page, "date", F.lit("2024-01-01"), F.lit("2024-01-02"))
    rows = doc(spark, sf_dir).select("doc_id", dated.alias("p"))
    return rows.select("doc_id", linkage.patched_frontmatter("p", "url", F.concat(F.lit("https://o/"), "doc_id"), F.concat(F.lit("https://n/"), "doc_id", F.lit("?a=1&b=$1"))).alias("text"))


DAY = "strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d')"
LINKS_SQL = f"""WITH e AS (SELECT doc_id AS entry, 'Title, ' || doc_id AS title, 'title' || doc_id AS relaxed, {DAY} AS date FROM documents WHERE doc_id % 2 = 0 AND {DAY} >= '2024-02-01'),
l AS (SELECT CASE WHEN doc_id % 7 = 1 THEN '/a/' || replace({DAY}, '-', '') || '/' || doc_id WHEN doc_id % 7 IN (2, 5) THEN '/b/' || doc_id ELSE '/c/' || doc_id END AS file, CASE WHEN doc_id % 7 IN (3, 6) THEN 'TITLE ' || doc_id ELSE 'Title, ' || doc_id END AS title,
'title' || doc_id AS relaxed, CASE WHEN doc_id % 7 = 0 THEN {DAY} ELSE '2020-01-01' END AS local_date FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 4
UNION ALL SELECT '/d/' || doc_id, 'Title, ' || doc_id, 'title' || doc_id, '2020-02-02' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 = 5),
p AS (SELECT e.entry, count(*) AS n, count(*) FILTER (WHERE date = local_date) AS nd, min(file) FILTER (WHERE date = local_date) AS fd, count(*) FILTER (WHERE contains(file, replace(date, '-', ''))) AS np, min(file) FILTER (WHERE contains(file, replace(date, '-', ''))) AS fp, min(file) AS fa FROM e JOIN l ON e.title = l.title GROUP BY e.entry),
q AS (SELECT relaxed, min(file) AS fr FROM l GROUP BY relaxed HAVING count(*) = 1),
t AS (SELECT e.entry, e.date, CASE WHEN nd = 1 THEN fd WHEN np = 1 THEN fp WHEN n = 1 THEN fa WHEN n IS NULL THEN fr END AS file, CASE WHEN nd = 1 THEN 'title-and-date' WHEN np = 1 THEN 'title-and-path-date' WHEN n = 1 THEN 'unique-title' WHEN n IS NULL AND fr IS NOT NULL THEN 'unique-relaxed-title' END AS tier, n
FROM e LEFT JOIN p ON p.entry = e.entry LEFT JOIN q ON q.relaxed = e.relaxed),
r AS (SELECT t.entry, t.date, t.file, l.local_date, CASE WHEN tier IS NOT NULL THEN CASE WHEN t.date = l.local_date THEN 'matched' ELSE 'date-mismatch' END WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status, tier FROM t LEFT JOIN l ON l.file = t.file)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).filter("doc_id % 2 = 0")
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 7
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    catalog = d.select(F.col("doc_id").alias("entry"), F.concat(F.lit("Title, "), i).alias("title"), day.alias("date"))
    file = F.when(m == 1, F.concat(F.lit("/a/"), F.replace(day, F.lit("-"), F.lit("")), F.lit("/"), i)).when(m.isin(2, 5), F.concat(F.lit("/b/"), i)).otherwise(F.concat(F.lit("/c/"), i))
    local = d.filter(m != 4).select(file.alias("file"), F.concat(F.when(m.isin(3, 6), "TITLE ").otherwise("Title,  "), i).alias("title"), F.when(m == 0, day).otherwise("2020-01-01").alias("date"))
    twins = d.filter(m == 5).select(F.concat(F.lit("/d/"), i).alias("file"), F.concat(F.lit("Title, "), i).alias("title"), F.lit("2020-02-02").alias("date"))
    return linkage.link_catalog(catalog, local.unionByName(twins), "2024-02-01")


@query(LINKS_SQL + "SELECT entry, date, file, local_date, status, tier FROM r")
def catalog_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(LINKS_SQL + "SELECT count(*) AS eligible, count(tier) AS matched, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'date-mismatch') AS date_mismatches FROM r")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.audit_summary(_links(spark, sf_dir))


@query("""WITH e AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, CASE WHEN lang = 'fr' AND doc_id % 100 = 0 THEN '2024-13' ELSE strftime(DATE '2024-12-31' - CAST(CASE WHEN lang = 'de' THEN doc_id % 9 ELSE doc_id END AS INTEGER), '%Y-%m-%d') END AS d FROM documents),
s AS (SELECT lang, count(*) AS n, bool_and(regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}')) AS dated, bool_or(d < '2024-01-01') AS crossed, max(CASE WHEN pos = 10 THEN d END) AS first_end, max_by(d, pos) AS end_d FROM e GROUP BY lang),
w AS (SELECT lang, bool_or(rises) AS rises FROM (SELECT lang, coalesce(d > lag(d) OVER (PARTITION BY lang ORDER BY pos), false) AS rises FROM e) GROUP BY lang),
f AS (SELECT s.*, rises, CASE WHEN lang = 'es' THEN n + 1 ELSE n END AS loaded FROM s JOIN w USING (lang))
SELECT lang, 'loaded count differs' AS problem FROM f WHERE loaded <> n UNION ALL SELECT lang, 'bad date' FROM f WHERE NOT dated UNION ALL SELECT lang, 'dates rise' FROM f WHERE rises UNION ALL SELECT lang, 'no scroll' FROM f WHERE lang = 'en' UNION ALL SELECT lang, 'boundary not crossed' FROM f WHERE NOT crossed""")
def catalog_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")))
    back = F.when(F.col("lang") == "de", F.col("doc_id") % 9).otherwise(F.col("doc_id")).cast("int")
    entries = d.select("lang", "at", F.when((F.col("lang") == "fr") & (F.col("doc_id") % 100 == 0), "2024-13").otherwise(F.date_format(F.date_sub(F.lit("2024-12-31").cast("date"), back), "yyyy-MM-dd")).alias("d"))
    n = F.count("*")
    facts = entries.groupBy("lang").agg(F.when(F.col("lang") == "es", n + 1).otherwise(n).alias("loaded"), F.lit(10).alias("initial"), F.max(F.when(F.col("at") == 10, F.col("d"))).alias("initial_oldest"), F.max_by("d", "at").alias("oldest"), F.when(F.col("lang") == "en", 0).otherwise(3).alias("steps"), F.lit(True).alias("reached"))
    return linkage.catalog_problems(entries, "lang", "at", "d", facts, "2024-01-01")


@query("""SELECT lang AS account, CAST(1700000000 - 366 * 86400 + CASE WHEN lang = 'de' THEN 0 ELSE length(lang) END AS BIGINT) AS floor FROM (SELECT DISTINCT lang FROM documents) WHERE lang <> 'en'""")
def overdue_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = 1700000000
    state = doc(spark, sf_dir).select("lang").distinct().select(
        F.col("lang").alias("account"), F.when(F.col("lang") == "en", F.lit(base - 29 * 86400)).when(F.col("lang") == "fr", F.lit(base - 30 * 86400)).alias("audited_at"),
        F.when(F.col("lang") != "de", F.lit(base - 366 * 86400).cast("long") + F.length("lang")).alias("floor"),
    )
    return lookups.overdue(state, F.lit(base).cast("long"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'complete' WHEN 1 THEN 'date-floor' WHEN 2 THEN 'overlap' WHEN 3 THEN 'partial' WHEN 4 THEN 'first-page' WHEN 5 THEN 'not-advancing' END AS reason FROM events""")
def scan_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 7
    page = {"advances": n != 5, "count": F.when(n == 0, 0).otherwise(20), "oldest": F.when(n == 1, 50).when(n == 2, 150).otherwise(500), "partial": n == 3, "single": n == 4}
    return load(spark, sf_dir, "events").select("event_id", lookups.stop_reason(page, F.lit(100), F.lit(200), F.lit(2), F.lit(2)).alias("reason"))


@query("""WITH o AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS articles, lang = 'en' AS completed FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), n AS (SELECT lang, CAST(count(*) AS BIGINT) AS articles, lang = 'de' AS completed FROM documents WHERE doc_id % 2 = 1 GROUP BY lang)
SELECT lang, coalesce(o.articles, 0) + coalesce(n.articles, 0) AS articles, coalesce(n.completed, o.completed, false) AS completed FROM o FULL JOIN n USING (lang)""")
def replaced_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir)
    old = d.filter("doc_id % 2 = 0").groupBy("lang").agg(F.sum("n_chars").alias("articles")).withColumn("completed", F.col("lang") == "en")
    new = d.filter("doc_id % 2 = 1").groupBy("lang").agg(F.count("*").alias("articles")).withColumn("completed", F.col("lang") == "de")
    return records.counters(old, new, "lang", ["articles"], "completed", replace=True)


@query("""SELECT source, lang, count(*) AS records, count(DISTINCT n_chars) AS names FROM documents GROUP BY source, lang ORDER BY records DESC, source, lang LIMIT 20""")
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("records"), F.count_distinct("n_chars").alias("names")).orderBy(F.desc("records"), "source", "lang").limit(20)


@query("""SELECT d.doc_id, d.lang IN ('en', 'fr') OR 'x-' || d.source IN (SELECT 'x-' || source FROM documents WHERE doc_id < 10) AS known FROM documents d""")
def known_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).select("doc_id", F.upper("lang").alias("name"), F.concat(F.lit("X "), "source").alias("title"))
    held = d.filter("doc_id < 10").select(text.slug("title").alias("subject")).unionByName(spark.createDataFrame([("en",), ("fr",)], "subject string")).distinct()
    keys = d.select("doc_id", F.explode(F.array(F.lower("name"), text.slug("title"))).alias("subject"))
    hit = keys.join(held, "subject", "left_semi").select("doc_id").distinct().withColumn("known", F.lit(True))
    return d.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT page_id, '---' || chr(10) || 'title: "T ' || page_id || ' \\"q\\""' || chr(10) || 'author: ""' || chr(10) || 'date: "2024-01-01"' || chr(10) || 'url: "' || url || '"' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'source_evidence: "e' || page_id || '"' || chr(10) ELSE '' END
|| '---' || chr(10) || chr(10) || '# T ' || page_id || ' "q"' || chr(10) || chr(10) AS header, CASE page_id % 3 WHEN 0 THEN 'url without identity' WHEN 1 THEN 'another article' END AS problem FROM pages""")
def markdown_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    title = F.concat(F.lit("T "), i, F.lit(' "q"'))
    header = publishing.markdown_header(title, F.lit(None).cast("string"), F.lit("2024-01-01"), "url", F.when(i % 2 == 0, F.concat(F.lit("e"), i)))
    link = F.when(i % 3 == 0, F.concat(F.lit("https://h/s?mid="), i)).otherwise(F.concat(F.lit("https://h/s?__biz=B&idx=1&mid="), i))
    page = F.concat(F.lit('<script>var biz = "" || "B"; var mid = "'), F.when(i % 3 == 1, i + 1).otherwise(i), F.lit('"; var idx = "1";</script>'))
    return load(spark, sf_dir, "pages").select("page_id", header.alias("header"), publishing.identity_problem(page, link).alias("problem"))


@query("""SELECT url, '<img src="' || CASE WHEN page_id % 2 = 0 THEN './assets/a' || page_id % 5 ELSE 'https://c.example/' || page_id % 5 || '?x=1&amp;y=2' END || '"><img src="https://c.example/' || page_id % 5 || '/none">' || html AS html FROM pages""")
def bundled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "pages")
    k = (F.col("page_id") % 5).cast("string")
    address = F.concat(F.lit("https://c.example/"), k, F.lit("?x=1&y=2"))
    own = F.concat(F.lit('<img src="https://c.example/'), k, F.lit('?x=1&amp;y=2"><img src="https://c.example/'), k, F.lit('/none">'))
    pages = d.select("url", F.concat(own, "html").alias("html"), F.array(F.when(F.col("page_id") % 2 == 0, address).otherwise("https://c.example/other"), F.concat(F.lit("https://c.example/"), k, F.lit("/none"))).alias("resources"))
    assets = d.select(address.alias("resource"), F.concat(F.lit("./assets/a"), k).alias("asset")).distinct()
    return publishing.with_assets(pages, assets)


@query("""WITH d AS (SELECT CASE WHEN doc_id % 40 = 0 THEN NULL WHEN doc_id % 40 IN (1, 2) THEN doc_id // 40 * 40 + 1 ELSE doc_id END AS id, doc_id % 7 AS m FROM documents)
SELECT DISTINCT id AS doc_id, CASE WHEN id IS NULL THEN 'no id' WHEN n > 1 THEN 'repeated id' WHEN m = 3 THEN 'unexpected source_type' ELSE 'content hash differs' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM d) WHERE id IS NULL OR n > 1 OR m IN (3, 5)""")
def document_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, m = F.col("doc_id"), F.col("doc_id") % 7
    name = F.when(i % 40 == 0, None).when((i % 40).isin(1, 2), F.floor(i / 40) * 40 + 1).otherwise(i).cast("long")
    d = doc(spark, sf_dir).select(name.alias("doc_id"), F.when(m == 3, "other").otherwise("ours").alias("source_type"), "lang", F.when(m == 5, "x").otherwise(F.sha2("lang", 256)).alias("content_hash"))
    return publishing.preflight(d, "ours", F.sha2("lang", 256))


@query("""SELECT doc_id, 'a "b" ' || doc_id AS json_title, 'a \\"b\\" ' || doc_id AS line_title, CASE WHEN doc_id % 2 = 0 THEN lang END AS author, CASE WHEN doc_id % 3 = 0 THEN 'https://play.google.com/store/apps/details?id=com.' || lang || '&hl=en' END AS google_play,
CASE WHEN doc_id % 3 = 0 THEN 'com.' || lang END AS package_id, 'https://apps.apple.com/app/id' || doc_id AS app_store, CASE WHEN doc_id % 2 = 0 THEN 'Fun' || lang ELSE '' END AS hints,
CASE doc_id % 4 WHEN 0 THEN '芬兰' WHEN 1 THEN '美国' WHEN 2 THEN '可能香港/中国/新加坡' ELSE '未知' END AS region FROM documents""")
def headers_and_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.concat(F.lit('---\ntitle: "a \\"b\\" '), i, F.lit('"\nauthor: '), F.when(i % 2 == 0, F.concat(F.lit("'"), "lang", F.lit("'"))).otherwise(""), F.lit("\n---\ntitle: no\n"))
    play = F.when(i % 3 == 0, F.concat(F.lit("(https://play.google.com/store/apps/details?id=com."), "lang", F.lit("&hl=en) "))).otherwise("")
    hint = F.when(i % 2 == 0, F.concat(F.lit("，也就是Fun"), "lang", F.lit("呗"))).otherwise("，也就是这家呗")
    body = F.concat(play, F.lit("https://apps.apple.com/app/id"), i)
    links = publishing.store_links(body)
    firm = F.when(i % 4 == 0, "Supercell").when(i % 4 == 1, "Some Inc.").when(i % 4 == 2, "X Holding").otherwise("Zed")
    found = F.when(i % 2 == 0, publishing.hints(hint, 1)).otherwise(publishing.hints(hint))
    return doc(spark, sf_dir).select("doc_id", publishing.json_field(head, "title").alias("json_title"), publishing.first_lines_field(head, "title").alias("line_title"), publishing.json_field(head, "author").alias("author"), links["google_play"].alias("google_play"), links["package_id"].alias("package_id"), links["app_store"].alias("app_store"), F.array_join(found, "|").alias("hints"), text.region(firm, text.REGIONS_WIDE)["region"].alias("region"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<section class="item_show_type_0"><p>' || lang || '</p><img src="https://i/' || doc_id || '" loading="eager" alt="x"></section>'
WHEN 1 THEN '<section class="item_show_type_8">' || chr(10) || '<p class="text_content">a<br /><a class="wx_img_refer_link" data-seq="1" data-refer="图1" style="" href="#图1"> 图1 </a></p>' || chr(10) || '<div class="picture_content"><div class="picture_item" id="图1">' || chr(10) || '    <img class="picture_item_img" src="https://i/' || doc_id || '?a=1&amp;b=2" alt="图1" />' || chr(10) || '    <p class="picture_item_label">图1</p>' || chr(10) || '</div></div>' || chr(10) || '</section>'
WHEN 2 THEN '<section class="item_show_type_10">' || chr(10) || '<p class="text_content">&lt;' || lang || '&gt;<br />x</p>' || chr(10) || '</section>'
WHEN 3 THEN '<section class="pay_subscribe_notice">' || chr(10) || '<div class="pay_subscribe_badge">付费内容 · ' || CASE WHEN doc_id % 2 = 0 THEN '1.5 元' ELSE '7 微币' END || '</div>' || chr(10) || '<div class="pay_subscribe_desc">d&amp;' || lang || '</div>' || chr(10) || '<div class="pay_subscribe_hint">本文为付费文章，完整内容需购买后查看</div>' || chr(10) || '</section>'
ELSE '(unknown)' END AS html FROM documents""")
def article_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("doc_id") % 5
    plain = F.concat(F.lit("<p>"), "lang", F.lit('</p><img height="3" data-src="https://i/'), i, F.lit('" alt="x">'))
    pictured = F.lit('a\n<a class="wx_img_refer_link" data-seq="1" data-refer="图1" style=""> 图1 </a>')
    row = F.struct(
        F.col("source").alias("title"), F.when(n == 0, 0).when(n == 1, 8).when(n == 2, 10).when(n == 3, 0).otherwise(7).alias("item_show_type"), F.when(n == 0, plain).when(n == 1, pictured).otherwise(" ").alias("content_noencode"),
        F.when(n == 3, 1).otherwise(0).alias("is_pay_subscribe"), F.struct(F.concat(F.lit("<"), "lang", F.lit(">\r\nx")).alias("content_noencode")).alias("text_page_info"),
        F.struct(F.when(i % 2 == 0, 150).alias("fee"), F.lit(7).alias("wecoin_amount"), F.concat(F.lit("d&"), "lang").alias("desc")).alias("pay_subscribe_info"),
        F.array(F.struct(F.concat(F.lit("https://i/"), i, F.lit("?a=1&amp;b=2")).alias("cdn_url"))).alias("picture_page_info_list"),
    )
    return doc(spark, sf_dir).select("doc_id", render.article_html(row).alias("html"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Homa Games（法国）' WHEN 1 THEN 'IGG Inc.（互动游戏，香港上市 0799.HK）' ELSE '' END AS entity, CASE WHEN doc_id % 2 = 0 THEN lang END AS province FROM documents""")
def entities_and_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, "Homa Games").when(F.col("doc_id") % 3 == 1, "IGG").otherwise("igg")
    reply = F.from_json(F.when(F.col("doc_id") % 2 == 0, F.format_string('{"ip_wording":{"province_name":"%s"}}', F.col("lang"))).otherwise("{}"), "ip_wording struct<province_name:string>")
    return doc(spark, sf_dir).select("doc_id", text.labelled(name, names.ENTITIES, "").alias("entity"), reply["ip_wording"]["province_name"].alias("province"))


@query("""SELECT doc_id AS entry, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'matched' END AS status FROM documents WHERE (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)) AND doc_id % 5 <> 0""")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    linked = doc(spark, sf_dir).select(i.alias("entry"), F.when(i % 3 == 0, "missing").when(i % 3 == 1, "matched").otherwise("ambiguous").alias("status"), F.when(i % 2 == 1, True).alias("stable"))
    return lookups.missing_evidence(linked, doc(spark, sf_dir).filter("doc_id % 5 = 0").select(i.alias("entry")))


@query("""SELECT 'a' || doc_id AS aid, 'b' || doc_id % 10 AS fakeid FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 <> 0""")
def account_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = doc(spark, sf_dir).select(F.concat(F.lit("a"), i).alias("aid"), F.concat(F.lit("l"), i % 10).alias("link"), F.when(i % 4 == 0, "SINGLE").otherwise("x").alias("fakeid"))
    found = doc(spark, sf_dir).select(F.concat(F.lit("l"), i % 10).alias("link"), F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("b"), i % 10)).alias("biz"))
    return lookups.account_repairs(rows, found, "SINGLE")


@query("""SELECT DISTINCT '/r/' || lang || '/' || source || '/index.md' AS path FROM documents WHERE lang IN ('en', 'fr') ORDER BY path""")
def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.scoped_files(doc(spark, sf_dir).select(F.concat(F.lit("/r/"), "lang", F.lit("/"), "source", F.when(F.col("doc_id") % 9 == 100, "/x.md").otherwise("/index.md")).alias("path")), "/r", ["en", "fr"])


@query("""SELECT doc_id, CAST(b.b AS BIGINT) AS block, CASE b.b WHEN 1 THEN 'Game ' || lang ELSE 'Other Thing' END AS name, CASE b.b WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'Firm One' ELSE '冲突待审' END ELSE '未知' END AS publisher,
CASE b.b WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'Firm One' ELSE 'Firm One|' || source END ELSE '' END AS candidates, CASE b.b WHEN 1 THEN 'iOS|Android' ELSE '' END AS platforms, CASE b.b WHEN 1 THEN 'https://s.example/' || doc_id ELSE '' END AS links,
CASE b.b WHEN 1 THEN 'shine ' || lang ELSE '' END AS highlights, CASE b.b WHEN 1 THEN 'plain prose of ' || source || ', in a line.' ELSE 'more prose, of the second.' END AS description FROM documents, (SELECT unnest([1, 2]) AS b) b""")
def product_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    firms = F.when(i % 2 == 0, "发行商：The First Firm").otherwise(F.concat(F.lit("发行商：Firm One、"), "source"))
    body = F.concat(
        F.lit("an opening line, before all.\n**Game "), "lang", F.lit("**\n"), firms, F.lit("\n平台：iOS，Android\n链接\nhttps://s.example/"), i, F.lit("\n亮点：shine "), "lang", F.lit("\nplain prose of "), "source",
        F.lit(", in a line.\n![](x.png)\n### Other Thing\nmore prose, of the second."),
    )
    found = blocks.products(doc(spark, sf_dir).select("doc_id", body.alias("body")), "doc_id", "body", [("(?i)first firm", "Firm One")])
    return found.select("doc_id", "block", "name", "publisher", *[F.array_join(c, "|").alias(c) for c in ("candidates", "platforms", "links", "highlights")], "description")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'withheld' WHEN doc_id % 13 = 6 THEN 'account differs' WHEN doc_id % 7 = 2 OR doc_id = 0 THEN 'incomplete' WHEN doc_id % 17 = 8 THEN 'no title or account' WHEN doc_id % 19 = 9 THEN 'no article link' END AS reason,
doc_id || '_1' AS aid, CASE WHEN doc_id % 17 = 8 THEN '' WHEN doc_id % 5 = 0 THEN source || ' x' ELSE 'N' || lang END AS account, source || ' & ' || lang AS title, 1700000000 + doc_id AS publish_time, repeat('d', 240) AS digest,
'https://mp.weixin.qq.com/s?__biz=M' || source || '%3D%3D&mid=' || doc_id || '&idx=1' || CASE WHEN doc_id % 2 = 0 THEN '&sn=s' || doc_id ELSE '' END AS canonical_link, CASE WHEN doc_id % 19 <> 9 THEN 'https://mp.weixin.qq.com/s/a' || doc_id END AS link FROM documents""")
def verified_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 17 == 8, "").when(i % 5 == 0, F.concat(F.lit('<a class="a" id="js_name"> '), "source", F.lit(" <b> x</b></a>"))).otherwise(F.concat(F.lit('<strong class="b profile_nickname">N'), "lang", F.lit("</strong>")))
    content = F.when(i % 7 == 2, "<div id=js_content> <script>var t = 'none';</script></div>").when(i % 7 == 3, '<div id="js_content"><p><img src="x"></p></div>').otherwise('<div id="js_content">some <i>text</i></div>')
    page = F.concat(
        F.lit('<html><head><meta property="og:title" content="'), "source", F.lit(' &amp; '), "lang", F.lit('"><meta name="description" content="'), F.repeat(F.lit("d"), 300), F.lit('"></head><body>'), name,
        F.lit('<script>var biz = "" || "M'), "source", F.lit('=="; var mid = "'), i, F.lit('"; var idx = 1; '), F.when(i % 2 == 0, F.concat(F.lit('var sn = "s'), i, F.lit('"; '))).otherwise(""), F.lit("var oriCreateTime = '"), i + 1700000000, F.lit("';</script>"),
        F.when(i % 11 == 5, "<p>环境异常</p>").otherwise(""), content, F.lit("</body></html>"),
    )
    expected = F.when(i % 13 == 6, "other").otherwise(F.concat(F.lit("M"), "source", F.lit("==")))
    link = F.concat(F.when(i % 19 == 9, "http").otherwise("https"), F.lit("://mp.weixin.qq.com/s/a"), i, F.lit("#top"))
    a = doc(spark, sf_dir).select("doc_id", articles.verified_article(page, expected, link).alias("a"))
    return a.select("doc_id", *[f"a.{c}" for c in ("reason", "aid", "account", "title", "publish_time", "digest", "canonical_link", "link")])


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'no original link' WHEN doc_id % 5 = 1 OR doc_id % 11 = 4 THEN 'incomplete' END AS reason, 'T ' || source AS title, lang || ' ' || doc_id AS account, CASE WHEN doc_id % 5 = 1 THEN '' ELSE '2025-01-02' END AS publish_date,
CASE WHEN doc_id % 7 <> 3 THEN 'https://mp.weixin.qq.com/s/b' || doc_id END AS original_url, CASE WHEN doc_id % 11 = 4 THEN '<p> </p>' ELSE '<p>body ' || doc_id || '</p>' END AS body FROM documents""")
def mirror_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    page = F.concat(
        F.lit("<h1> T "), "source", F.lit("</h1><h1>other</h1><div>来源：longer "), "lang", F.lit(" label <div>来源： "), "lang", F.lit("\n"), i, F.lit("</div><div>时间：2025-01-02"), F.when(i % 5 == 1, " 10:00").otherwise(""), F.lit("</div></div>"),
        F.lit('<a href="https://other.example/s">no</a><a href="'), F.when(i % 7 == 3, "http").otherwise("https"), F.lit("://mp.weixin.qq.com/s/b"), i, F.lit('#x">original</a><div class="a kch-detailBox"><style>p{}</style><script>x()</script><p>'),
        F.when(i % 11 == 4, " ").otherwise(F.concat(F.lit("body "), i)), F.lit('</p><iframe src="y">z</iframe></div>'),
    )
    return doc(spark, sf_dir).select("doc_id", articles.mirror_article(page).alias("a")).select("doc_id", "a.*")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A' || doc_id || '|B|C' WHEN 1 THEN 'A' || doc_id || '|C' ELSE 'B|C' END AS services, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'first' ELSE 'pushed' END AS first_url, CASE WHEN doc_id % 2 = 0 THEN lang END AS province FROM documents""")
def about_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    entry = lambda p, url: F.concat(F.lit("{principal: '"), p, F.lit("', userName: 'u', appId: JsDecode('i\\\\x31'), relativeURL: '"), F.lit(url), F.lit("', __x: 1}"))
    own = F.concat(F.lit("A"), i)
    base = F.when(i % 3 == 2, "").otherwise(F.concat(F.lit("<script>var cgiData = {auth_3rd_list: ["), entry(own, "first"), F.when(i % 3 == 0, F.concat(F.lit(", "), entry(F.lit("B"), "first"))).otherwise(""), F.lit("], n: '1' * 1};</script>")))
    call = lambda x: F.concat(F.lit("window.cgiData.auth_3rd_list.push /* c */ ( "), x, F.lit(" );\n"))
    pushed = F.concat(F.lit("<script>"), F.when(i % 3 == 2, call(entry(F.lit("B"), "pushed"))).otherwise(call(entry(own, "again"))), call(F.lit("other()")), F.lit("xwindow.cgiData.auth_3rd_list.push({principal: 'no'});"), call(entry(F.lit("C"), "last")), call(entry(F.lit("C"), "again")), F.lit("</script>"))
    place = F.when(i % 2 == 0, F.concat(F.lit("<script>window.ip_wording = {countryName: 'x', provinceName: \""), "lang", F.lit('"};</script>'))).otherwise("")
    a = doc(spark, sf_dir).select("doc_id", articles.about_data(F.concat(base, pushed, place)).alias("a"))
    return a.select("doc_id", F.array_join(F.transform("a.services", lambda s: s["principal"]), "|").alias("services"), F.get("a.services", F.lit(0))["relativeURL"].alias("first_url"), F.col("a.place.provinceName").alias("province"))


@query("""WITH m AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT doc_id, CAST(min(item_id) AS VARCHAR) AS first_item, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id""")
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = aliases.words_of(load(spark, sf_dir, "benchmark"), "text", "item_id", "item_id", ignore_case=False)
    found = doc(spark, sf_dir).select("doc_id", aliases.first_name("text", shared).alias("first_item"), aliases.all_names("text", shared).alias("items"))
    return found.filter("first_item IS NOT NULL").select("doc_id", "first_item", F.array_join("items", ",").alias("items"))


@query("""SELECT doc_id, 'structured' AS source, CAST(1 AS BIGINT) AS nth, 'Game ' || lang AS name, CASE WHEN doc_id % 2 = 0 THEN 'Firm ' || source END AS publisher, 'two' AS platform, CASE WHEN doc_id % 3 = 0 THEN 'https://play.google.com/store/apps/details?id=a.b' || doc_id END AS google_play, CASE WHEN doc_id % 3 = 0 THEN 'a.b' || doc_id END AS package_id, NULL AS hints FROM documents
UNION ALL SELECT doc_id, 'structured', 2, 'Second', NULL, NULL, NULL, NULL, NULL FROM documents
UNION ALL SELECT doc_id, 'inline', CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END, 'Other ' || doc_id || 'x', 'House of ' || lang, NULL, NULL, NULL, '乐元素' FROM documents WHERE doc_id % 5 <> 4""")
def two_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    body = F.concat(
        F.lit('---\ntitle: "x"\n游戏名字：Not this\n---\n游戏公司：nobody\n游戏名字： Game '), "lang", F.lit("\n平台：one\n"), F.when(i % 2 == 0, F.concat(F.lit("游戏公司: Firm "), "source", F.lit("\n"))).otherwise(""), F.lit("平台：two\n游戏名字：Second\n"),
        F.when(i % 3 == 0, F.concat(F.lit("Game "), "lang", F.lit("    Some Firm\nsee https://play.google.com/store/apps/details?id=a.b"), i, F.lit(" now\n"))).otherwise(""),
        F.lit("- Listed     Firm\n# Head     Firm\n"), F.when(i % 5 != 4, F.concat(F.lit("1.Other "), i, F.lit("x     House of "), "lang", F.lit(" \n![](x)\n就是乐元素吧\n"))).otherwise(""), F.lit("an end"),
    )
    found = extractors.products(doc(spark, sf_dir).select("doc_id", body.alias("body")), "doc_id", "body")
    return found.select("doc_id", "source", "nth", "name", "publisher", "platform", "google_play", "package_id", F.array_join("hints", ",").alias("hints"))


@query("""SELECT lang || doc_id % 30 AS id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(source) AS account FROM documents GROUP BY ALL""")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).select(F.concat("lang", F.col("doc_id") % 30).alias("id"), F.array("source").alias("sources"), F.col("source").alias("account"), F.col("source").alias("seq"))
    folder = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    stored, rule = "id string, sources array<string>, account string", merged.with_sources(["id"], "seq", ["sources"], "account")
    half = F.xxhash64("account") % 2 == 0
    ordered = d.select("id", "sources", "account", "seq")
    for part in (ordered.filter(half), ordered.filter(~half)):
        merged.merge_into(spark, folder, part, ["id"], rule, stored, buckets=16)
    return merged.read(spark, folder).select("id", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.array_min("sources").alias("account"))


@query("""SELECT source || ':' || doc_id AS key FROM documents""")
def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc(spark, sf_dir).select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key"))


@query("""WITH a AS (SELECT lang AS fakeid, max(doc_id) AS last_update_time FROM documents GROUP BY lang) SELECT fakeid, CASE WHEN fakeid IN ('en', 'de') THEN 1700000000 ELSE last_update_time END AS last_update_time FROM a""")
def touched_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = doc(spark, sf_dir).groupBy(F.col("lang").alias("fakeid")).agg(F.max("doc_id").alias("last_update_time"))
    touched = spark.createDataFrame([("en",), ("de",), ("de",), ("none",)], "fakeid string")
    return records.touch(accounts, touched, "fakeid", "last_update_time", F.lit(1700000000).cast("long"))


@query("""SELECT 'articles' AS tab, lang, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY lang""")
def cleared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).select("lang", "doc_id")
    left = records.delete_cascade({"articles": d, "api": d}, "lang", spark.createDataFrame([("fr",)], "lang string"), cleared=("api",))
    counted = [t.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "lang", "n") for name, t in left.items()]
    return counted[0].unionByName(counted[1])


@query("""SELECT 'M' || source AS fakeid, doc_id || '_' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2' END AS aid, '未命名文章' AS title, '--' AS author_name, 1700000000 AS create_time, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS itemidx FROM documents""")
def stub_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    link = F.concat(F.lit("https://mp.weixin.qq.com/s?__biz=M"), "source", F.lit("&mid="), i, F.when(i % 3 == 0, "").otherwise("&idx=2"))
    rows = articles.stub_rows(doc(spark, sf_dir).select(link.alias("l")), "l", F.lit(1700000000))
    return rows.select("fakeid", "aid", "title", "author_name", F.col("create_time").cast("int").alias("create_time"), F.col("itemidx").cast("int").alias("itemidx"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN '服务号' WHEN 3 THEN '' ELSE '订阅号' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'deleted' ELSE 'failed' END AS page FROM documents""")
def account_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    page = F.when(i % 3 == 0, F.concat(F.lit('<p>x</p><div class="a" id="js_content">'), "source", F.lit("</div>"))).when(i % 3 == 1, "<div id='js_fullscreen_layout_padding'></div><p>js_content</p>").when(i % 2 == 0, "<p id=js_contents></p>")
    return doc(spark, sf_dir).select("doc_id", text.labelled(i % 4, text.ACCOUNT_TYPES, "").alias("kind"), articles.completeness(page).alias("page"))


@query("""SELECT doc_id, n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE contains(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), 'the th') AND coalesce(toxic, 0) <> 1""")
def keyword_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.enrich(doc(spark, sf_dir).select("doc_id", "n_chars", F.col("text").alias("title")), load(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_deleted")), "doc_id", "has")
    return articles.grid(rows, "  The\n TH", hide_deleted=True, order=(("n_chars", True), ("doc_id", False))).select("doc_id", "n_chars")


@query("""SELECT source AS name, count(*) AS documents FROM documents WHERE n_chars < 400 GROUP BY source""")
def noise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.noise_by_name(doc(spark, sf_dir), "source", F.col("n_chars") < 400)


@query("""WITH m AS (SELECT source AS publisher, doc_id, lang || doc_id % 7 AS title, doc_id % 3 = 0 AS single FROM documents), p AS (SELECT CASE doc_id % 5 WHEN 0 THEN '未知' WHEN 1 THEN 'Only ' || lang ELSE source END AS publisher, 'n' || doc_id % 23 AS name, doc_id AS seq FROM documents),
k AS (SELECT * FROM p WHERE publisher <> '未知'), mt AS (SELECT publisher, title, row_number() OVER (PARTITION BY publisher ORDER BY min(doc_id), title) AS n FROM m GROUP BY publisher, title), kt AS (SELECT publisher, name, row_number() OVER (PARTITION BY publisher ORDER BY min(seq), name) AS n FROM k GROUP BY publisher, name),
a AS (SELECT publisher, count(*) AS articles, count(*) FILTER (WHERE single) AS alone FROM m GROUP BY publisher), b AS (SELECT publisher, count(*) AS products, count(DISTINCT name) AS names FROM k GROUP BY publisher),
t AS (SELECT publisher, string_agg(title, ',' ORDER BY n) AS titles FROM mt WHERE n <= 10 GROUP BY publisher), u AS (SELECT publisher, string_agg(name, ',' ORDER BY n) AS product_names FROM kt WHERE n <= 10 GROUP BY publisher),
j AS (SELECT coalesce(a.publisher, b.publisher) AS publisher, coalesce(articles, 0) AS articles, coalesce(alone, 0) AS alone, coalesce(products, 0) AS products, coalesce(names, 0) AS names FROM a FULL JOIN b ON a.publisher = b.publisher)
SELECT publisher, articles, alone, products, names, coalesce(titles, '') AS titles, coalesce(product_names, '') AS product_names, CAST(row_number() OVER (ORDER BY articles DESC, publisher) AS INTEGER) AS rank_by_articles, CAST(row_number() OVER (ORDER BY products DESC, publisher) AS INTEGER) AS rank_by_products
FROM j LEFT JOIN t USING (publisher) LEFT JOIN u USING (publisher)""")
def publisher_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = doc(spark, sf_dir), F.col("doc_id")
    mentions = d.select(F.col("source").alias("publisher"), i.alias("article"), F.concat("lang", i % 7).alias("title"), (i % 3 == 0).alias("single"))
    products = d.select(F.when(i % 5 == 0, "未知").when(i % 5 == 1, F.concat(F.lit("Only "), "lang")).otherwise(F.col("source")).alias("publisher"), F.concat(F.lit("n"), i % 23).alias("name"), i.alias("seq"))
    return quality.report(mentions, products).withColumns({c: F.array_join(c, ",") for c in ("titles", "product_names")})
