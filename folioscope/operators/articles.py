"""Articles as rows: adapters, export columns, albums, pages of search results, rendering by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import html, text, urls
from folioscope.functions.select import Field, select_fields
from folioscope.functions.text import _c, collapse, filled, first_filled, publish_epoch

#: The full article row (name and type), with what a missing value becomes.
ROW = {
    "fakeid": ("string", ""), "aid": ("string", ""), "title": ("string", ""), "link": ("string", ""), "cover": ("string", ""), "digest": ("string", ""), "author_name": ("string", ""),
    "create_time": ("bigint", 0), "update_time": ("bigint", 0), "itemidx": ("int", 1), "item_show_type": ("int", 0), "copyright_stat": ("int", 0), "copyright_type": ("int", 0),
    "is_pay_subscribe": ("int", 0), "is_deleted": ("boolean", False), "_status": ("string", ""), "_single": ("boolean", False),
}
ALBUMS = "array<struct<id: string, title: string>>"


def article_rows(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Full article rows: named columns, columns of that name, else defaults; nulls take the default."""
    out = []
    for name, (kind, default) in ROW.items():
        have = _c(columns[name]) if name in columns else F.col(name) if name in df.columns else F.lit(None)
        out.append(F.coalesce(have.cast(kind), F.lit(default).cast(kind)).alias(name))
    return df.select(*out)


def export_rows(articles: DataFrame, accounts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of the table export: account name, first filled cover, mark of originals, label of the kind, albums as tags.

    accounts: fakeid, nickname; metadata: url and counts; the article's own columns win a clash.
    """
    a = articles.join(accounts.select("fakeid", "nickname").dropDuplicates(["fakeid"]), "fakeid", "left")
    counts = [c for c in metadata.columns if c != "url" and c not in articles.columns]
    m = metadata.dropDuplicates(["url"]).select(F.col("url").alias("link"), *counts)
    cover = first_filled(*[c for c in ("pic_cdn_url_235_1", "pic_cdn_url_16_9", "cover_img", "cover") if c in articles.columns])
    albums = F.array_join(F.transform(F.col("appmsg_album_infos"), lambda x: F.concat(F.lit("#"), x["title"])), " ") if "appmsg_album_infos" in articles.columns else F.lit("")
    return a.join(m, "link", "left").select(
        F.col("nickname").alias("account_name"), "aid", "link", "title", cover.alias("cover"), "digest", text.format_epoch("create_time").alias("create_time"), text.format_epoch("update_time").alias("update_time"),
        *counts, "author_name", F.when((F.col("copyright_stat") == 1) & (F.col("copyright_type") == 1), "原创").otherwise("").alias("copyright"), text.item_type("item_show_type").alias("item_show_type"), F.coalesce(albums, F.lit("")).alias("album"),
    )


#: The first second of the medium (fixed value) and spans back from the coming midnight.
ORIGIN = 1345305600
SPANS = {"1d": "1 day", "3d": "3 days", "7d": "7 days", "1m": "1 month", "3m": "3 months", "6m": "6 months", "1y": "1 year"}


def deadline(preset: str, now: Column, point: int = 0, origin: int = ORIGIN) -> Column:
    """Epoch second at which a scan may stop: a preset span, 24h, a point, or all."""
    if preset == "24h":
        return now - 86400
    if preset in SPANS:
        midnight = F.date_trunc("day", F.timestamp_seconds(now)) + F.expr("interval 1 day")
        return F.unix_timestamp(midnight - F.expr(f"interval {SPANS[preset]}"))
    return F.lit(point if preset == "point" and point else origin).cast("long")


def wanted_candidate(account: Column, name: str, epoch: Column, floor: Column) -> Column:
    """Whether a search hit is the account's and, if its time is known, not before the floor."""
    return (account == name) & ((epoch == 0) | (epoch >= floor))


def of_account(name: Column, url: Column, account: Column | str, biz: str) -> Column:
    """Whether a record is the account's: by its id if the URL tells one, else by name."""
    own = filled(urls.param(url, "__biz"))
    return F.coalesce(own == biz, F.lit(False)) | (name == account)


def is_legacy_row() -> Column:
    """Rows of the replaced importer: origin, kind, end of the title and a mark in the content."""
    t = F.coalesce("title", F.lit(""))
    return (F.col("origin") == "web-research") & F.col("synthesis_type").isin("attribution", "profile") & (t.endswith("产品归因（公众号文章）") | t.endswith("产品档案（公众号文章）")) & F.coalesce("content", F.lit("")).contains("公众号")


def is_active_document(source_type: str, active_only: bool = True) -> Column:
    """Documents of a source; active ones are not rejected and tagged as products."""
    ours = F.col("source_type") == source_type
    return ours & ((F.coalesce("status", F.lit("")) != "rejected") & F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "products")) if active_only else ours


def mark_rejected(docs: DataFrame, noise: Column, reason: str) -> DataFrame:
    """docs whose noise is marked: status, reason, and tags with `rejected` in place of `products`."""
    tags = F.array_union(F.array_except("tags", F.array(F.lit("products"))), F.array(F.lit("rejected")))
    return docs.withColumns({"tags": F.when(noise, tags).otherwise(F.col("tags")), "status": F.when(noise, "rejected").otherwise(F.col("status")), "reason": F.when(noise, reason).otherwise(F.lit(None).cast("string"))})


def confidence(entity: Column | str) -> Column:
    e = _c(entity)
    return F.when(e.contains("(非中国)") | e.contains("(韩国)") | e.contains("(巴西)"), "Confirmed").when(e.contains("/") & ~e.contains("中国"), "Strongly linked").when(e.contains("可能"), "Probable").otherwise("Strongly linked")


def albums_by_account(articles: DataFrame) -> DataFrame:
    """(fakeid, albums, titles): distinct albums of each account with the title first seen, most albums first."""
    flat = articles.select("fakeid", "create_time", F.explode("appmsg_album_infos").alias("a"))
    first = flat.groupBy("fakeid", "a.id").agg(F.min_by("a.title", F.struct("create_time", "a.title")).alias("title"))
    return first.groupBy("fakeid").agg(F.count("*").alias("albums"), F.array_sort(F.collect_list("title")).alias("titles")).orderBy(F.desc("albums"), "fakeid")


def album_list(raw: Column | str) -> Column:
    """The article list of an album response as an array, also where a single object stands for it."""
    v = F.try_parse_json(_c(raw))
    item = "struct<title: string, url: string, create_time: string, msgid: string, itemidx: string>"
    many = F.try_variant_get(v, "$.getalbum_resp.article_list", f"array<{item}>")
    one = F.try_variant_get(v, "$.getalbum_resp.article_list", item)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{item}>"))


def import_accounts(raw: DataFrame, usefor: str, column: str = "json") -> DataFrame:
    """Accounts of an exported file for the same use, with counters at zero."""
    shape = "struct<usefor: string, accounts: array<struct<fakeid: string, nickname: string, round_head_img: string>>>"
    rows = raw.select(F.from_json(column, shape).alias("f")).filter(F.col("f.usefor") == usefor).select(F.explode("f.accounts").alias("a")).select("a.*")
    return rows.filter("fakeid <> ''").dropDuplicates(["fakeid"]).withColumns({c: F.lit(0).cast("long") for c in ("count", "articles", "total_count")} | {"completed": F.lit(False)})


def resources_found(maps: DataFrame, resources: DataFrame) -> DataFrame:
    """(url, resource) of the resources of each page that are stored."""
    return maps.select("url", F.explode("resources").alias("resource")).distinct().join(resources.select(F.col("url").alias("resource")).distinct(), "resource", "left_semi").select("url", "resource")


def single_publishers(products: DataFrame, known: DataFrame) -> DataFrame:
    """Products whose publisher, up to a bracket, occurs once and is not in known (publisher)."""
    rows = products.withColumn("__p", F.trim(F.split("publisher", "（")[0]))
    once = rows.groupBy("__p").count().filter("count = 1").select("__p")
    return rows.join(once, "__p", "left_semi").join(known.select(F.col("publisher").alias("__p")).distinct(), "__p", "left_anti").drop("__p")


def first_metadata(*objects: Column, old: Column, field: str) -> Column:
    """A count of the first of several parsed objects that has it, else the old one, else 0."""
    return F.coalesce(*[o[field].try_cast("long") for o in objects], old, F.lit(0).cast("long"))


def search_results(page: Column | str) -> Column:
    """Structs (document_id, account, title, url, epoch) of a result page's list items that link somewhere."""
    items = F.regexp_extract_all(_c(page), F.lit(r"(?is)(<li\b.*?</li>)"), F.lit(1))

    def plain(x: Column) -> Column:
        return collapse(html.decode_entities(F.regexp_replace(x, r"(?s)<[^>]*>", "")))

    def one(i: Column) -> Column:
        anchor = r"""(?is)<h3[^>]*>.*?<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
        epoch = F.regexp_extract(i, r"timeConvert\('(\d+)'\)", 1)
        return F.struct(
            F.regexp_extract(i, r"""(?is)^<li\b[^>]*?\bd=["']([^"']*)["']""", 1).alias("document_id"),
            plain(F.regexp_extract(i, r"""(?is)<[a-z]+\b[^>]*class=["'][^"']*all-time-y2[^"']*["'][^>]*>(.*?)</""", 1)).alias("account"),
            plain(F.regexp_extract(i, anchor, 2)).alias("title"),
            html.decode_entities(F.regexp_extract(i, anchor, 1)).alias("url"),
            F.coalesce(epoch.try_cast("long"), F.lit(0).cast("long")).alias("epoch"),
        )

    return F.filter(F.transform(items, one), lambda r: r["url"] != "")


def ranked_candidates(pages: DataFrame, page: str, name: str, floor: Column, order: str, most: int = 300) -> DataFrame:
    """Hits of an account over result pages in the order of a column: of one document id, or else of one account, time and title, the last counts; newest first, `most` of them; hits without a time last."""
    rows = pages.withColumn("__i", F.col(order)).select("__i", F.posexplode(search_results(page)).alias("__k", "r")).select("__i", "__k", "r.*")
    mine = rows.filter(wanted_candidate(F.col("account"), name, F.col("epoch"), floor))
    identity = F.when(F.col("document_id") != "", F.struct("document_id", F.lit(None).cast("string").alias("a"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("string").alias("t"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("document_id"), F.col("account").alias("a"), F.col("epoch").alias("e"), F.col("title").alias("t"))
    )
    w = W.partitionBy(identity).orderBy(F.desc("__i"), F.desc("__k"))
    return mine.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").orderBy(F.desc("epoch"), "__i", "__k").limit(most).drop("__i", "__k")


def mirror_links(pages: DataFrame, page: str, title: str, most: int = 5) -> DataFrame:
    """Distinct links whose text is exactly the title, up to `most`."""
    found = F.regexp_extract_all(F.col(page), F.lit(r"""(?is)(<a\b[^>]*?href=["'][^"']*["'][^>]*>.*?</a>)"""), F.lit(1))
    rows = pages.select(F.explode(found).alias("a"))
    label = collapse(F.regexp_replace("a", r"(?s)<[^>]*>", ""))
    return rows.filter(label == title).select(html.decode_entities(F.regexp_extract("a", r"""(?i)href=["']([^"']*)["']""", 1)).alias("url")).distinct().orderBy("url").limit(most)


def about_fields(page: Column | str, labels: dict[str, str]) -> Column:
    """Struct of the values that follow labels on an about page, by name; empty where a label is missing."""
    plain = F.regexp_replace(_c(page), r"(?s)<[^>]*>", "\n")
    return F.struct(*[collapse(F.regexp_extract(plain, rf"(?m)^\s*{label}\s*[：:]?\s*$\s*^\s*(\S.*?)\s*$", 1)).alias(name) for name, label in labels.items()])


def article_meta(page: Column | str) -> Column:
    """Struct of title, account, digest, cover, biz, mid, idx, sn, create_time of an article page: meta data first, then script values."""
    def meta(name: str) -> Column:
        return html.decode_entities(F.regexp_extract(_c(page), rf"""(?i)<meta\b[^>]*?(?:property|name)=["']{name}["'][^>]*?content=["']([^"']*)["']""", 1))

    name = collapse(F.regexp_replace(F.regexp_extract(_c(page), r"""(?is)id=["']js_name["'][^>]*>(.*?)</""", 1), r"(?s)<[^>]*>", ""))
    return F.struct(
        first_filled(collapse(meta("og:title")), html.title(page)).alias("title"), first_filled(name, meta("author")).alias("account"), F.left(first_filled(meta("og:description"), meta("description")), F.lit(160)).alias("digest"), meta("og:image").alias("cover"),
        *[html.assigned(page, k).alias(k) for k in ("biz", "mid", "idx", "sn")], F.coalesce(html.assigned(page, "oriCreateTime").try_cast("long"), F.lit(0).cast("long")).alias("create_time"),
    )


def _unescaped(x: Column) -> Column:
    """A script string with \\xHH, \\uHHHH and quoted characters decoded; any other backslash stays."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)(?:\\u[0-9a-fA-F]{4})+|\\x[0-9a-fA-F]{2}|\\.|[^\\]+|\\"), F.lit(0))
    named = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"} | {c: c for c in "\\'\"/"}

    def decoded(p: Column) -> Column:
        code = F.when(p.rlike(r"^\\u[0-9a-fA-F]{4}"), F.replace(p, F.lit("\\u"), F.lit(""))).when(p.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.concat(F.lit("00"), F.substring(p, 3, 2)))
        plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, v in named.items() for v in (f"\\{k}", v)]), p), p)
        return F.when(code.isNotNull(), F.decode(F.unhex(code), "UTF-16BE")).otherwise(plain)

    return F.array_join(F.transform(parts, decoded), "")


def joined_redirect(page: Column | str) -> Column:
    """The URL that a redirect page puts together from `url += '...'` fragments, which may hold quoted characters."""
    parts = F.regexp_extract_all(_c(page), F.lit(r"(?s)\burl\s*\+=\s*'([^'\\]*+(?:\\.[^'\\]*+)*+)'"), F.lit(1))
    return F.array_join(F.transform(parts, _unescaped), "")


def article_text(row: Column) -> Column:
    """Title, blank line and text of a parsed page by its kind; a paid preview gives its description."""
    content = F.coalesce(row["content_noencode"], F.lit(""))
    told = F.coalesce(row["text_page_info"]["content_noencode"], F.lit(""))
    kind = row["item_show_type"]
    fallback = F.left(first_filled(collapse(told), collapse(row["title"]), F.lit("(无标题)")), F.lit(20))
    named = F.when(row["text_page_info"]["is_user_title"].cast("string") == "1", first_filled(row["title"], fallback)).otherwise(fallback)
    title = F.when(kind.isin(0, 8), first_filled(row["title"], F.lit("(无标题)"))).when(kind == 10, named).otherwise("(unknown)")
    stripped = html.decode_entities(F.regexp_replace(content, r"(?s)<[^>]*>", ""))
    body = F.when(kind == 0, first_filled(stripped, row["title"])).when(kind == 8, content).when(kind == 10, first_filled(told, row["title"])).otherwise("")
    preview = (row["is_pay_subscribe"] == 1) & ((F.trim(content) == "") | content.contains("mp-pay-preview-filter"))
    paid = F.concat(title, F.lit("\n\n[付费文章]\n"), F.trim(first_filled(row["pay_subscribe_info"]["desc"], F.lit("[付费内容]"))))
    return F.when(preview, paid).otherwise(F.concat(title, F.lit("\n\n"), text.collapse_ends(body)))


def recovered(manifest: DataFrame, account: str, biz: str, canonical_only: bool = False) -> DataFrame:
    """Article rows of an account's export manifest (title, account, url, publish_date, mtime_ms).

    Records of the account are taken by the id in their URL or by name; those whose URL is none of
    the medium's, or names another account, give no row. A date that is none gives way to the time
    of the file. canonical_only: the URL must name account, message and item, and the date must be one.
    """
    names = of_account(collapse("account"), F.col("url"), collapse(F.lit(account)), biz)
    rows = manifest.filter(names).withColumn("link", urls.export_link("url")).withColumn("__biz", filled(urls.param("link", "__biz")))
    rows = rows.filter(F.col("link").isNotNull() & F.coalesce(F.col("__biz") == biz, F.lit(True)))
    if canonical_only:
        rows = rows.filter(F.col("__biz").isNotNull() & urls.positive(urls.message_id("link")) & urls.positive(urls.item_index("link")) & publish_epoch("publish_date").isNotNull())
    at = F.coalesce(publish_epoch("publish_date"), F.floor(F.col("mtime_ms") / 1000))
    index = F.when(urls.positive(urls.item_index("link")), urls.item_index("link").try_cast("int")).otherwise(1)
    return article_rows(rows, fakeid=F.lit(biz), aid=urls.aid_of("link"), link="link", author_name="account", create_time=at, update_time=at, itemidx=index)


#: Marks of a page that was withheld, and labels of a mirror's page (fixed values).
WITHHELD, MIRROR_SOURCE, MIRROR_TIME = ("环境异常", "访问过于频繁"), "来源：", "时间："
#: Longest label of a mirror's page, and characters of a digest (fixed values).
LABEL_CHARS, DIGEST_CHARS = 160, 240
#: Where an article page says what (fixed values).
ARTICLE_FIELDS = {
    "og_title": Field('meta[property="og:title"]', "@content"), "page_title": Field(".rich_media_title"), "name": Field("#js_name"), "nickname": Field(".profile_nickname"), "author": Field('meta[name="author"]', "@content"),
    "cover": Field('meta[property="og:image"]', "@content"), "digest": Field('meta[name="description"]', "@content"), "full": Field("#js_content", "full"),
}
MIRROR_FIELDS = {
    "title": Field("h1"), "labels": Field("div", "texts"), "original": Field('a[href*="mp.weixin.qq.com/s"]', "@href"),
    "body": Field(".kch-detailBox", "html", ("script", "style", "link", "noscript", "iframe")), "full": Field(".kch-detailBox", "full", ("script", "style", "link", "noscript", "iframe")),
}


def article_url(link: Column) -> Column:
    """The link without its fragment if it is one of an article, else null."""
    bare = F.regexp_replace(F.trim(link), "#.*$", "")
    return F.when(bare.rlike(r"^https://mp\.weixin\.qq\.com/s(?:/[A-Za-z0-9_-]+)?(?:\?.*)?$"), bare)


def verified_article(page: Column | str, expected_biz: Column | str, link: Column | str) -> Column:
    """Struct of a page's article, with reason: why it is not the account's article, or null where it is verified.

    The page must not be withheld, name the account that was expected, a message, a place and a time
    of ten digits, hold text or an image, and have a title and the name of an account.
    """
    page, link = _c(page), _c(link)

    def checked(f: Column) -> Column:
        biz, mid, idx, sn = (html.assigned(page, k) for k in ("biz", "mid", "idx", "sn"))
        number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
        at = F.coalesce(F.nullif(F.regexp_extract(page, r"""var\s+oriCreateTime\s*=\s*["'](\d{10})["']""", 1), F.lit("")), F.regexp_extract(page, r"""\bori_create_time:\s*["'](\d{10})["']""", 1))
        title, account = first_filled(f["og_title"], f["page_title"], F.lit("")), first_filled(f["name"], f["nickname"], F.lit(""))
        reason = (
            F.when(F.array_contains(F.array(*[page.contains(w) for w in WITHHELD]), True), "withheld")
            .when((biz == "") | (biz != _c(expected_biz)), "account differs")
            .when((number(mid) == 0) | (number(idx) == 0) | (number(at) == 0) | ~f["full"], "incomplete")
            .when((title == "") | (account == ""), "no title or account")
            .when(article_url(link).isNull(), "no article link")
        )
        canonical = F.concat(F.lit("https://mp.weixin.qq.com/s?__biz="), F.url_encode(biz), F.lit("&mid="), number(mid), F.lit("&idx="), number(idx), F.when(sn != "", F.concat(F.lit("&sn="), F.url_encode(sn))).otherwise(""))
        return F.struct(
            reason.alias("reason"), F.concat_ws("_", number(mid), number(idx)).alias("aid"), account.alias("account"), title.alias("title"), f["author"].alias("author"), biz.alias("biz"), number(mid).alias("mid"), number(idx).alias("idx"),
            number(at).alias("publish_time"), f["cover"].alias("cover"), F.left(f["digest"], F.lit(DIGEST_CHARS)).alias("digest"), canonical.alias("canonical_link"), article_url(link).alias("link"),
        )

    return text.bind(select_fields(page, ARTICLE_FIELDS), checked)


def mirror_article(page: Column | str) -> Column:
    """Struct of a mirror's page: title, account, publish_date, original_url, body and reason, which is null where all are there."""

    def checked(f: Column) -> Column:
        labels = F.filter(f["labels"], lambda t: F.char_length(t) <= LABEL_CHARS)
        sources = F.array_sort(F.transform(F.filter(labels, lambda t: t.startswith(MIRROR_SOURCE)), lambda t, k: F.struct(F.char_length(t).alias("n"), k.alias("k"), t.alias("t"))))
        account = F.coalesce(collapse(F.replace(F.get(sources, F.lit(0))["t"], F.lit(MIRROR_SOURCE), F.lit(""))), F.lit(""))
        dated = F.get(F.filter(labels, lambda t: t.rlike(rf"^{MIRROR_TIME}\d{{4}}-\d{{2}}-\d{{2}}$")), F.lit(0))
        date = F.coalesce(F.right(dated, F.lit(10)), F.lit(""))
        original = article_url(f["original"])
        reason = F.when(original.isNull(), "no original link").when((f["title"] == "") | (account == "") | (date == "") | ~f["full"], "incomplete")
        return F.struct(reason.alias("reason"), f["title"].alias("title"), account.alias("account"), date.alias("publish_date"), original.alias("original_url"), f["body"].alias("body"))

    return text.bind(select_fields(page, MIRROR_FIELDS), checked)


AUTH = "struct<principal: string, userName: string, appId: string, relativeURL: string, category: array<struct<id: string, name: string, desc: string>>>"
PLACE = "struct<countryName: string, countryId: string, provinceName: string, provinceId: string, cityName: string, cityId: string>"


def about_data(page: Column | str) -> Column:
    """Struct of what an about page's scripts hold: services that act for the account, and its place.

    Services stand in an assigned list and in calls that add to it; of those that agree in principal,
    user name and app id the first counts.
    """
    base = F.from_json(html.html_script_value(page, "cgiData"), f"struct<auth_3rd_list: array<{AUTH}>>")["auth_3rd_list"]
    pushed = F.from_json(html.html_call_arguments(page, "window.cgiData.auth_3rd_list.push"), f"array<{AUTH}>")
    none = F.array().cast(f"array<{AUTH}>")
    every = F.filter(F.concat(F.coalesce(base, none), F.coalesce(pushed, none)), lambda a: a.isNotNull())

    def distinct(all_of: Column) -> Column:
        keys = F.transform(all_of, lambda a: F.to_json(F.struct(*[F.coalesce(a[k], F.lit("")).alias(k) for k in ("principal", "userName", "appId")])))
        return text.bind(F.struct(all_of.alias("a"), keys.alias("k")), lambda s: F.filter(s["a"], lambda a, k: F.array_position(s["k"], F.get(s["k"], k)) == k + 1))

    place = F.from_json(html.html_script_value(page, "ip_wording"), PLACE)
    return F.struct(text.bind(every, distinct).alias("services"), place.alias("place"))


#: Title and author of an article of which only the link is known (fixed values).
UNTITLED, NOBODY = "未命名文章", "--"


def stub_rows(links: DataFrame, link: str, now: Column) -> DataFrame:
    """An article row for each link alone: account, message and place from the link, times of now, nothing fetched."""
    fakeid, mid, idx = (F.coalesce(urls.param(link, k), F.lit("")) for k in ("__biz", "mid", "idx"))
    own = links.select(F.col(link).alias("link"), fakeid.alias("fakeid"), mid.alias("mid"), idx.alias("idx"))
    return article_rows(own, fakeid="fakeid", aid=F.concat_ws("_", "mid", "idx"), link="link", title=F.lit(UNTITLED), author_name=F.lit(NOBODY), create_time=now, update_time=now, itemidx=F.coalesce(F.col("idx").try_cast("int"), F.lit(0)))


#: Elements that tell a fetched page: its content, and what stands where it was deleted (fixed values).
COMPLETENESS = {"content": Field("#js_content", "@id"), "layout": Field("#js_fullscreen_layout_padding", "@id")}


def completeness(page: Column | str) -> Column:
    """complete, deleted (to be passed over) or failed (to be fetched again), by the elements that a page has."""
    return text.bind(select_fields(F.coalesce(_c(page), F.lit("")), COMPLETENESS), lambda f: F.when(f["content"] != "", "complete").when(f["layout"] != "", "deleted").otherwise("failed"))


def grid(articles: DataFrame, keyword: str = "", hide_deleted: bool = False, order: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    """Rows whose title holds a keyword, white space collapsed and in any case, without deleted ones if they are hidden, by any columns (name, descending); nulls last."""
    wanted = " ".join(keyword.split()).lower()
    rows = articles.filter(F.lower(collapse(F.coalesce("title", F.lit("")))).contains(wanted)) if wanted else articles
    rows = rows.filter(~F.coalesce("is_deleted", F.lit(False))) if hide_deleted else rows
    return rows.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]) if order else rows
