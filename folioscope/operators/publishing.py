"""Articles as Markdown and HTML documents, what is checked before they are written, and hints in their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import html, urls
from folioscope.functions.text import _c, bind, filled
from folioscope.operators.blocks import frontmatter

IMAGE_MODES = ("cdn", "indexed")


def quoted(x: Column | str) -> Column:
    """A value as a JSON string; null is empty."""
    whole = F.to_json(F.array(F.coalesce(_c(x).cast("string"), F.lit(""))))
    return whole.substr(F.lit(2), F.char_length(whole) - 2)


def markdown_header(title: Column | str, author: Column | str, date: Column | str, url: Column | str, evidence: Column | str | None = None) -> Column:
    """Leading block of an article, and its title as a heading."""
    parts = [F.lit("---\ntitle: "), quoted(title), F.lit("\nauthor: "), quoted(author), F.lit("\ndate: "), quoted(date), F.lit("\nurl: "), quoted(url), F.lit("\n")]
    if evidence is not None:
        parts.append(F.when(filled(evidence).isNotNull(), F.concat(F.lit("source_evidence: "), quoted(evidence), F.lit("\n"))).otherwise(""))
    return F.concat(*parts, F.lit("---\n\n# "), F.coalesce(_c(title), F.lit("")), F.lit("\n\n"))


def identity_problem(page: Column | str, url: Column | str) -> Column:
    """Why a page is not the article that its URL names: no identity in the URL, or another in the page; null if it is."""
    keys = (("biz", "__biz"), ("mid", "mid"), ("idx", "idx"))
    want = [filled(urls.param(url, key)) for _, key in keys]
    known, same = F.lit(True), F.lit(True)
    for (name, _), w in zip(keys, want, strict=True):
        known, same = known & w.isNotNull(), same & (html.assigned(page, name) == w)
    return F.when(~known, "url without identity").when(~F.coalesce(same, F.lit(False)), "another article")


def documents(articles: DataFrame, images: str = "cdn") -> DataFrame:
    """path and text of each article (path, title, author, date, url, page): header, page as Markdown, images as their mode has it.

    cdn: images keep their address, with a scheme; indexed: they are named images/1, images/2 and so
    on in the order of the page. Pages without text and images give no document.
    """
    if images not in IMAGE_MODES:
        raise ValueError(f"images are one of {', '.join(IMAGE_MODES)}")
    body = html.html_markdown("page")
    shown = r"!\[([^\]]*)\]\(([^)\s]*)\)"
    if images == "cdn":
        body = F.regexp_replace(body, r"(!\[[^\]]*\]\()//", "$1https://")
    else:
        def numbered(b: Column) -> Column:
            gaps, names = F.split(b, shown, -1), F.regexp_extract_all(b, F.lit(shown), F.lit(1))
            marks = F.concat(F.transform(names, lambda n, i: F.concat(F.lit("!["), n, F.lit("](images/"), (i + 1).cast("string"), F.lit(")"))), F.array(F.lit("")))
            return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")

        body = bind(body, numbered)
    rows = articles.withColumn("__body", F.trim(F.coalesce(body, F.lit(""))))
    return rows.filter(F.regexp_replace("__body", r"(?U)\s+", "") != "").select("path", F.concat(markdown_header("title", "author", "date", "url"), F.col("__body"), F.lit("\n")).alias("text"))


def with_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """(url, html): pages whose stored resources are named by their asset.

    pages: url, html, resources (all that the page names); assets: resource, asset. Resources that
    are not stored keep their address. Assets meet pages by resource, a row each, so that one that
    all pages name is joined as any other; longer addresses are replaced first. Pages may share a
    url: each takes the assets of its own resources.
    """
    own = pages.select("url", "resources").distinct().select("url", "resources", F.explode(F.array_distinct("resources")).alias("resource"))
    held = own.join(assets, "resource").groupBy(F.col("url").alias("__url"), F.col("resources").alias("__own")).agg(F.array_sort(F.collect_list(F.struct((-F.length("resource")).alias("n"), "resource", "asset"))).alias("__held"))
    none = F.array().cast("array<struct<n:int,resource:string,asset:string>>")

    def put(a: Column, x: Column) -> Column:
        # an address stands between quotes or brackets, and may be written with entities
        plain = F.replace(a, x["resource"], x["asset"])
        return F.replace(plain, F.replace(x["resource"], F.lit("&"), F.lit("&amp;")), x["asset"])

    same = F.col("url").eqNullSafe(F.col("__url")) & (F.col("resources") == F.col("__own"))
    return pages.join(held, same, "left").select("url", F.aggregate(F.coalesce("__held", none), F.col("html"), put).alias("html"))


def data_uris(resources: DataFrame) -> DataFrame:
    """(resource, asset) of stored resources (resource, mime, content): their bytes as addresses, for pages that hold their images."""
    return resources.select("resource", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")).alias("asset"))


def preflight(docs: DataFrame, kind: str, digest: Column) -> DataFrame:
    """(doc_id, problem) of documents that must not be written: no or a repeated id, another source_type, a content_hash that is not the digest."""
    n = docs.groupBy("doc_id").agg(F.count("*").alias("__n"))
    rows = docs.withColumn("__digest", digest).join(n, docs.doc_id.eqNullSafe(n.doc_id)).drop(n.doc_id)
    problem = (
        F.when(filled(F.col("doc_id").cast("string")).isNull(), "no id")
        .when(F.col("__n") > 1, "repeated id")
        .when(~F.col("source_type").eqNullSafe(F.lit(kind)), "unexpected source_type")
        .when(~F.col("content_hash").eqNullSafe(F.col("__digest")), "content hash differs")
    )
    return rows.select("doc_id", problem.alias("problem")).filter("problem is not null").distinct()


def json_field(text: Column | str, key: str) -> Column:
    """A scalar of the leading block as its writer quoted it: JSON escapes decoded, single quotes taken off; null if it is missing."""
    block = F.regexp_extract(_c(text), r"(?s)^---(.*?)\n---", 1)
    raw = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\r\n]*)", 1))
    decoded = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    value = F.when(raw.rlike('^".*"$'), F.coalesce(decoded, raw.substr(F.lit(2), F.char_length(raw) - 2))).when(raw.rlike("^'.*'$"), raw.substr(F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
    return filled(value)


def first_lines_field(text: Column | str, key: str, most: int = 20) -> Column:
    """A scalar of a leading block that ends within the first lines, without double quotes; null if it is missing."""
    head = F.array_join(F.slice(F.split(_c(text), "\n"), 1, most), "\n")
    block = F.regexp_extract(head, r"(?s)^\s*---[ \t\r]*\n(.*?)\n[ \t]*---", 1)
    return filled(F.trim(F.regexp_extract(block, rf"""(?m)^{key}:[ \t]*"?([^\r\n]+?)"?[ \t\r]*$""", 1)))


def list_field(text: Column | str, key: str) -> Column:
    """A list of the leading block, in brackets or a dash a line, without quotes; a scalar is a list of one, a missing key none."""
    block = F.regexp_extract(_c(text), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]]*)\][ \t\r]*$", 1)
    dashed = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|$))+)", 1)
    items = F.when(dashed != "", F.regexp_extract_all(dashed, F.lit(r"(?m)^[ \t]*-[ \t]+([^\r\n]*)"), F.lit(1))).when(inline != "", F.split(inline, ",")).otherwise(F.array(F.coalesce(frontmatter(text, key), F.lit(""))))
    bare = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2"))
    return F.filter(bare, lambda x: (x != "") & (x != "[]"))


# Addresses of stores, and phrases by which a text hints at a company.
PLAY = r"""https://play\.google\.com/store/apps/details[^\s)"']+"""
APPLE = r"""https://apps\.apple\.com/[^\s)"']+"""
HINTS = (
    r"([一-鿿 A-Za-z]{2,20})的[吗吧？?]+",
    r"也就是([一-鿿 A-Za-z]{2,20})[呗吧了]",
    r"就是([一-鿿 A-Za-z]{2,20})[呗吧了]",
    r"([一-鿿 A-Za-z]{2,20})的[吧吗呗]",
)
NO_HINT = ("这", "那", "他", "她", "它", "我", "你", "都", "还", "也", "就", "很")


def store_links(text: Column | str) -> Column:
    """Struct (google_play, package_id, app_store): the first of each that a text names, null without one."""
    play = filled(F.regexp_extract(_c(text), f"({PLAY})", 1))
    return F.struct(play.alias("google_play"), filled(F.regexp_extract(play, r"""[?&]id=([^&\s)"']+)""", 1)).alias("package_id"), filled(F.regexp_extract(_c(text), f"({APPLE})", 1)).alias("app_store"))


def hints(text: Column | str, most: int = 3) -> Column:
    """Companies that a text hints at, in the order of the phrases; `most` is the length of the report."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(p), F.lit(1)) for p in HINTS]))
    kept = F.filter(F.transform(found, lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", "")), lambda h: (F.char_length(h) >= 2) & ~F.left(h, F.lit(1)).isin(*NO_HINT))
    return F.slice(kept, 1, most)
