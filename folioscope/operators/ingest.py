"""Lists of articles as they arrive: JSON inside JSON, messages with children, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions.html import decode_entities
from folioscope.functions.text import seconds_from
from folioscope.functions.urls import param
from folioscope.operators import graphs

ARTICLE = "aid string, title string, link string, cover string, digest string, create_time bigint, update_time bigint, itemidx int, item_show_type int, author_name string, copyright_type int, is_deleted boolean"
PUBLISH_PAGE = "struct<publish_list: array<struct<publish_type: int, publish_info: string>>>"
PUBLISH_INFO = f"struct<appmsgex: array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ARTICLE.split(','))}>>>"
EXT_INFO = "title: string, author: string, content_url: string, cover: string, digest: string, del_flag: int, item_show_type: int"
MESSAGES = f"struct<list: array<struct<comm_msg_info: struct<id: bigint, datetime: bigint, type: int>, app_msg_ext_info: struct<{EXT_INFO}, multi_app_msg_item_list: array<struct<{EXT_INFO}>>>>>>"


def published(pages: DataFrame, page_col: str = "publish_page") -> DataFrame:
    """One row per article of the pages' JSON in JSON, with `message`, its place on the page; empty messages drop."""
    lists = pages.withColumn("__p", F.from_json(F.col(page_col), PUBLISH_PAGE))
    infos = lists.select(*pages.columns, F.posexplode("__p.publish_list").alias("message", "__m")).filter(F.col("__m.publish_info") != "")
    items = infos.withColumn("__i", F.from_json("__m.publish_info", PUBLISH_INFO))
    return items.select(*[c for c in pages.columns if c != page_col], "message", F.explode("__i.appmsgex").alias("__a")).select("*", "__a.*").drop("__a")


def messages(pages: DataFrame, order: str, list_col: str = "general_msg_list", hosts: tuple[str, ...] = ()) -> DataFrame:
    """One row per article of multi-article messages, of pages in the order of a column: the primary and its children.

    Deleted ones (del_flag 4), ones without a link and links of foreign hosts go; of one link the last
    entry counts, at the place of its first.
    """
    from folioscope.functions.urls import host_allowed

    one = F.from_json(F.col(list_col), MESSAGES)
    rows = pages.withColumn("__i", F.col(order)).select(*[c for c in pages.columns if c != list_col], "__i", F.posexplode(one["list"]).alias("__m", "__x"))
    fields = [f.split(":")[0].strip() for f in EXT_INFO.split(",")]
    primary = F.struct(*[F.col(f"__x.app_msg_ext_info.{f}").alias(f) for f in fields])
    children = F.coalesce(F.col("__x.app_msg_ext_info.multi_app_msg_item_list"), F.array().cast(f"array<struct<{EXT_INFO}>>"))
    flat = rows.select("*", F.posexplode(F.concat(F.array(primary), children)).alias("__k", "__a")).withColumn("link", decode_entities("__a.content_url"))
    flat = flat.filter((F.coalesce("__a.del_flag", F.lit(0)) != 4) & (F.col("link") != ""))
    if hosts:
        flat = flat.filter(host_allowed("link", hosts))
    place = F.struct("__i", "__m", "__k")
    w = W.partitionBy("link")
    kept = flat.withColumn("__first", F.min(place).over(w)).withColumn("__n", F.row_number().over(w.orderBy(place.desc()))).filter("__n = 1")
    own = [c for c in pages.columns if c != list_col]
    created = seconds_from("__x.comm_msg_info.datetime").alias("create_time")
    return kept.select(*own, F.concat_ws("_", param("link", "mid"), param("link", "idx")).alias("aid"), "link", "__a.title", "__a.author", "__a.cover", "__a.digest", "__a.item_show_type", created, F.col("__first").alias("place"))


def page_valid(offset: Column, next_offset: Column, most: int = 1_000_000) -> Column:
    """Whether a page's offset advances and stays in range."""
    return (next_offset > offset) & (next_offset <= most)


def message_count(item_index: str = "itemidx") -> Column:
    """Messages of a page: articles in first place."""
    return F.count_if(F.col(item_index) == 1)


def threads(comments: DataFrame, replies: DataFrame, thread: str, order: str) -> DataFrame:
    """(thread, comments, replies, total, transcript): top-level comments with their replies, in time order, then as they stand."""
    top = comments.groupBy(thread).agg(F.count("*").alias("comments"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n")
    below = replies.groupBy(thread).agg(F.count("*").alias("replies"), listed.alias("transcript"))
    n = F.coalesce("replies", F.lit(0).cast("long"))
    return top.join(below, thread, "left").select(thread, "comments", n.alias("replies"), (F.col("comments") + n).alias("total"), F.coalesce("transcript", F.lit("")).alias("transcript"))


def pages_in_order(pages: DataFrame, thread: str, cursor: str = "buffer", following: str = "next_buffer", more: str = "continue_flag") -> DataFrame:
    """Pages of comments with place, their order in the thread, and the reason of what does not fit.

    A thread begins at the page that was asked for with an empty cursor; each page names the cursor
    of the next one as long as it says that there is more. See `graphs.chained` for the reasons.
    """
    return graphs.chained(pages, thread, cursor, following, more)


def replies_or_embedded(stored: Column, embedded: Column) -> Column:
    """The stored replies if there are any, else the embedded ones, by time and place."""
    chosen = F.when(F.coalesce(F.size(stored), F.lit(0)) > 0, stored).otherwise(embedded)
    keyed = F.transform(chosen, lambda r, i: F.struct(r["create_time"].alias("t"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda s: s["r"])
