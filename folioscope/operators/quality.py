"""Metrics, conflicts, gates and upsert plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import names
from folioscope.functions.text import content_hash, quality_key

#: Limits of the gate (fixed values).
LIMITS = {"max_unknown_publisher_ratio": 0.60, "max_suspicious_name_ratio": 0.0, "max_publisher_conflict_ratio": 0.02}


def conflicts(rows: DataFrame, key: str, value: str, source: str, most: int = 10) -> DataFrame:
    """Keys with several values: n_values, the sorted values, and the first sources; `most` is the report's length.

    Values are made distinct before they meet, and sources are ranked per key before they are listed.
    """
    from pyspark.sql import Window as W

    many = rows.filter(F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(value)).alias("values")).filter("n_values > 1")
    some = rows.select(key, source).distinct().withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(source))).filter(F.col("__n") <= most)
    listed = some.groupBy(key).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return many.join(listed, key)


def metrics(products: DataFrame, articles: DataFrame, article_key: str) -> DataFrame:
    """One row of metrics over products (article_key, name, publisher, candidates) and articles.

    Without products the unknown and suspicious ratios are 1 and the conflict ratio 0.
    """
    known = F.filter("candidates", lambda c: (c != "") & ~c.isin(names.UNKNOWN, names.CONFLICT))
    own = F.coalesce(F.nullif(F.trim("publisher"), F.lit("")), F.lit(names.UNKNOWN))
    rows = products.select(article_key, F.trim("name").alias("name"), own.alias("publisher"), known.alias("known")).withColumn("key", quality_key("name"))
    totals = rows.agg(
        F.count("*").alias("product_record_count"),
        F.count_if((F.col("publisher") == names.UNKNOWN) & (F.size("known") == 0)).alias("unknown_publisher_count"),
        F.count_if(F.size(names.suspicious("name")) > 0).alias("suspicious_name_count"),
    )
    single = F.when(~F.col("publisher").isin(names.UNKNOWN, names.CONFLICT), F.array("publisher")).otherwise(F.array().cast("array<string>"))
    said = rows.filter("key <> ''").select("key", F.explode_outer(F.when(F.size("known") > 0, F.col("known")).otherwise(single)).alias("p"))
    per_key = said.groupBy("key").agg(F.count_distinct("p").alias("n"))
    keys = per_key.agg(F.count("*").alias("unique_product_count"), F.count_if(F.col("n") > 1).alias("publisher_conflict_count"))
    empty = articles.select(article_key).distinct().join(rows.select(article_key).distinct(), article_key, "left_anti").agg(F.count("*").alias("articles_without_products_count"))
    n = articles.agg(F.count("*").alias("article_count"))

    def ratio(a: str, b: str, none: float) -> Column:
        return F.round(F.when(F.col(b) == 0, F.lit(none)).otherwise(F.col(a) / F.col(b)), 6)

    one = totals.crossJoin(keys).crossJoin(empty).crossJoin(n)  # one row each
    return (
        one.withColumn("unknown_publisher_ratio", ratio("unknown_publisher_count", "product_record_count", 1.0))
        .withColumn("suspicious_name_ratio", ratio("suspicious_name_count", "product_record_count", 1.0))
        .withColumn("publisher_conflict_ratio", ratio("publisher_conflict_count", "unique_product_count", 0.0))
    )


def gate(m: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """metrics with failures, warnings and status; any suspicious name fails."""
    def tags(*pairs: tuple[str, Column]) -> Column:
        return F.filter(F.array(*[F.when(hit, F.lit(tag)) for tag, hit in pairs]), lambda t: t.isNotNull())

    failures = tags(("no_articles", F.col("article_count") == 0), ("no_products", F.col("product_record_count") == 0), ("suspicious_product_names", F.col("suspicious_name_count") > 0))
    warnings = tags(
        ("unknown_publisher_ratio_exceeded", F.col("unknown_publisher_ratio") > limits["max_unknown_publisher_ratio"]),
        ("publisher_conflict_ratio_exceeded", F.col("publisher_conflict_ratio") > limits["max_publisher_conflict_ratio"]),
        ("articles_without_products", F.col("articles_without_products_count") > 0),
    )
    return m.withColumn("failures", failures).withColumn("warnings", warnings).withColumn("status", F.when(F.size("failures") == 0, "pass").otherwise("fail"))


def upsert_plan(old: DataFrame, new: DataFrame, key: str, columns: list[str], foreign: Column | None = None) -> DataFrame:
    """(key, action, content_hash): created, updated, unchanged, or skipped where the stored row is not ours."""
    held = old.select(key, content_hash(*columns).alias("__old"), (F.lit(False) if foreign is None else foreign).alias("__foreign"))
    both = new.select(key, content_hash(*columns).alias("content_hash")).join(held, key, "left")
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__foreign"), "skipped-existing-foreign").when(F.col("__old") == F.col("content_hash"), "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"), "content_hash")


def plan_digest(plan: DataFrame, key: str) -> DataFrame:
    """(rows, digest): a digest of a plan that does not depend on its order, combined on the executors."""
    h = F.xxhash64(key, "action", "content_hash")
    return plan.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(F.pmod(h, F.lit(1 << 31))).cast("string")), 256).alias("digest"))


def noise_by_name(docs: DataFrame, name: str, noise: Column) -> DataFrame:
    """(name, documents) of the names that are noise, most documents first."""
    return docs.filter(noise).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "name")


#: Samples that a list of the report holds.
SAMPLES = 10


def report(mentions: DataFrame, products: DataFrame, most: int = SAMPLES) -> DataFrame:
    """A row for each publisher: by how many articles it is mentioned and by how many alone, how many products are its own, its ranks in both, and samples.

    mentions: publisher, article, title, single; products: publisher, name, seq. The samples are the
    first `most` distinct titles and product names: they are ranked before they are listed, so that
    no list is longer than that on its way. Products of no known publisher have no row.
    """
    from pyspark.sql import Window as W

    def samples(rows: DataFrame, value: str, order: str, into: str) -> DataFrame:
        first = rows.groupBy("publisher", value).agg(F.min(order).alias("__at"))
        ranked = first.withColumn("__n", F.row_number().over(W.partitionBy("publisher").orderBy("__at", value))).filter(F.col("__n") <= most)
        return ranked.groupBy("publisher").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda s: s[value]).alias(into))

    known = products.filter(~F.col("publisher").isin(names.UNKNOWN, names.CONFLICT) & (F.col("publisher") != ""))
    told = mentions.groupBy("publisher").agg(F.count("*").alias("articles"), F.count_if("single").alias("alone"))
    own = known.groupBy("publisher").agg(F.count("*").alias("products"), F.count_distinct("name").alias("names"))
    both = told.join(own, "publisher", "full").join(samples(mentions, "title", "article", "titles"), "publisher", "left").join(samples(known, "name", "seq", "product_names"), "publisher", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    rows = both.select("publisher", *[F.coalesce(c, zero).alias(c) for c in ("articles", "alone", "products", "names")], *[F.coalesce(c, none).alias(c) for c in ("titles", "product_names")])
    # one row a publisher: the ranks see that many rows
    return rows.withColumn("rank_by_articles", F.row_number().over(W.orderBy(F.desc("articles"), "publisher"))).withColumn("rank_by_products", F.row_number().over(W.orderBy(F.desc("products"), "publisher")))


def report_text(rows: DataFrame, found: DataFrame) -> str:
    """The report as Markdown: the gate's one row of metrics, then a line and the samples for each publisher by its rank, fetched one by one."""
    m = found.first()
    out = ["# Products and publishers", "", f"> {m.article_count} articles, {m.product_record_count} products, gate {m.status.upper()}: unknown publishers {m.unknown_publisher_ratio:.2%}, doubtful names {m.suspicious_name_count}, conflicts {m.publisher_conflict_count}", "", "| Rank | Publisher | Articles | Alone | Products | Names |", "|-|-|-|-|-|-|"]
    listed = []
    for r in rows.orderBy("rank_by_articles").toLocalIterator():
        out.append(f"| {r.rank_by_articles} | {r.publisher} | {r.articles} | {r.alone} | {r.products} | {r.names} |")
        listed += ["", f"## {r.publisher}", "", *[f"- **{n}**" for n in r.product_names], *[f"- {t}" for t in r.titles]]
    return "\n".join([*out, *listed, ""])
