"""Dedup, upserts, counts and linkage over keyed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions.text import filled
from folioscope.functions.urls import message_of
from folioscope.operators import graphs


def _pick(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key: the limit of one row a key is applied in every task before the shuffle too, so a hot key sends a row a task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by seq; seq must order rows totally within a key."""
    return _pick(df, keys, F.col(seq).asc())


def last_wins(df: DataFrame, keys: list[str], *seq: str) -> DataFrame:
    return _pick(df, keys, *[F.col(s).desc() for s in seq])


def last_wins_in_place(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key, with `place`, the seq at which the key first came."""
    return last_wins(df.withColumn("place", F.min(seq).over(W.partitionBy(*keys))), keys, seq)


def richest_wins(df: DataFrame, key: Column, strong: Column, fields: list[str], seq: str) -> DataFrame:
    """Of each key the first row with a strong id, else the row with most filled fields, ties to the first."""
    n = reduce(lambda a, b: a + b, [F.when(filled(F.col(f).cast("string")).isNotNull(), 1).otherwise(0) for f in fields])
    has = filled(strong).isNotNull()
    w = W.partitionBy("__k").orderBy(has.desc(), F.when(has, 0).otherwise(-n), F.col(seq))
    return df.withColumn("__k", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__k")


def upgrade(df: DataFrame, keys: list[str], unknown: Column, seq: str) -> DataFrame:
    """The first row of each key, replaced once by the first that is not unknown."""
    return _pick(df, keys, unknown.cast("int"), F.col(seq))


def only_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; the duplicates are found by a count that combines before the shuffle."""
    once = df.groupBy(*keys).count().filter("count = 1").drop("count")
    return df.join(once, keys, "left_semi")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """stored with each key of new fully replaced by its last row in new."""
    latest = last_wins(new, keys, seq).drop(seq)
    return stored.join(latest, keys, "left_anti").unionByName(latest.select(*stored.columns))


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the non-null columns of changes (one row per key) put over its own."""
    renamed = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    joined = df.join(renamed, df[key] == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in df.columns])


def touch(df: DataFrame, touched: DataFrame, key: str, column: str, now: Column) -> DataFrame:
    """df with a time set to now in the rows whose key is touched; a key without a row makes none."""
    known = touched.select(F.col(key).alias("__key")).distinct()
    joined = df.join(known, df[key] == F.col("__key"), "left")
    return joined.select(*[F.when(F.col("__key").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def delete_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame, cleared: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Each table without the rows whose key is in gone; a cleared table loses all its rows, whatever the keys."""
    return {name: t.filter(F.lit(False)) if name in cleared else t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def new_counts(rows: DataFrame, stored: DataFrame, account: str, aid: str, parts: int | None = None) -> DataFrame:
    """(account, articles, messages): distinct articles not stored, and messages of which no article is.

    rows and stored hold account and aid. An article counts if its key is not stored; a message
    counts if none of its articles is. parts: over how many tasks the articles are dealt, for tables
    that are large; else the session decides.
    """
    def marked(df: DataFrame, new: bool) -> DataFrame:
        return df.select(account, message_of(aid).alias("__msg"), F.col(aid).alias("__aid"), F.lit(new).alias("__new"))

    # one pass over both tables: what is known of an article, then of its message, then of the account
    both = marked(rows, True).unionByName(marked(stored, False))
    if parts:
        # few articles repeat, so a task would keep all of its rows before the shuffle and again behind it
        both = both.repartition(parts, account, "__msg", "__aid")
    of_article = both.groupBy(account, "__msg", "__aid").agg(F.bool_and("__new").alias("__fresh"))
    of_message = of_article.groupBy(account, "__msg").agg(F.count_if("__fresh").alias("__n"), F.bool_and("__fresh").alias("__unseen"))
    n = F.sum("__n")
    return of_message.groupBy(account).agg(n.alias("articles"), F.count_if((F.col("__n") > 0) & F.col("__unseen")).alias("messages")).filter("articles > 0")


def reconciled_total(reported: Column, stored: Column, new: Column) -> Column:
    return F.greatest(reported, stored + new)


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[list[tuple[str, str]], bool]]) -> DataFrame:
    """(left_id, right_id, tier): the first tier in which a row of left meets a row of right.

    A tier is pairs of columns that must be equal and not empty, and whether the key must be
    unique on the right. Of several rows the one with the smallest right_id counts. Each tier's
    key is reduced to one row before its join, so no tier fans out.
    """
    out = left
    found: list[Column] = []
    for n, (pairs, unique) in enumerate(tiers, 1):
        keys = [F.col(r).alias(f"__{n}_{k}") for k, (_, r) in enumerate(pairs)]
        table = right.select(*keys, F.col(right_id).alias("__id")).groupBy(*[f"__{n}_{k}" for k in range(len(pairs))]).agg(F.min("__id").alias(f"__id{n}"), F.count("*").alias(f"__c{n}"))
        if unique:
            table = table.filter(f"__c{n} = 1")
        on = reduce(lambda a, b: a & b, [filled(F.col(c).cast("string")).isNotNull() & (F.col(c) == F.col(f"__{n}_{k}")) for k, (c, _) in enumerate(pairs)])
        out = out.join(table, on, "left")
        found.append(F.col(f"__id{n}"))
    tier = reduce(lambda rest, n: F.when(F.col(f"__id{n}").isNotNull(), n).otherwise(rest), range(len(tiers), 0, -1), F.lit(None).cast("int"))
    return out.select(F.col(left_id), F.coalesce(*found).alias(right_id), tier.alias("tier"))


def either_key_anti(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which no key is among the same key of stored: one anti join per key, never an OR."""
    for k in keys:
        rows = rows.join(stored.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def recover(rows: DataFrame, stored: DataFrame, account: str, key: str, link: str, seq: str) -> DataFrame:
    """New rows in order of seq, without those whose key or link is stored or was kept before.

    Greedy within an account: a row that is left out blocks no later one. Rows whose key and link no
    other new row of the account has are kept as they are; only the others go through the rounds of
    `graphs.greedy`, where an account of any size is spread over tasks. Null accounts, keys and links
    are equal to each other.
    """
    fresh = either_key_anti(rows, stored, [key, link])
    shared = [fresh.groupBy(account, c).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n").withColumn(f"__shares_{c}", F.lit(True)) for c in (key, link)]
    marked = fresh.join(shared[0], [account, key], "left").join(shared[1], [account, link], "left")
    clash = F.coalesce(f"__shares_{key}", f"__shares_{link}", F.lit(False)) | F.col(account).isNull() | F.col(key).isNull() | F.col(link).isNull()
    alone, some = marked.filter(~clash).select(*fresh.columns), marked.filter(clash).select(*fresh.columns)

    return alone.unionByName(graphs.greedy(some, [[account, key], [account, link]], seq))


def match_cardinality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with `matches`, the number of rows of right with its keys, and `status`: missing, matched or ambiguous."""
    n = right.groupBy(*keys).agg(F.count("*").alias("matches"))
    m = F.coalesce("matches", F.lit(0).cast("long"))
    return left.join(n, keys, "left").withColumn("matches", m).withColumn("status", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "matched").otherwise("ambiguous"))


def audit(catalog: DataFrame, local: DataFrame, key: str, date: str) -> DataFrame:
    """catalog (key, date) with status against local: unique keys on both sides match; matched dates may differ.

    missing, ambiguous, matched or date-mismatch; local_date of the match. A key that repeats on
    either side is ambiguous.
    """
    here = catalog.groupBy(key).agg(F.count("*").alias("__here"))
    there = local.groupBy(key).agg(F.count("*").alias("__there"), F.min(date).alias("local_date"))
    both = catalog.join(here, key).join(there, key, "left")
    status = F.when(F.col("__there").isNull(), "missing").when((F.col("__here") > 1) | (F.col("__there") > 1), "ambiguous").when(F.col(date) == F.col("local_date"), "matched").otherwise("date-mismatch")
    return both.withColumn("status", status).withColumn("local_date", F.when(F.col("status").isin("matched", "date-mismatch"), F.col("local_date"))).drop("__here", "__there")


def compare_identity(have: tuple[Column, ...], want: tuple[Column, ...]) -> Column:
    """verified, mismatch, repair or untrusted of two (biz, mid, idx): full, conflicting, partial or unknown identity."""
    full = reduce(lambda a, b: a & b, [h.isNotNull() for h in have])
    same = reduce(lambda a, b: a & b, [h == w for h, w in zip(have, want, strict=True)])
    clash = reduce(lambda a, b: a | b, [F.coalesce(h != w, F.lit(False)) for h, w in zip(have, want, strict=True)])
    known = reduce(lambda a, b: a & b, [w.isNotNull() for w in want])
    return F.when(~known, "untrusted").when(full & same, "verified").when(clash, "mismatch").otherwise("repair")


def enrich(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """left with the columns of right (one row per key) that it lacks, and whether a row was found."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(F.col(key).alias("__key"), *extra, F.lit(True).alias("__hit")), left[key] == F.col("__key"), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def merge_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer merge that keeps the filled values of a and takes the others of b; both have the same columns."""
    x, y = a.alias("x"), b.alias("y")
    cols = [F.coalesce(F.col(f"x.{key}"), F.col(f"y.{key}")).alias(key)]
    for c in a.columns:
        if c != key:
            own, other = F.col(f"x.{c}"), F.col(f"y.{c}")
            cols.append(F.coalesce(F.when(own.cast("string") != "", own), other).alias(c))
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full").select(*cols)


def counters(old: DataFrame, new: DataFrame, key: str, adds: list[str], sticky: str, replace: bool = False) -> DataFrame:
    """Account counters after a write: sums add up, a completion once true stays; replace: what is written of it counts."""
    x, y = old.alias("x"), new.alias("y")
    cols = [F.coalesce(F.col(f"x.{key}"), F.col(f"y.{key}")).alias(key)]
    cols += [(F.coalesce(F.col(f"x.{c}"), F.lit(0)) + F.coalesce(F.col(f"y.{c}"), F.lit(0))).alias(c) for c in adds]
    either = F.coalesce(F.col(f"x.{sticky}"), F.lit(False)) | F.coalesce(F.col(f"y.{sticky}"), F.lit(False))
    cols.append((F.coalesce(F.col(f"y.{sticky}"), F.col(f"x.{sticky}"), F.lit(False)) if replace else either).alias(sticky))
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full").select(*cols)
