"""Choices, chains and components over rows that name each other, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscope.session import cut_lineage

#: Rows that one task may walk through one by one; more are decided in rounds.
WALK_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (u, v) reaches.

    Alternating large-star and small-star contraction; every round is one checkpoint, the driver
    sees a count and a sum per round. Rounds grow with the logarithm of the longest chain.
    """
    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(low.select("u", F.col("m").alias("v")).unionByName(small).filter("u <> v").distinct())
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state


def greedy(rows: DataFrame, keys: list[list[str]], seq: str) -> DataFrame:
    """The rows that are kept when they are taken in the order of seq, and one that shares a key with a kept one is left out.

    keys: lists of columns; two rows share a key where they are equal in all its columns, nulls too.
    Rows of one seq stand in the order of their key columns; of equal ones any is the first.

    Each round keeps every undecided row that is first in all its keys, and leaves out what shares a
    key with those: the rows of one key are decided by one of them, wherever they lie. Rows in an
    order that does not follow their links take rounds with the logarithm of their number; a chain
    whose every row shares a key with the next one takes half its length. When WALK_ROWS or fewer
    are left, one task walks through them.
    """
    n = range(len(keys))
    held = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    order = F.struct(F.col(seq).alias("s"), *[F.col(c).alias(f"c{i}_{j}") for i, k in enumerate(keys) for j, c in enumerate(k)], F.col("__row").alias("row"))
    left = cut_lineage(held.select("__row", order.alias("at"), *[F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(k)]).alias(f"k{i}") for i, k in enumerate(keys)]))
    kept: list[DataFrame] = []
    while left.count() > WALK_ROWS:
        firsts = [left.groupBy(f"k{i}").agg(F.min("at").alias(f"m{i}")) for i in n]
        marked = reduce(lambda df, i: df.join(firsts[i], f"k{i}"), n, left)
        marked = cut_lineage(marked.withColumn("first", reduce(lambda a, b: a & b, [F.col("at") == F.col(f"m{i}") for i in n])).drop(*[f"m{i}" for i in n]))
        now = marked.filter("first")
        kept.append(now.select("__row"))
        left = cut_lineage(reduce(lambda df, i: df.join(now.select(f"k{i}"), f"k{i}", "left_anti"), n, marked.filter("not first")).drop("first"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: list[set] = [set() for _ in n]
        for pdf in batches:
            found = []
            for row, *own in zip(pdf["__row"], *[pdf[f"h{i}"] for i in n], strict=True):
                if not any(k in t for k, t in zip(own, taken, strict=True)):
                    found.append(row)
                    for k, t in zip(own, taken, strict=True):
                        t.add(k)
            yield pd.DataFrame({"__row": found})

    # a key is told by its JSON: one value for pandas, whatever its types and nulls
    told = left.select("__row", "at", *[F.to_json(f"k{i}", {"ignoreNullFields": "false"}).alias(f"h{i}") for i in n])
    kept.append(told.repartition(1).sortWithinPartitions("at").select("__row", *[f"h{i}" for i in n]).mapInPandas(walk, "__row long"))
    return held.join(reduce(DataFrame.unionByName, kept), "__row", "left_semi").drop("__row")


def chained(rows: DataFrame, group: str, at: str, following: str, more: str, first: str = "") -> DataFrame:
    """rows with place and reason: where each stands in its group's chain, which begins at `first` and goes on where `following` leads.

    A row leads on where `more` is true. place is counted from 0, and null with the reason
    `unreached` for a row that no chain comes to, and `repeated` for one whose `at` an equal or
    lesser row has. The last row of a chain that leads to no row has the reason `broken`, and that of
    a chain that leads back into itself `loop`.

    The chain is not walked: each round doubles how far a row leads, and how many are reached.
    """
    held = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    nodes = held.filter(F.col(at).isNotNull()).groupBy(F.col(group).alias("g"), F.col(at).alias("a")).agg(F.min(F.struct(F.when(F.col(more), F.col(following)).alias("b"), F.coalesce(F.col(more), F.lit(False)).alias("leads"), F.col("__row").alias("row"))).alias("m"))
    nodes = cut_lineage(nodes.select("g", "a", "m.b", "m.leads", "m.row"))
    here = nodes.select(F.col("g").alias("h"), F.col("a").alias("c"))
    same = F.col("g").eqNullSafe(F.col("h"))
    jump = cut_lineage(nodes.filter("b IS NOT NULL").join(here, same & (F.col("b") == F.col("c"))).select("g", "a", "b"))
    reached = cut_lineage(nodes.filter(F.col("a") == first).select("g", "a", F.lit(0).cast("long").alias("place")))
    far = 1
    while True:
        step = jump.select(F.col("g").alias("h"), F.col("a").alias("c"), F.col("b").alias("to"))
        found = reached.join(step, same & (F.col("a") == F.col("c"))).groupBy("g", F.col("to").alias("a")).agg((F.min("place") + far).alias("place"))
        known = reached.select(F.col("g").alias("h"), F.col("a").alias("c"))
        new = cut_lineage(found.join(known, same & (F.col("a") == F.col("c")), "left_anti"))
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        jump = cut_lineage(jump.join(step, same & (F.col("b") == F.col("c"))).select("g", "a", F.col("to").alias("b")))
        far *= 2
    place_of = reached.select(F.col("g").alias("h"), F.col("a").alias("c"), "place")
    placed = nodes.join(place_of, same & (F.col("a") == F.col("c")), "left").drop("h", "c")
    ahead = place_of.select("h", F.col("c"), F.col("place").alias("next_place"))
    named = placed.join(ahead, same & (F.col("b") == F.col("c")), "left")
    reason = (
        F.when(F.col("place").isNull(), "unreached")
        .when(F.col("leads") & F.col("next_place").isNull(), "broken")
        .when(F.col("next_place") <= F.col("place"), "loop")
    )
    told = named.select(F.col("row").alias("__row"), "place", reason.alias("reason"), F.lit(True).alias("__node"))
    out = held.join(told, "__row", "left")
    other = F.when(F.col(at).isNull(), "unreached").otherwise("repeated")
    return out.withColumn("reason", F.when(F.col("__node").isNull(), other).otherwise(F.col("reason"))).drop("__row", "__node")
