"""Exact top-k inner products, score at a time over impact-ordered segments of postings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Rows of the index that one task holds, queries that meet them in one group, and queries searched at a time.
SHARD_ROWS, QUERY_ROWS, AT_ONCE = 16_384, 4096, 256
#: Impacts are quantised to their first bits, so many steps to a doubling; members are looked for when these shares of the postings are done.
STEPS, LOOK_AT = 8, (0.7, 0.8, 0.9, 1.0)
#: Possible members per query from which on rescoring is cheaper than the next segments.
FEW = 1024


def usable(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: no null and no non-finite component.

    A vec_id names one row: of rows that repeat it the least vector counts, component by component.
    """
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class ImpactIndex:
    """Postings of integer vectors (held as doubles) in segments of one quantised impact, highest impact first.

    A segment is a dimension, a sign and an impact, with the rows that have it; an impact stands for
    all components of its step. looks: after how many segments members are looked for, with the norm
    of what each row's postings up to there leave of it.
    """

    def __init__(self, vectors: np.ndarray):
        n, width = vectors.shape
        size = np.abs(vectors)
        part, power = np.frexp(size)
        wide = np.ldexp(1.0, power) / (2 * STEPS)  # whole numbers that share an impact lie in a step this wide
        low = np.floor(part * 2 * STEPS) * wide
        value = np.sign(vectors) * (low + np.maximum(wide - 1, 0) / 2)
        row, dim = np.nonzero(size)
        order = np.lexsort((row, value[row, dim] < 0, dim, -np.abs(value[row, dim])))
        row, dim = row[order], dim[order]
        impact = value[row, dim]
        cut = np.flatnonzero(np.r_[True, (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1])]) if len(row) else np.zeros(0, np.int64)
        self.vectors, self.norm = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.rows, self.ends = row, np.r_[cut[1:], len(row)].astype(np.int64) if len(row) else cut
        self.starts, self.dims, self.impacts = cut, dim[cut], impact[cut]
        self.looks: list[tuple[int, np.ndarray]] = []
        for share in LOOK_AT:
            upto = int(np.searchsorted(self.ends, share * len(row)))
            upto = min(upto + 1, len(cut))
            done = int(self.ends[upto - 1]) if upto else 0
            left = vectors.copy()
            left[row[:done], dim[:done]] -= impact[:done]
            self.looks.append((upto, np.sqrt((left * left).sum(axis=1))))

    def members(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
        """Row numbers of all that may be among each query's k best, ties with the last included; rows whose id is its own are none.

        Segments are added up in the order of their impacts. What a row still lacks is bounded by the
        norms of the query and of the rest of the row (Cauchy-Schwarz): a row whose score and bound stay
        below the k-th largest score less bound is proved to be no member. Segments are left out only
        when the rows not so proved are few; these are rescored exactly.
        """
        n, m = len(self.vectors), len(queries)
        norm = np.sqrt((queries * queries).sum(axis=1))
        sums = np.zeros((n, m))
        mine = own[None, :] == ids[:, None]
        done = 0
        for upto, rest in self.looks:
            for s in range(done, upto):
                sums[self.rows[self.starts[s] : self.ends[s]]] += self.impacts[s] * queries[:, self.dims[s]]
            done = upto
            # besides the rest, what rounding of the sums may cost
            slack = norm[None, :] * (rest * (1 + 1e-9) + 1e-12 * self.norm)[:, None]
            low = np.where(mine, -np.inf, sums - slack)
            least = np.partition(low, n - min(k, n), axis=0)[n - min(k, n)]
            may = (sums + slack >= least) & ~mine
            if upto == len(self.starts) or may.sum() <= FEW * m:
                break
        return [np.flatnonzero(x) for x in np.ascontiguousarray(may.T)]


def shard_search(index_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's best k in a shard; both tables hold whole numbers."""
    if not len(vectors) or not len(queries):
        return
    index = ImpactIndex(vectors)
    most = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0), 1.0)
    # scores beyond 63 bits are added up in Python's own integers
    fits = most * most * vectors.shape[1] < 2.0**62
    whole = vectors.astype(np.int64) if fits else None
    for s in range(0, len(queries), AT_ONCE):
        part, names = queries[s : s + AT_ONCE], query_ids[s : s + AT_ONCE]
        for q, row, places in zip(names.tolist(), part, index.members(part, names, index_ids, k), strict=True):
            if whole is not None:
                exact = whole[places] @ row.astype(np.int64)
            else:
                ints = [int(x) for x in row]
                exact = np.array([sum(a * int(b) for a, b in zip(ints, r, strict=True)) for r in vectors[places]], dtype=object)
            best = np.lexsort((index_ids[places], -exact))[:k] if whole is not None else sorted(range(len(places)), key=lambda i: (-exact[i], index_ids[places[i]]))[:k]
            for i in best:
                yield q, int(index_ids[places[i]]), int(exact[i])


def whole_numbers(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, r in enumerate(vectors):
        out[i, : len(r)] = r
    return np.floor(256 * out)


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose vec_id is divisible by `every`.

    Components x count as floor(256 * x). Of rows that repeat a vec_id the least vector counts; ties
    go to the smaller vec_id. Vectors of unequal length meet on their common part. Rows that are
    null, hold null or non-finite components, or have no id take no part; an empty table gives no
    rows; other columns are not read. Scores beyond a long are an error.

    Index rows are dealt by hash into shards of about SHARD_ROWS, the queries into blocks of about
    QUERY_ROWS; each pair of a shard and a block is one task's group, and sends k rows a query.
    """
    rows = usable(embeddings)
    n, q, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("embedding"))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(q / QUERY_ROWS))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = rows.filter(F.col("vec_id") % every == 0)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = shard_search(left.vec_id.to_numpy(), whole_numbers(left.embedding.tolist(), width), right.vec_id.to_numpy(), whole_numbers(right.embedding.tolist(), width), k)
        return pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    best = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
