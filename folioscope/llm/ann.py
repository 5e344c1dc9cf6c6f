"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioscope.llm.common import cut_lineage
from folioscope.llm.topk import usable

#: Hash tables. A hash is the nearest signed axes after two rotations, so that there are (2 * width) ** 2 of them.
TABLES = 10
#: Hashes of each table that a query probes first, at least; and rows that the first search should meet for each row wanted.
PROBES, MEET = 24, 8
ROUNDS, SEED = 3, 20_17
#: Vectors of one first axis that a task meets at once; larger groups are dealt out in parts, each probed.
BUCKET_ROWS = 4096
#: Rows are indexed by norm, in bands of a BAND-th of a power of two; the last takes all shorter ones.
BAND, MOST_BANDS = 4, 32
#: Cosines at which the probes needed are sampled, and the share of rows at the least cosine of interest that may be missed.
COSINES, MISSED = 50, 0.06


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    rows, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(rows, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(rows, width)
        h *= 2
    return x / math.sqrt(width)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """A table's pseudo-rotation: random signs and a Hadamard transform, ROUNDS times."""
    signs = np.random.default_rng([SEED, table, x.shape[1]]).choice([-1.0, 1.0], (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit_rows(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions of vectors, and their norms."""
    out = np.zeros((len(vectors), max(2, 1 << (width - 1).bit_length())))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    scale = np.abs(out).max(axis=1, keepdims=True)
    out = out / np.where(scale > 0, scale, 1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(norm > 0, norm, 1)
    return out, (norm * scale)[:, 0]


def probes_needed(size: int, tables: int) -> np.ndarray:
    """For cosines of 0, 1 / COSINES and so on: the hashes a table that find a row at that cosine, but for MISSED of all.

    Sampled on random rotations: how near to a query the hash of such a row is, in the best of the tables.
    """
    g = np.random.default_rng([SEED, size])
    n = max(60, min(120, (1 << 18) // (tables * size)))
    out = np.empty(COSINES + 1, np.int64)
    for i in range(COSINES + 1):
        c = i / COSINES
        sides, own = [], np.zeros(n * tables)
        for _ in range(2):
            q, w = g.normal(size=(2, n * tables, size))
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            w -= (w * q).sum(axis=1, keepdims=True) * q
            x = c * q + math.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)
            top = np.abs(x).argmax(axis=1)
            at = np.arange(len(x))
            own += q[at, top] * np.sign(x[at, top])
            sides.append(np.sort(np.hstack([q, -q]), axis=1))
        nearer = [2 * size * 2 * size - int(np.searchsorted(b, t - a, "right").sum()) for a, b, t in zip(*sides, own, strict=True)]
        out[i] = np.quantile(np.array(nearer).reshape(n, tables).min(axis=1), 1 - MISSED, method="higher") + 1
    return np.minimum(np.minimum.accumulate(out), (2 * size) ** 2)


def both_signs(rotated: np.ndarray) -> np.ndarray:
    """How near each row is to each signed axis (2 * axis, one more if negative)."""
    return np.stack([rotated, -rotated], axis=2).reshape(len(rotated), -1)


def nearest_hashes(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second axes of the n hashes nearest to each row, nearest first.

    The i-th nearest first and j-th nearest second axis have i * j hashes at least that are as near.
    """
    axes = first.shape[1]
    n = min(n, axes * axes)
    one, two = np.argsort(-first, axis=1, kind="stable"), np.argsort(-second, axis=1, kind="stable")
    i, j = np.divmod(np.arange(axes * axes), axes)
    may = (i + 1) * (j + 1) <= n
    i, j = i[may], j[may]
    near = np.take_along_axis(first, one, 1)[:, i] + np.take_along_axis(second, two, 1)[:, j]
    best = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(i) else np.broadcast_to(np.arange(len(i)), near.shape).copy()
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(one, i[best], 1), np.take_along_axis(two, j[best], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order whatever else is computed, so that equal vectors tie."""
    return np.add.reduce(a * b, axis=-1)


def _rows_of(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width)


def _blobs(vectors: np.ndarray) -> pa.Array:
    size = vectors.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(np.arange(len(vectors) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(vectors, np.float64).tobytes())])


def probed_cells(row: np.ndarray, first: np.ndarray, second: np.ndarray, axes: int, most_bytes: int = 32 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first axis, bits of second axes) of probed pairs of axes, so many at a time as most_bytes hold: memory follows rows and axes, not the square of the axes."""
    if not len(row):
        return
    code = row.astype(np.int64) * axes + first
    flags = np.zeros(int(code.max()) + 1, bool)
    flags[code] = True
    cells, of = np.flatnonzero(flags), (np.cumsum(flags) - 1)[code]
    step = max(1, most_bytes // axes)
    for s in range(0, len(cells), step):
        some = cells[s : s + step]
        here = slice(None) if len(cells) <= step else np.flatnonzero((of >= s) & (of < s + step))
        bits = np.zeros((len(some), axes), bool)
        bits[of[here] - s, second[here]] = True
        yield some // axes, some % axes, np.packbits(bits, axis=1)


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose vec_id is divisible by `every`.

    Every usable row is indexed: vectors that are null, zero, hold a null or non-finite component or
    have no id take no part; of rows that repeat a vec_id the least vector counts. Ties go to the
    smaller vec_id. An empty table gives no rows; vectors of unequal length meet on their common
    part; other columns are not read.

    Equal vectors are indexed once, with their k + 1 smallest ids, which is all that a result can
    hold of them. Each is hashed to its nearest signed axes after two rotations in every table of its
    norm band; a query first probes so many of its nearest hashes in all bands that some MEET * k
    rows are met. What it finds there bounds what it lacks: a row of a band can only enter at a
    cosine of that score to the product of the query's and the band's longest norm, and where rows
    at that cosine need more probes, the band is probed further, or met whole where this is no more
    work. The more rows there are, the larger that cosine and the smaller the share of the hashes
    that is probed. A query that found fewer than k rows meets all. Rows and queries of one first
    axis meet in a task, which multiplies rows by queries only where a query probes the rows' second
    axis, and sends the best k + 1; groups of more than BUCKET_ROWS are dealt out in parts that are
    all probed. There are at most 2 * width * tables * MOST_BANDS groups, whose counts alone reach
    the driver.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings).filter(F.exists("embedding", lambda x: x != 0)).withColumn("digest", F.xxhash64("embedding"))
    some = W.partitionBy("digest", "embedding", "salt").orderBy("vec_id")
    each = W.partitionBy("digest", "embedding").orderBy("vec_id")
    least = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k + 1)
    least = least.drop("r", "salt").withColumn("r", F.row_number().over(each)).filter(F.col("r") <= k + 1)
    distinct = cut_lineage(least.groupBy("digest", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]).withColumn("peak", F.array_max(F.transform("embedding", F.abs)).cast("double")))
    total, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.col("peak") * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak"))))
    longest = distinct.agg(F.max(norm)).first()[0]
    band = F.floor(F.lit(BAND) * F.log2(F.lit(longest) / norm) + 1e-9)
    distinct = cut_lineage(distinct.withColumn("band", F.least(F.greatest(band, F.lit(0)), F.lit(MOST_BANDS - 1)).cast("int")).withColumn("norm", norm))
    bands = dict(map(tuple, distinct.groupBy("band").agg(F.max("norm")).collect()))  # at most MOST_BANDS
    size = max(2, 1 << (width - 1).bit_length())
    hashes = (2 * size) ** 2
    probes = min(hashes, max(PROBES, math.ceil(MEET * k * hashes / (tables * total))))
    needed = probes_needed(size, tables)
    shape = "band int, tab int, axis int, rep long, vector binary, second binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = table(batch.column(1).to_pylist(), width)
                unit, _ = unit_rows(list(own), width)
                blobs = _blobs(own)
                for t in range(tables):
                    first, second = (both_signs(rotate(unit, 2 * t + s)).argmax(axis=1) for s in (0, 1))
                    axes = pa.array([int(x).to_bytes(4, "little") for x in second], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(np.full(len(first), t, np.int32)), pa.array(first.astype(np.int32)), batch.column(0), blobs, axes], names=["band", "tab", "axis", "rep", "vector", "second"])

    index = cut_lineage(distinct.select("rep", "embedding", "band").mapInArrow(placed, shape))  # read by the counts and by both searches
    sizes = {(b, t, a): n for b, t, a, n in index.groupBy("band", "tab", "axis").count().collect()}  # at most 2 * width a table and band
    parts = [(*at, max(1, math.ceil(n / BUCKET_ROWS))) for at, n in sorted(sizes.items())]
    held = np.zeros((max(bands) + 1, tables, 2 * size), bool)
    held[tuple(np.array(list(sizes)).T)] = True

    def dealt() -> DataFrame:
        return F.broadcast(spark.createDataFrame(parts, "band int, tab int, axis int, parts int"))

    def probed(further: bool):
        def of_table(t: int, unit: np.ndarray, want: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """(band, row, first axis, bits of second axes) of what is probed in a table."""
            whole = want * tables >= hashes
            near = want[~whole]
            one, two = nearest_hashes(*(both_signs(rotate(unit, 2 * t + s)) for s in (0, 1)), max(1, int(near.max(initial=1))))
            nth = np.arange(one.shape[1])
            for b in bands:
                take = (nth < want[:, b, None]) & (nth >= (probes if further else 0)) & ~whole[:, b, None] & held[b, t][one]
                at, i = np.nonzero(take)
                yield from ((b, *found) for found in probed_cells(at, one[at, i], two[at, i], 2 * size))
                if t == 0:
                    rows, firsts = np.flatnonzero(whole[:, b]), np.flatnonzero(held[b, 0])
                    every_cell = np.packbits(np.ones(2 * size, bool))
                    step = max(1, (16 << 20) // (8 * width * max(1, len(firsts))))
                    for s in range(0, len(rows), step):
                        some = np.repeat(rows[s : s + step], len(firsts))
                        yield b, some, np.tile(firsts, len(rows[s : s + step])), np.broadcast_to(every_cell, (len(some), len(every_cell)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    reps, least = part.column(0).to_numpy(), part.column(2)
                    own = table(part.column(1).to_pylist(), width)
                    unit, length = unit_rows(list(own), width)
                    found = least.to_numpy(zero_copy_only=False)
                    want = np.full((len(reps), max(bands) + 1), probes)
                    if further:
                        for b, most in bands.items():
                            cosine = np.nan_to_num(found, nan=-1.0) / length / most
                            # above 1 nothing in the band can enter, but for rounding
                            want[:, b] = np.where(cosine > 1 + 1e-9, 0, needed[np.clip(np.floor(COSINES * cosine), 0, COSINES).astype(int)])
                            want[np.isnan(found) | (cosine <= 0), b] = hashes
                    for t in range(tables):
                        for b, row, first, bits in of_table(t, unit, want):
                            if len(row):
                                cells = pa.array([x.tobytes() for x in bits], pa.binary())
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), b, np.int32)), pa.array(np.full(len(row), t, np.int32)), pa.array(first.astype(np.int32)), pa.array(reps[row]), _blobs(own[row]), cells, least.take(pa.array(row))], names=["band", "tab", "axis", "rep", "vector", "second", "least"])

        return run

    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "digest", "embedding")
    with_rep = asked.join(distinct.select("digest", "embedding", "rep"), ["digest", "embedding"])
    with_rep = cut_lineage(with_rep.select("query_id", "rep", "embedding"))
    queries = with_rep.groupBy("rep").agg(F.min("embedding").alias("embedding"))
    keys = ["band", "tab", "axis", "part"]
    left = index.join(dealt(), keys[:3]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))

    def rerank(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qrep": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(have) or not len(ask):
            return none
        second = np.frombuffer(b"".join(have.second), "<i4")
        order = np.argsort(second, kind="stable")
        v, ids, second = _rows_of(have.vector, width)[order], have.rep.to_numpy()[order], second[order]
        starts = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
        q, names, least = _rows_of(ask.vector, width), ask.rep.to_numpy(), ask.least.to_numpy(float)
        bits = np.unpackbits(np.frombuffer(b"".join(ask.second), np.uint8).reshape(len(ask), -1), axis=1)
        got = []
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True):
            who = np.flatnonzero(bits[:, second[a]])
            if len(who):
                rough = q[who] @ v[a:e].T
                qi, vi = np.nonzero(~(rough < (least[who] - 1e-9 * (1 + np.abs(least[who])))[:, None]))
                got.append((who[qi], a + vi, rough[qi, vi]))
        if not got:
            return none
        qi, vi, rough = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(qi):
            return none
        order = np.lexsort((-rough, qi))
        qi, vi, rough = qi[order], vi[order], rough[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        sizes = np.diff(np.r_[first, len(qi)])
        # the best k + 1 of each query, and what ties with the last but for rounding
        last = np.repeat(rough[first + np.minimum(sizes, k + 1) - 1], sizes)
        keep = rough >= last - 1e-9 * (1 + np.abs(last))
        qi, vi = qi[keep], vi[keep]
        return pd.DataFrame({"qrep": names[qi], "rep": ids[vi], "score": products(q[qi], v[vi])})

    order = W.partitionBy("qrep").orderBy(F.desc("score"), "rep")

    def met(asked: DataFrame, further: bool) -> DataFrame:
        ask = asked.mapInArrow(probed(further), f"{shape}, least double")
        right = ask.join(dealt(), keys[:3]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "qrep long, rep long, score double")

    def first(pairs: DataFrame) -> DataFrame:
        return pairs.dropDuplicates(["qrep", "rep"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)

    best = first(met(queries.withColumn("least", F.lit(None).cast("double")), False))
    if probes * tables < hashes:
        best = cut_lineage(best)
        least = best.filter(F.col("r") == k + 1).select(F.col("qrep").alias("rep"), F.col("score").alias("least"))
        best = first(best.drop("r").unionByName(met(queries.join(least, "rep", "left"), True)))
    members = distinct.select("rep", "ids")
    lists = best.join(members, "rep").groupBy("qrep").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # at most k + 1 lists of k + 1 ids
    results = with_rep.select("query_id", F.col("rep").alias("qrep")).join(lists, "qrep").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def table(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
