"""SimHash near-duplicates by tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import cut_lineage, id_and_text, joined_words, shingle_bounds, shuffle_partitions, sliced_texts
from folioscope.operators.graphs import components

BITS = 64
SEED = 42
#: Reference fingerprints whose distances are tabulated.
PIVOTS = 16
#: Bits of the segments of a fingerprint; with k differing bits, all but k segments agree.
SEGMENTS = (13, 13, 13, 13, 12)
#: A group with more fingerprints than twice CHUNK is dealt out by the cells of CELL_PIVOTS reference fingerprints, and what is still larger as pairs of chunks.
CHUNK, CELL_PIVOTS = 8192, 3


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text's word shingles: ASCII lower case, words between ASCII white space."""
    joined, spaces = joined_words(text)
    if not joined:
        return 0
    starts, ends = shingle_bounds(joined, spaces, shingle)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), 1 << 14):
        some = zip(starts[k : k + (1 << 14)].tolist(), ends[k : k + (1 << 14)].tolist(), strict=True)
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in some), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced_texts(batches, 4 << 20):
            found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, drawn once from a seeded generator."""
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def _within(a: np.ndarray, table_a: np.ndarray, b: np.ndarray, table_b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows of a and b (b may be one row) differ in at most `most` bits.

    By the triangle inequality a pair whose distances to some reference fingerprint differ by more
    than `most` is farther apart: each coordinate of the table discards such pairs of what the
    ones before have left, and the survivors of all are verified.
    """
    left = np.arange(len(a))
    one = len(b) == 1
    for c in range(table_a.shape[1]):
        other = table_b[0, c] if one else table_b[left, c]
        left = left[np.abs(table_a[left, c] - other) <= most]
    return left[np.bitwise_count(a[left] ^ (b[0] if one else b[left])) <= most]


def _tree(fps: np.ndarray, table: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all links of a group connect: at most one per fingerprint.

    Rows are sorted by the first coordinate, so that only those within `most` of it are looked at.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)
    alive = np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not alive[root]:
            continue
        alive[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            lo, hi = np.searchsorted(first, (first[at] - most, first[at] + most + 1))
            left = lo + np.flatnonzero(alive[lo:hi])
            if not len(left):
                continue
            hit = left[_within(fps[left], table[left], fps[at : at + 1], table[at : at + 1], most)]
            if len(hit):
                alive[hit] = False
                yield np.full(len(hit), order[at]), order[hit]
                todo += hit.tolist()


def _links(groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal group numbers. Small groups are compared shift by shift, large ones grown as trees."""
    for group, fps, table in groups:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        size_of = np.repeat(sizes, sizes)
        small = np.flatnonzero(size_of <= 16)
        g, f, t = group[small], fps[small], table[small]
        for shift in range(1, min(16, len(g))):
            same = np.flatnonzero(g[shift:] == g[:-shift])
            if not len(same):
                break
            a, b = same, same + shift
            hit = _within(f[a], t[a], f[b], t[b], most)
            yield f[a[hit]], f[b[hit]]
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            for a, b in _tree(fps[s : s + n], table[s : s + n], most):
                yield fps[s + a], fps[s + b]


def with_distances(fps: DataFrame) -> DataFrame:
    """fp and table: each distinct fingerprint with its row of the distance table, a byte for each reference fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            rows = np.ascontiguousarray(distance_table(own)) if len(own) else np.zeros((0, PIVOTS), np.int8)
            offsets = np.arange(len(own) + 1, dtype=np.int32) * PIVOTS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])], names=["fp", "table"])

    return fps.select("fp").distinct().mapInArrow(run, "fp long, table binary")


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): links among the distinct fingerprints of column fp, enough to connect all that differ in `most` bits or fewer.

    The distances to the reference fingerprints are computed once and travel with the fingerprints.
    Alone they would leave nearly half of all pairs a reference, so fingerprints first meet where
    they agree on segments: two that differ in at most `most` bits agree on len(SEGMENTS) - most at
    least, and each is dealt to one group for each choice of that many. Within a group the table
    discards every pair whose largest difference of a coordinate is beyond `most`, and the survivors
    are verified. Groups of more than 2 * CHUNK fingerprints are dealt again, by cells of `most` + 1
    distances to some references: each to its own cell and, where its distance and `most` reach it,
    the next, so that near pairs meet in one. What is still larger is dealt out as pairs of chunks,
    each pair a group: no group meets in one task, no pair is missed, and each group sends a forest,
    not all its pairs.
    """
    agree = len(SEGMENTS) - most
    if agree < 1:
        raise ValueError(f"at most {len(SEGMENTS) - 1} differing bits")
    edges = np.cumsum((0, *SEGMENTS))
    masks = [((1 << size) - 1) << int(at) for size, at in zip(SEGMENTS, edges, strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(masks, agree))]
    tabled = cut_lineage(with_distances(fps))
    dealt = tabled.select("fp", "table", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("k")).select("fp", "table", "k.tab", "k.key")
    counts = dealt.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = dealt.join(counts, ["tab", "key"])
    no_cell = F.lit(-1).cast("long")

    def cells(pivot: int) -> Column:
        distance = F.conv(F.hex(F.substring("table", pivot + 1, 1)), 16, 10).cast("long")
        own, reach = F.floor(distance / (most + 1)), F.floor((distance + most) / (most + 1))
        return F.array_distinct(F.array(own, reach))

    hot = met.filter(F.col("n") > 2 * CHUNK).withColumn("cell", F.lit(0).cast("long"))
    for pivot in range(CELL_PIVOTS):
        hot = hot.withColumn("next", F.explode(cells(pivot))).withColumn("cell", F.col("cell") * (BITS + 1) + F.col("next")).drop("next")
    of_cell = hot.groupBy("tab", "key", "cell").agg(F.count("*").alias("m")).filter("m > 1")
    chunks = F.when(F.col("m") > 2 * CHUNK, F.ceil(F.col("m") / CHUNK)).otherwise(F.lit(1))
    spread = (
        hot.join(of_cell, ["tab", "key", "cell"])
        .withColumn("chunks", chunks)
        .withColumn("c", F.pmod(F.xxhash64("fp"), "chunks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("tab", "key", "cell", (F.least("c", "other") * F.col("chunks") + F.greatest("c", "other")).alias("pair"), "fp", "table")
    )
    spread = spread.unionByName(met.filter(F.col("n") <= 2 * CHUNK).select("tab", "key", no_cell.alias("cell"), no_cell.alias("pair"), "fp", "table"))
    keys = ["tab", "key", "cell", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole_groups() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            held: list[np.ndarray] = []
            tables: list[np.ndarray] = []
            for batch in batches:
                if batch.num_rows:
                    held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)], axis=1))
                    raw = batch.column(5)
                    first = raw.offset * PIVOTS
                    tables.append(np.frombuffer(raw.buffers()[2], np.int8)[first : first + len(raw) * PIVOTS].reshape(-1, PIVOTS))
                    rows, table = np.concatenate(held), np.concatenate(tables)
                    cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
                    if len(cuts):
                        e = cuts[-1] + 1
                        yield numbered(rows[:e], table[:e])
                        held, tables = [rows[e:]], [table[e:]]
                    else:
                        held, tables = [rows], [table]
            if held:
                yield numbered(np.concatenate(held), np.concatenate(tables))

        def numbered(rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.cumsum(np.r_[0, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]), rows[:, 4].copy().view(np.uint64), table

        for u, v in _links(whole_groups(), most):
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    dealt_out = spread.repartition(shuffle_partitions(fps), *keys).sortWithinPartitions(*keys, "fp")
    return dealt_out.select(*keys, "fp", "table").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay; a null
    doc_id stays null and never names a component unless a component has no other; an empty table
    gives no rows. Other columns are not read. Texts are read whole; fingerprints and links never reach the driver.
    """
    own = cut_lineage(fingerprints(docs, shingle))
    named = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(own, most))
    rooted = named.join(roots, named.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named_roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named_roots, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
