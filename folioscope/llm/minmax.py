"""Near-duplicates by min-max hashing: sets of word shingles, banded signatures, links confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import cut_lineage, id_and_text, joined_words, shingle_bounds, shuffle_partitions, sliced_texts
from folioscope.operators.graphs import components

SEED = 42
#: Bands of a signature and values of a band. Each permutation gives two values, its least and its
#: largest. Two sets of similarity s agree on a band with s ** BAND_VALUES, so that at 0.85 the
#: chance to agree on none of 48 bands is (1 - 0.85 ** 7) ** 48 = 8e-9; at 0.4 a pair meets with 0.08.
BANDS, BAND_VALUES = 48, 7
#: Shingles that a task compares at once; a cluster of more is dealt out.
CHUNK_SHINGLES = 4_000_000
#: A class of more members than so many names of its rows is not sent with a broadcast.
BROADCAST_ROWS = 500_000


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: ASCII lower case, words between ASCII white space.

    Fewer words are one shingle; none give none.
    """
    joined, spaces = joined_words(text)
    first, last = shingle_bounds(joined, spaces, words)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    found = np.empty(len(first), np.uint64)
    for k in range(0, len(first), 1 << 14):
        some = zip(first[k : k + (1 << 14)].tolist(), last[k : k + (1 << 14)].tolist(), strict=True)
        part = np.fromiter((digest(view[a:b], SEED) for a, b in some), np.uint64)
        found[k : k + len(part)] = part
    return np.unique(found)


def multipliers() -> np.ndarray:
    """Odd factors: each permutes the 64-bit hashes."""
    n = (BANDS * BAND_VALUES + 1) // 2
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least and the largest of the hashes under each permutation: two values for one evaluation."""
    least, most = np.full(len(factors), 2**64 - 1, np.uint64), np.zeros(len(factors), np.uint64)
    for k in range(0, len(hashes), 1024):
        under = factors[:, None] * hashes[None, k : k + 1024]
        np.minimum(least, under.min(axis=1), out=least)
        np.maximum(most, under.max(axis=1), out=most)
    return np.r_[least, most]


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band. Bands take values of different permutations: the two of one are never in one band."""
    rows = np.ascontiguousarray(values[: BANDS * BAND_VALUES].reshape(BANDS, BAND_VALUES))
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set; texts of one set are one class."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, cls (the name of its set, null without shingles), bands and text_key of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for ids, texts in sliced_texts(batches, 4 << 20):
            rows: list[tuple] = []
            for text in texts:
                h = shingle_hashes(text, words)
                rows.append((len(h), set_key(h), band_keys(signature(h, factors))) if len(h) else (0, None, None))
            keys = [xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts]
            n, cls, bands = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls binary, bands array<long>")


class _Index:
    """Postings of the shingles of some sets: how much a set shares with each."""

    def __init__(self, members: list[np.ndarray], rows: np.ndarray):
        self.rows = rows
        sizes = np.array([len(members[r]) for r in rows])
        flat = np.concatenate([members[r] for r in rows])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        self.total = len(flat)

    def shared(self, own: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = hi - lo
        found = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.at[found], minlength=len(self.rows))


def _linked(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def forest(members: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect what all links among some sets connect, each confirmed on whole sets; at most one per set.

    A tree grows from a root through what it links to; what is in a tree is not compared again. The
    index holds the sets outside all trees, and is built anew when half of them are gone.
    """
    sizes = np.array([len(m) for m in members])
    outside = np.ones(len(members), bool)
    index = _Index(members, np.arange(len(members)))
    left = len(members)
    for root in range(len(members)):
        if not outside[root]:
            continue
        outside[root] = False
        left -= 1
        todo = [root]
        while todo and left:
            if 2 * left < len(index.rows):
                index = _Index(members, np.flatnonzero(outside))
            at = todo.pop()
            hit = _linked(index.shared(members[at]), sizes[at], sizes[index.rows], percent) & outside[index.rows]
            found = index.rows[hit]
            outside[found] = False
            left -= len(found)
            for other in found.tolist():
                yield at, other
                todo.append(other)


def _confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): a forest of confirmed links in each group of dealt (grp, cls, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
            now, names, held = None, [], []
            for batch in batches:
                for grp, cls, raw in zip(*[batch.column(c) for c in range(3)], strict=True):
                    if grp.as_py() != now:
                        if len(names) > 1:
                            yield names, held
                        now, names, held = grp.as_py(), [], []
                    if not names or names[-1] != cls.as_py():  # a class that came twice counts once
                        names.append(cls.as_py())
                        held.append(np.frombuffer(raw.as_py(), np.uint64))
            if len(names) > 1:
                yield names, held

        for names, held in groups():
            pairs = list(forest(held, percent))
            if pairs:
                u, v = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_pydict({"u": pa.array([names[k] for k in u], pa.binary()), "v": pa.array([names[k] for k in v], pa.binary())})

    n = shuffle_partitions(dealt)
    return dealt.select("grp", "cls", "hashes").repartition(n, "grp").sortWithinPartitions("grp", "cls").mapInArrow(run, "u binary, v binary")


def met(classes: DataFrame) -> DataFrame:
    """(cls, key) of the bands on which at least two classes (cls, bands) agree."""
    dealt = classes.select("cls", F.explode("bands").alias("key"))
    return dealt.join(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("least")).filter("n > 1"), "key")


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted (doc_id, text_key, cls, ...) with hashes, the set of its class, taken from the texts again.

    Only the texts of wanted rows are sent on: where their number is below BROADCAST_ROWS they are
    broadcast to the texts, which then stay where they are; beyond it both sides are hashed.
    """

    few = wanted.count() <= BROADCAST_ROWS
    texts = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    keys = wanted.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"), "cls", "cluster")
    found = texts.join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                h = shingle_hashes(row.column(2)[0].as_py(), words)
                if set_key(h) == row.column(0)[0].as_py():  # else another text with the same key
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=["cls", "cluster", "n", "hashes"])

    return found.select("cls", "cluster", "text").mapInArrow(run, "cls binary, cluster binary, n long, hashes binary")


def links(docs: DataFrame, own: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """(u, v): links among the classes of own, enough to connect all whose sets share percent of their union.

    Classes that agree on a band are drawn to the least class of that band; what hangs together so
    is a cluster, and no link leaves a cluster but by the chance named at BANDS. Each cluster's sets
    meet once, and a forest of links is confirmed on them. A cluster of over CHUNK_SHINGLES is dealt
    into chunks by hash: each chunk gives a forest, one class of each of its trees goes on to the
    next round, until a cluster fits one chunk or its trees do not get fewer. What is then still
    apart in such a cluster meets as pairs of chunks, but only the classes that agree on a band with
    a class of another tree: no pair is lost, and a large group of copies is never paired with itself.
    """
    least = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = cut_lineage(own.filter("cls IS NOT NULL").groupBy("cls").agg(least.alias("at"), F.first("bands").alias("bands")))
    bands = cut_lineage(met(classes))
    clusters = components(bands.select(F.col("cls").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    wanted = cut_lineage(classes.join(clusters, "cls").select("cls", "cluster", "at.doc_id", "at.text_key"))
    held = cut_lineage(_whole_sets(docs, wanted, words).dropDuplicates(["cls"]))

    def sized(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("cluster").agg(F.sum("n").alias("total"))
        return rows.join(total, "cluster").withColumn("chunks", F.ceil(F.col("total") / CHUNK_SHINGLES))

    def chunked(rows: DataFrame, nth: int) -> DataFrame:
        return rows.withColumn("grp", F.struct("cluster", F.pmod(F.xxhash64("cls", F.lit(nth)), "chunks").alias("chunk"), F.lit(-1).cast("long").alias("other")))

    rows = sized(held)
    found = cut_lineage(_confirmed(chunked(rows, 0), percent))
    hot = cut_lineage(rows.filter("chunks > 1").select("cluster").distinct())
    if hot.isEmpty():
        return found
    # the trees of hot clusters, joined round by round through one class of each
    large = cut_lineage(held.join(hot, "cluster", "left_semi"))
    nth, before = 0, None
    while True:
        nth += 1
        tree = cut_lineage(large.join(components(found), large.cls == F.col("node"), "left").select("cluster", "cls", "n", "hashes", F.coalesce("root", "cls").alias("tree")))
        tops = tree.groupBy("cluster", "tree").agg(F.min_by(F.struct("cls", "n", "hashes"), "cls").alias("top")).select("cluster", "tree", "top.*")
        several = tree.groupBy("cluster").agg(F.count_distinct("tree").alias("trees")).filter("trees > 1").select("cluster")
        tops = cut_lineage(sized(tops.join(several, "cluster", "left_semi")))
        trees = tops.count()
        if not trees or before is not None and trees > 0.9 * before:
            break
        before = trees
        found = cut_lineage(found.unionByName(_confirmed(chunked(tops, nth), percent)))
    if not trees:
        return found
    # classes on a band with a class of another tree
    of_tree = tree.select("cls", "tree", "cluster")
    mixed = bands.select("cls", "key").join(of_tree, "cls")
    keys = mixed.groupBy("key").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).filter("a <> b").select("key")
    border = mixed.join(keys, "key", "left_semi").select("cls").distinct()
    rest = sized(tree.join(border, "cls", "left_semi"))
    spread = (
        rest.withColumn("c", F.pmod(F.xxhash64("cls"), "chunks"))
        .withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("grp", F.struct("cluster", F.least("c", "d").alias("chunk"), F.greatest("c", "d").alias("other")))
    )
    return cut_lineage(found.unionByName(_confirmed(spread, percent)))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (it is that one) of every row.

    Documents link where their sets of distinct word shingles share at least percent hundredths of
    their union; shingles are told apart by 64-bit hashes. Null and empty texts and texts without
    words have no shingle and link with nothing: each is its own component. Rows of one doc_id stay
    rows, and both are kept or not; a null doc_id stays null and never names a component that has
    another id; rows without any id among them are all kept. An empty table gives no rows. Other columns are not read. Sets and links never reach the driver.
    """
    own = cut_lineage(sets(docs.select(F.col("`doc_id`"), F.col("`text`")), words))
    roots = components(links(docs, own, percent, words))
    named = own.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = named.join(roots, named.cls == roots.node, "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").select("cls", "component_id")
    found = own.join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
