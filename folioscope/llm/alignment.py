"""Alignment of two tokenizers' tokens by the byte places where both end one, and counts of the pairs that overlap."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import cut_lineage, id_and_text, ship, shipped, sliced_texts
from folioscope.llm.packing import IdEncoder, _byte_alphabet

#: Labels of a byte at which tokens end: of A alone, of B alone, of both. A byte inside tokens has none.
NONE, A_END, B_END, BOTH = b"-", b"a", b"b", b"c"
_LABELS = np.frombuffer(NONE + A_END + B_END + BOTH, np.uint8)
#: Spans of labels up to each byte where both end: groups of tokens.
SPAN = re.compile(rb"[ab]+c|c+")
#: Characters of the texts that are one block of counts.
BLOCK_CHARS = 1 << 20
#: Spans whose counts a task remembers.
KNOWN_SPANS = 100_000
_MARK = "▁"


class BytePieces:
    """Ids of A and the bytes of each: a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.own = IdEncoder(path, plain_special=True)
        byte = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, text: str) -> np.ndarray:
        if self.own.fast is not None:
            try:
                return np.array(self.own.fast.encode_ordinary(text), np.int64)
            except BaseException as e:  # noqa: BLE001  the engine panics on some very long runs, outside Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return self.own(text).astype(np.int64)


class WordPieces:
    """Ids of B and the bytes of each: a sentencepiece model that marks spaces and falls back to bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


def labels(a_lengths: np.ndarray, b_lengths: np.ndarray) -> bytes:
    """The label of each byte of a text, by the lengths of its tokens in bytes."""
    marks = np.zeros(int(a_lengths.sum()), np.uint8)
    marks[np.cumsum(a_lengths) - 1] = 1
    marks[np.cumsum(b_lengths) - 1] += 2
    return _LABELS[marks].tobytes()


class _Counts(dict):
    """Groups in a span of labels and, in each, tokens of A and of B, as one number."""

    def __missing__(self, span: bytes) -> int:
        if len(self) > KNOWN_SPANS:
            self.clear()
        runs, a, b = (len(span), 1, 1) if span[:1] == BOTH else (1, span.count(A_END) + 1, span.count(B_END) + 1)
        self[span] = found = (runs << 42) + (a << 21) + b
        return found


def groups(label: bytes, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A, and of B, each group takes: a group for each span of labels up to a place where both end.

    Places where both end that follow one another without another end are one match: each is a group of one and one.
    """
    spans = SPAN.findall(label.translate(None, NONE))
    counts = np.fromiter(map(known.__getitem__, spans), np.int64, len(spans))
    runs = counts >> 42
    return np.repeat(counts >> 21 & 0x1FFFFF, runs), np.repeat(counts & 0x1FFFFF, runs)


def pairs(label: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places, among the tokens of A and of B, of each pair of tokens that overlap: each place where a token ends closes one pair."""
    ends = np.frombuffer(label.translate(None, NONE), np.uint8)
    a, b = ends != B_END[0], ends != A_END[0]
    return np.cumsum(a) - a, np.cumsum(b) - b


def told_ids(a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and their number of each id of A with a comma and with the bar that ends A's part of a group, then of B with a comma and with a semicolon."""
    told = [b"%d%s" % (i, end) for size, ends in ((a_size, (b",", b"|")), (b_size, (b",", b";"))) for i in range(size) for end in ends]
    table = np.array(told)
    return table.view(np.uint8).reshape(len(told), -1), np.array([len(t) for t in told])


def written(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_size: int, told: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group, in parts of 65,536 groups."""
    step = 1 << 16
    table, sizes = told
    for k in range(0, len(n_a), step):
        a_counts, b_counts = n_a[k : k + step], n_b[k : k + step]
        a_end, b_end = np.cumsum(a_counts), np.cumsum(b_counts)
        own_a, own_b = 2 * a[: a_end[-1]], 2 * (b[: b_end[-1]] + a_size)
        a, b = a[a_end[-1] :], b[b_end[-1] :]
        own_a[a_end - 1] += 1
        own_b[b_end - 1] += 1
        # the place of each token in the written order: behind the groups before, A's before B's
        parts = np.empty(len(own_a) + len(own_b), np.int64)
        parts[np.arange(len(own_a)) + np.repeat(b_end - b_counts, a_counts)] = own_a
        parts[np.arange(len(own_b)) + np.repeat(a_end, b_counts)] = own_b
        size = sizes[parts]
        ends = np.cumsum(size)
        out, starts = np.empty(ends[-1], np.uint8), ends - size
        for j in range(table.shape[1]):
            some = np.flatnonzero(size > j)
            out[starts[some] + j] = table[parts[some], j]
        yield out.tobytes() if k + step < len(n_a) else out[:-1].tobytes()


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("docs", pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())])))]
    + [("size", pa.int64()), ("n_links", pa.int64())]
    + [(c, pa.binary()) for c in ("links", "pairs", "counts")]
)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of texts: what is known of each document, its links as numbers of pairs, the block's distinct pairs and how often each links.

    links, pairs and counts are compressed arrays; a pair is A's id times the size of B's vocabulary plus B's id.
    """
    a_name, b_name = ship(docs, a_path), ship(docs, b_path)
    # a worker loads the vocabularies once and keeps them with this value, whatever its number of tasks
    shared = docs.sparkSession.sparkContext.broadcast({})

    def loaded() -> tuple:
        held = shared.value
        if not held:
            first, second = BytePieces(shipped(a_name)), WordPieces(shipped(b_name))
            sizes = [np.array([len(x) for x in v.bytes_of]) for v in (first, second)]
            held["all"] = (first, second, *sizes, told_ids(len(first.bytes_of), len(second.bytes_of)))
        return held["all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, a_size, b_size, told = loaded()
        width = len(second.bytes_of)
        known, none = _Counts(), np.zeros(0, np.int64)
        for nth, (ids, texts) in enumerate(sliced_texts(batches, BLOCK_CHARS)):
            rows, links = [], []
            for doc_id, text in zip(ids, texts, strict=True):
                whole = f" {text}".encode() if text else b""
                a, b = (first.encode(f" {text}"), second.encode(text)) if text else (none, none)
                if not text or any(b"".join(map(v.bytes_of.__getitem__, ids.tolist())) != whole for v, ids in ((first, a), (second, b))):
                    rows.append((doc_id, 0, 0, 0, 0, ""))
                    continue
                label = labels(a_size[a], b_size[b])
                n_a, n_b = groups(label, known)
                digest = hashlib.sha256()
                for part in written(a, b, n_a, n_b, len(first.bytes_of), told):
                    digest.update(part)
                at_a, at_b = pairs(label)
                links.append(a[at_a] * width + b[at_b])
                rows.append((doc_id, len(a), len(b), len(n_a), len(at_a), digest.hexdigest()))
            place, found = pd.factorize(np.concatenate(links) if links else none)
            n = np.bincount(place, minlength=len(found))
            packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (place.astype(np.uint32), found, n)]
            names = [f.name for f in _BLOCKS.field("docs").type.value_type]
            listed = pa.array([[dict(zip(names, r, strict=True)) for r in rows]], _BLOCKS.field("docs").type)
            block = (TaskContext.get().partitionId() << 32) + nth
            yield pa.RecordBatch.from_arrays([pa.array([block]), listed, pa.array([len(found)]), pa.array([len(place)]), *[pa.array([x], pa.binary()) for x in packed]], schema=_BLOCKS)

    return id_and_text(docs).mapInArrow(run, "block long, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string>>, size long, n_links long, links binary, pairs binary, counts binary")


def _unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, nth, pair, n): the distinct pairs of each block, in order, and how often each links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, raw, raw_n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found, n = _unpacked(raw, size, np.int64), _unpacked(raw_n, size, np.int64)
                for k in range(0, size, 1 << 16):
                    part = slice(k, min(size, k + (1 << 16)))
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(part.stop - k, block)), "nth": pa.array(np.arange(k, part.stop, dtype=np.int32)), "pair": pa.array(found[part]), "n": pa.array(n[part])})

    return blocks.select("block", "size", "pairs", "counts").mapInArrow(run, "block long, nth int, pair long, n long")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups_sha256 of every row of docs.

    A encodes a space and the text, B the text; special tokens' strings are plain text. Groups end
    where tokens of both end. A link is a pair of a token of A and one of B that overlap; a pair of
    ids counts as often as it links anywhere in docs. Null and empty texts, and those whose bytes
    the tokens do not give, have no tokens: zeros and an empty string. Rows of one doc_id stay rows;
    an empty table gives none; other columns are not read. Texts are encoded once and whole.

    A block's pairs are counted where they are found, added up over blocks by pair, and come back in
    the block's own order: what is exchanged is a row for each distinct pair of a block, not for each
    link. Of B's ids, no more than its vocabulary holds, the highest count is broadcast.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    blocks = cut_lineage(encoded(docs, a_path, b_path))
    counts = pair_counts(blocks)
    totals = cut_lineage(counts.groupBy("pair").agg(F.sum("n").alias("total")))
    best = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("total").alias("top"))
    known = totals.withColumn("b", F.col("pair") % width).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answer = F.sort_array(F.collect_list(F.struct("nth", "total", "best")))
    answers = counts.select("block", "nth", "pair").join(known, "pair").groupBy("block").agg(answer.alias("of"))
    answers = answers.select("block", F.col("of.total").alias("totals"), F.col("of.best").alias("best"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs_of, n, raw, total, top = (c.slice(k, 1) for c in batch.columns)
                rows = docs_of.flatten()
                links = rows.field("n_links").to_numpy()
                ends = np.cumsum(links)
                place = _unpacked(raw[0].as_py(), n[0].as_py(), np.uint32)
                sums = []
                for of in (top.flatten().to_numpy(zero_copy_only=False), total.flatten().to_numpy(zero_copy_only=False)):
                    added = np.r_[0, np.cumsum(of.astype(np.int64)[place])] if len(place) else np.zeros(1, np.int64)
                    sums.append(pa.array(added[ends] - added[ends - links]))
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *sums, rows.field("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    met = blocks.select("block", "docs", "n_links", "links").join(answers, "block", "left")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return met.select("docs", "n_links", "links", "totals", "best").mapInArrow(finish, out)
