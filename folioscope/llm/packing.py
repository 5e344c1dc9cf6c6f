"""Sequence packing by shortest-pack-first over a histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from folioscope.llm.common import cut_lineage, id_and_text, ship, shipped, shuffle_partitions, sliced_texts

#: The byte-level pre-tokenisation pattern of this family of vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length are numbered in parts of about this many, so that no length meets in one task.
PART_PIECES = 100_000


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabulary files write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class IdEncoder:
    """Ids of texts by a tokenizer file, as its library gives them with add_special_tokens=False.

    A text that holds the string of a special token gets that token's id there; with plain_special
    the string is ordinary text. A byte-level BPE file whose merges are all pairs in the order of
    its ids is run by the faster of the two installed BPE engines, which goes by ids; every other
    file, and any text that engine refuses, by `tokenizers`.
    """

    def __init__(self, path: str, plain_special: bool = False):
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = plain_special
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = model.get("type") in (None, "BPE") and not model.get("dropout") and not model.get("byte_fallback") and not spec.get("normalizer")
        plain = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word", "normalized"))
        if plain and merges_follow_ids(model, {t["content"] for t in added}):
            byte = _byte_alphabet()
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={} if plain_special else special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode(text, allowed_special="all"), dtype="<u4")
            except BaseException as e:  # noqa: BLE001  the engine panics on some very long runs, outside Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")


def merges_follow_ids(model: dict, special: set[str]) -> bool:
    """Whether merges are applied in the order of the ids they give, and every token of two characters or more is given by one merge."""
    last, given = -1, set()
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        i = model["vocab"].get(a + b, -1)
        if i <= last:
            return False
        last = i
        given.add(a + b)
    return given == {t for t in model["vocab"] if len(t) > 1 and t not in special}


_PIECES = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, plain_special: bool = False) -> DataFrame:
    """Every document's ids and end_id, cut at each multiple of capacity; nth tells documents of a task apart."""

    name = ship(docs, tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = IdEncoder(shipped(name), plain_special)
        nth = 0
        for ids, texts in sliced_texts(batches, 4 << 20):
            rows: list[tuple] = []
            for i, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                n = len(tokens)
                nth += 1
                rows += [(i, nth, s, min(capacity, n - s), zlib.crc32(tokens[s : s + capacity]), n) for s in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return id_and_text(docs).mapInArrow(cut, "doc_id long, nth long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, number of packs) such that all lengths of the histogram are placed.

    Lengths go longest first; each goes into the packs with most space left, and opens new ones
    where none has room. Packs of one pattern are counted, never listed: the work depends on the
    capacity, not on the number of documents.
    """
    packs: dict[int, Counter] = {}

    def add(space: int, pattern: tuple, n: int) -> None:
        packs.setdefault(space, Counter())[pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in packs if s), default=0)
            if space < length:
                add(capacity - length, (length,), left)
                break
            patterns = packs[space]
            pattern, n = min(patterns.items())
            take = min(left, n)
            if take == n:
                del patterns[pattern]
                if not patterns:
                    del packs[space]
            else:
                patterns[pattern] = n - take
            add(space - length, (*pattern, length), take)
            left -= take
    return sorted((p, n) for patterns in packs.values() for p, n in patterns.items())


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset): where ranks of a length stand."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n - 1, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, plain_special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is end_id alone; repeated rows are packed each for itself and rows with a
    null doc_id keep it; an empty table gives no rows. Other columns of docs are not read. Very
    long texts become full pieces of `capacity` and one rest; only rests need packing. plain_special:
    strings of special tokens are ordinary text.

    The driver receives the histogram alone (at most `capacity` rows). Patterns meet pieces by
    rank: a piece's rank among those of its length is its place in a part of about PART_PIECES
    pieces plus the sizes of the parts before. Packs of one pattern are counted, and each length of
    the histogram adds two patterns at most, so the table of patterns that is broadcast has at most
    2 * capacity patterns and capacity rows, whatever the input.
    """
    spark = docs.sparkSession
    found = cut_lineage(pieces(docs, tokenizer, capacity, end_id, plain_special))
    parts = max(shuffle_partitions(docs), -(-found.count() // PART_PIECES))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "nth", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").count()
    histogram = dict(map(tuple, sizes.groupBy("length").agg(F.sum("count")).collect()))
    places = _places(shortest_pack_first(histogram, capacity))
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before_df = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place_df = spark.createDataFrame([(p[0], p[1], p[2], p[3], p[4]) for p in places], "length long, low long, high long, first long, offset long")
    by_length = place_df.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("ranges"))
    in_part = W.partitionBy("length", "part").orderBy("doc_id", "nth", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("n", F.row_number().over(in_part) - 1)
        .join(before_df, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("n"))
        .join(F.broadcast(by_length), "length")
    )
    range_of = F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") <= r["high"]))[0]
    return ranked.withColumn("at", range_of).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("at.first") + F.col("rank") - F.col("at.low")).alias("sequence_id"), F.col("at.offset").alias("offset")
    )
