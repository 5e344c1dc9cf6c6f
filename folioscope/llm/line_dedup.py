"""Line dedup by winnowing: window minima of line hashes are fingerprints, whose places are joined and matches extended."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.llm.common import shuffle_partitions, sliced_texts

#: A repeated run is deleted from this many lines and words on; also the length of the windows whose minima are fingerprints.
LEAST_LINES, LEAST_WORDS = 2, 20
#: Lines of more characters are wrapped at one space in WRAP_ONE_IN, chosen by the characters around it.
WRAP_CHARS, WRAP_ONE_IN = 80, 6
#: What still has more words than MOST_WORDS is wrapped after every WRAP_WORDS.
MOST_WORDS, WRAP_WORDS = 16, 8
#: Characters of text whose repeats a task combines before it sends anything, and of all text for each part of the exchange.
BLOCK_CHARS, PART_CHARS = 8 << 20, 16 << 20
#: Documents sampled to find fingerprints that are split by window, and the share of sampled rows from which one is.
HOT_SAMPLE, HOT_SHARE = 4096, 1 / 512
#: Rows of a sampled fingerprint below which it is never split.
HOT_LEAST = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
#: Whether a code point is white space as str.strip() knows it; the last entry stands for all later ones.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: Characters of texts that are cut into lines at a time.
_AT_ONCE = 1 << 18


def _window(least: int) -> np.dtype:
    """A window of a fingerprint: its hash, and its first and one past its last line, from the fingerprint's line."""
    size = "<u1" if least < 1 << 8 else "<u4"
    return np.dtype([("h", "<u8"), ("back", size), ("on", size)])


def _wraps(code: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Spaces at which lines between the hard breaks are wrapped."""
    edge = np.r_[-1, hard, len(code)]
    gap = np.flatnonzero(code == 32)
    gap = gap[(gap > 0) & (code[gap - 1] != 32) & (code[gap - 1] != 10)]
    of = np.searchsorted(gap, edge)
    long = np.repeat(np.diff(edge) - 1 > WRAP_CHARS, np.diff(of))
    long[of[1:-1][gap[np.minimum(of[1:-1], len(gap) - 1)] == hard] if len(gap) else []] = False  # a space after a sentence is a break already
    gap = gap[long]
    around = np.r_[np.full(2, 10, np.uint32), code, np.full(2, 10, np.uint32)]
    h = np.zeros(len(gap), np.uint64)
    for k in (0, 1, 3, 4):
        h = ((h ^ (h >> np.uint64(29))) + around[gap + k] + np.uint64(1)) * _STEP
    soft = (h >> np.uint64(33)) % np.uint64(WRAP_ONE_IN) == 0
    # the other spaces by their number since the last break
    inner = gap[~soft]
    edge = np.sort(np.r_[edge, gap[soft]])
    since = np.searchsorted(inner, edge)
    sizes = np.diff(since)
    size = np.repeat(sizes, sizes)
    nth = np.arange(len(inner)) - np.repeat(since[:-1], sizes)
    more = (size >= MOST_WORDS) & (nth % WRAP_WORDS == WRAP_WORDS - 1) & (size - nth > WRAP_WORDS // 2)
    return np.r_[gap[soft], inner[more]]


def _cut(texts: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """The lines of each text, and the number of words of every line."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero((code == 46) | (code == 33) | (code == 63)) + 1
    ends = ends[ends < len(code)]
    hard = np.sort(np.r_[np.flatnonzero(code == 10), ends[code[ends] == 32]])
    cut = np.r_[-1, np.sort(np.r_[hard, _wraps(code, hard)]), len(code)]
    # words begin and end where white space does
    ink = ~_SPACE[np.minimum(code, len(_SPACE) - 1)]
    turn = np.flatnonzero(np.diff(np.r_[False, ink, False]))
    word, stop = turn[::2], turn[1::2]
    at = np.searchsorted(word, cut)
    lo, hi = at[:-1], at[1:]
    lo, hi = lo[hi > lo], hi[hi > lo]
    start, end, n_words = word[lo], stop[hi - 1], hi - lo
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    to = np.searchsorted(start, np.r_[first, len(code) + 1])
    shift = np.repeat(first, np.diff(to))
    spans = list(zip((start - shift).tolist(), (end - shift).tolist(), strict=True))
    return [spans[a:e] for a, e in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], n_words


def cut_lines(texts: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """(start, end) of the lines of each text, and the number of words of every line.

    A line ends with a line break or with a sentence, and long ones are wrapped at spaces that the
    characters around them choose, so that a passage is the same run of lines wherever it is
    quoted, also from the middle of a sentence or after a changed word. Blank lines are none.
    """
    spans: list[list[tuple[int, int]]] = []
    words = [np.zeros(0, np.int64)]
    a, size = 0, 0
    for e, t in enumerate(texts, 1):
        size += len(t)
        if size >= _AT_ONCE or e == len(texts):
            got, n = _cut(texts[a:e])
            spans += got
            words.append(n)
            a, size = e, 0
    return spans, np.concatenate(words)


def lines_of(text: str) -> list[tuple[int, int]]:
    return cut_lines([text])[0][0]


@dataclass
class Windows:
    """The windows of a block of texts: numbers of their first and past their last line, of the line whose hash is least, and their hash."""

    at: np.ndarray
    end: np.ndarray
    least: np.ndarray
    key: np.ndarray
    line: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def windows(texts: list[str], least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> Windows:
    """All least windows: from every line the fewest lines on, and up to every line the fewest lines back, that are least_lines and least_words.

    Which windows those are depends on the lines in them alone, so a run that stands elsewhere has
    the same windows there, each with the same least line hash; and the windows of a run cover it.
    doc: the text of each line; first: the number of each text's first line.
    """
    digest = xxhash.xxh64_intdigest
    spans, n_words = cut_lines(texts)
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    first = np.cumsum(sizes) - sizes
    line = np.fromiter((digest(t[x:y], 1) for t, s in zip(texts, spans, strict=True) for x, y in s), np.uint64, int(sizes.sum()))
    n = len(line)
    doc = np.repeat(np.arange(len(texts)), sizes)
    before = np.r_[0, np.cumsum(n_words)]
    p = np.arange(n)
    start, stop = first[doc], (first + sizes)[doc]
    end_on = np.maximum(p + least_lines, np.searchsorted(before, before[p] + least_words))
    back = np.minimum(p + 1 - least_lines, np.searchsorted(before, before[p + 1] - least_words, "right") - 1)
    # a window that is the least on and back is one
    more = back >= start
    more[more] = end_on[back[more]] != p[more] + 1
    on = end_on <= stop
    at, end = np.r_[p[on], back[more]], np.r_[end_on[on], p[more] + 1]
    # hashes and minima grow line by line, the longer windows alone
    h = np.zeros(len(at), np.uint64)
    least, low = at.copy(), line[at] if len(at) else np.zeros(0, np.uint64)
    grow, k = np.arange(len(at)), 0
    while len(grow):
        own = line[at[grow] + k]
        h[grow] = (h[grow] ^ (h[grow] >> np.uint64(31))) * _STEP + own
        less = own < low[grow]
        least[grow[less]] = at[grow[less]] + k
        low[grow[less]] = own[less]
        k += 1
        grow = grow[end[grow] - at[grow] > k]
    return Windows(at, end, least, (h ^ (h >> np.uint64(32))) * _STEP, line, doc, first)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted rows (document, from, to) of overlapping or touching line ranges as one row each."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 2] + spans[:, 0] * (spans[:, 2].max() + 2)) - spans[:, 0] * (spans[:, 2].max() + 2)
    new = np.r_[True, (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > reach[:-1])]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], spans[at, 1], np.maximum.reduceat(reach, at)], axis=1)


_FOUND = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("line", pa.int32()), ("windows", pa.binary())])
_MARKS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("spans", pa.binary())])
_FOUND_SQL, _MARKS_SQL = "key long, fp long, doc_id long, digest long, line int, windows binary", "doc_id long, digest long, spans binary"


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of values as binary rows."""
    offsets = np.r_[0, np.cumsum(sizes)] * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary rows, and how many each row has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].tobytes() if raw is not None else b""
    return np.frombuffer(data, kind), np.diff(offsets) // np.dtype(kind).itemsize


def _block(ids: list, digests: np.ndarray, texts: list[str], least_lines: int, least_words: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a block sends: its first place of every window, by fingerprint, and what it knows to be repeated already, by document."""
    w = windows(texts, least_lines, least_words)
    if not len(w.at):
        return
    number = np.array([_LAST if i is None else i for i in ids], np.int64)
    none = np.array([i is None for i in ids])
    # equal rows have one rank: none of them is earlier than the other
    order = np.lexsort((digests, number, none))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(_groups(none[order], number[order], digests[order])) - 1
    doc = w.doc[w.at]
    place = rank[doc] << 32 | (w.at - w.first[doc])
    fp = w.line[w.least]
    order = np.lexsort((place, fp, w.key))
    new = _groups(w.key[order], fp[order])
    earliest = place[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    known = order[place[order] != earliest]
    # every equal row's windows lead: they name one place
    own = order[new]
    if len(known):
        spans = _merged(np.unique(np.stack([rank[doc[known]], w.at[known] - w.first[doc[known]], w.end[known] - w.first[doc[known]]], axis=1), axis=0))
        of = np.empty(int(rank.max()) + 1, np.int64)
        of[rank] = np.arange(len(ids))
        starts = np.flatnonzero(_groups(spans[:, 0]))
        who = of[spans[starts, 0]]
        sizes = np.diff(np.r_[starts, len(spans)])
        yield pa.RecordBatch.from_arrays([pa.array(digests[who]), pa.nulls(len(who), pa.int64()), pa.array(number[who], mask=none[who]), pa.array(digests[who]), pa.array(np.full(len(who), -1, np.int32)), _binary(spans[:, 1:].astype("<i4").reshape(-1), 2 * sizes)], schema=_FOUND)
    apart = np.isin(fp[own], hot)
    own = own[np.lexsort((w.key[own] * apart, w.least[own]))]
    apart = np.isin(fp[own], hot)
    least = w.least[own]
    starts = np.flatnonzero(_groups(least, w.key[own] * apart))
    sizes = np.diff(np.r_[starts, len(own)])
    packed = np.empty(len(own), _window(max(least_lines, least_words)))  # a line has a word at least
    packed["h"], packed["back"], packed["on"] = w.key[own], least - w.at[own], w.end[own] - least
    head = own[starts]
    who = doc[head]
    key = np.where(apart[starts], w.key[head], fp[head])
    arrays = [key.view(np.int64), fp[head].view(np.int64), number[who], digests[who], (w.least[head] - w.first[who]).astype(np.int32)]
    for s in range(0, len(starts), 1 << 15):
        e = s + (1 << 15)
        a, b = starts[s], starts[e] if e < len(starts) else len(own)
        cols = [pa.array(x[s:e]) for x in arrays]
        cols[2] = pa.array(number[who[s:e]], mask=none[who[s:e]])
        yield pa.RecordBatch.from_arrays([*cols, _binary(packed[a:b], sizes[s:e])], schema=_FOUND)


def _resolve(table: pa.Table, window: np.dtype) -> Iterator[pa.RecordBatch]:
    """The spans of lines, by document, of windows that stand at an earlier place."""
    table = table.combine_chunks()
    fp = table.column("fp").combine_chunks()
    through = table.filter(fp.is_null())
    for batch in through.select(["doc_id", "digest", "windows"]).to_batches():
        yield pa.RecordBatch.from_arrays(batch.columns, schema=_MARKS)
    table = table.filter(fp.is_valid()).combine_chunks()
    if not table.num_rows:
        return
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    fp, digest, line = (column[c].to_numpy() for c in ("fp", "digest", "line"))
    none = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
    number = column["doc_id"].fill_null(_LAST).to_numpy()
    packed, sizes = _values(column["windows"], window)
    row = np.repeat(np.arange(len(fp)), sizes)
    at = line[row].astype(np.int64) - packed["back"]
    order = np.lexsort((at, digest[row], number[row], none[row], fp[row], packed["h"]))
    r, a = row[order], at[order]
    new = _groups(packed["h"][order], fp[r])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = order[(a != a[head]) | (digest[r] != digest[r[head]]) | (number[r] != number[r[head]]) | (none[r] != none[r[head]])]
    if not len(later):
        return
    # all windows of a fingerprint hold its line, so those of them that stand earlier make one span
    later = later[np.argsort(row[later], kind="stable")]
    starts = np.flatnonzero(_groups(row[later]))
    who = row[later[starts]]
    spans = np.empty((len(starts), 2), "<i4")
    spans[:, 0] = np.minimum.reduceat(at[later], starts)
    spans[:, 1] = np.maximum.reduceat(line[row[later]] + packed["on"][later].astype(np.int64), starts)
    for s in range(0, len(who), 1 << 15):
        of = who[s : s + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(number[of], mask=none[of]), pa.array(digest[of]), _binary(spans[s : s + (1 << 15)].reshape(-1), np.full(len(of), 2))], schema=_MARKS)


def repeated_spans(keyed: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, digest, spans): the line ranges, as pairs of 32-bit numbers, of each document of keyed (doc_id, text, digest) that stand earlier.

    One row per fingerprint and document goes to the fingerprint's part; a block of a task sends
    each window once, so a fingerprint whose surroundings are the same costs a row a block. Those
    that a sample shows to be frequent among different surroundings are dealt by window instead.
    """
    chars, rows = keyed.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    share = HOT_SAMPLE / max(rows, 1)
    drawn = keyed if share >= 1 else keyed.filter(F.pmod(F.xxhash64(F.lit("hot"), "digest", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def found(hot: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, texts in sliced_texts(_with_keys(batches), BLOCK_CHARS):
                ids = [k["i"] for k in keys]
                yield from _block(ids, np.array([k["d"] for k in keys], np.int64), texts, least_lines, least_words, hot)

        return run

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _resolve(pa.Table.from_batches(held), _window(max(least_lines, least_words)))

    order = ["doc_id", "digest", "text"]
    seen = drawn.select(*order).mapInArrow(found(np.zeros(0, np.uint64)), _FOUND_SQL).filter("fp is not null")
    counts = seen.groupBy("fp").count()
    least = max(HOT_LEAST, math.ceil(HOT_SHARE * (seen.count() if rows else 0)))
    hot = np.array([r[0] for r in counts.filter(F.col("count") >= least).select("fp").collect()], np.int64).view(np.uint64)  # at most 1 / HOT_SHARE rows
    parts = max(shuffle_partitions(keyed), math.ceil((chars or 0) / PART_CHARS))
    sent = keyed.select(*order).mapInArrow(found(hot), _FOUND_SQL)
    marks = sent.repartition(parts, "key").mapInArrow(resolve, _MARKS_SQL)
    return marks.groupBy("doc_id", "digest").agg(F.collect_list("spans").alias("spans"))


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["i", "d"]), b.column(2)], names=["key", "text"])


def without(text: str, spans: list[tuple[int, int]], gone: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """The text without the lines that are gone, and the removed ranges. A line break after a removed run stays if text stands before it on its line."""
    cuts: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
    for a, e in edges:
        start, end = spans[a][0], spans[e - 1][1]
        stop = spans[e][0] if e < len(spans) else len(text)
        line_start = a == 0 or "\n" in text[spans[a - 1][1] : start]
        if line_start or "\n" not in text[end:stop]:
            end = stop
        cuts.append((start, end))
    kept, at = [], 0
    for s, e in cuts:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return "".join(kept), cuts


def _deduped(docs: DataFrame, least_lines: int, least_words: int) -> DataFrame:
    """row (a struct of all columns but text), doc_id, text, new (the text without later runs), n_removed, removed of every row."""
    id_col, text_col = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id")]
    own = docs.select(F.struct(F.col("doc_id"), F.col("text").isNull().alias("none"), F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest")).alias("row"), id_col, text_col)
    own = own.withColumn("digest", F.xxhash64("text"))
    marks = repeated_spans(own.select("doc_id", "text", "digest"), least_lines, least_words)
    # keys without nulls, so that join and window deal the texts out once
    keys = ["id", "no_id", "digest"]
    with_keys = {"id": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull()}
    both = own.withColumns(with_keys).join(marks.withColumns(with_keys).drop("doc_id"), keys, "left")
    # rows that are equal in id and text: all but one are later repeats of it
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("digest"))
    both = both.select("row", "doc_id", "text", "spans", nth.alias("nth"))
    shape = both.select("row", "doc_id", "text").schema

    def cut(text: str, spans: list | None, nth: int) -> tuple[str, int, str]:
        lines, words = cut_lines([text])
        gone = np.zeros(len(lines[0]), bool)
        for blob in spans or []:
            for a, e in np.frombuffer(blob, "<i4").reshape(-1, 2).tolist():
                gone[a:e] = True
        if nth > 1 and len(gone) >= least_lines and words.sum() >= least_words:
            gone[:] = True
        new, cuts = without(text, lines[0], gone)
        return new, int(gone.sum()), ",".join(f"{x}:{y}" for x, y in cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                touched = part.column("spans").is_valid().to_numpy(zero_copy_only=False) | (part.column("nth").to_numpy() > 1)
                n, removed, text = np.zeros(part.num_rows, np.int64), [""] * part.num_rows, part.column("text")
                if touched.any():
                    held = text.to_pylist()
                    for k in np.flatnonzero(touched).tolist():
                        held[k], n[k], removed[k] = cut(held[k], part.column("spans")[k].as_py(), part.column("nth")[k].as_py())
                    text = pa.array(held, text.type)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), text, pa.array(n), pa.array(removed, pa.string())], names=["row", "doc_id", "text", "n_removed", "removed"])

    found = shape.add("n_removed", "long").add("removed", "string")
    return both.mapInArrow(run, found)


def dedup_lines(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text (without later repeated runs), n_removed (lines), removed of every row.

    removed: start:end of the removed ranges in characters, joined by commas. A run of lines is
    repeated if it stands earlier as it is, in one place, and is least_lines lines and least_words
    words or more (2 and 20 as they are; shorter repeats, such as a sentence that many documents
    hold, stay). Documents are ordered by doc_id, null ids last, then by a hash of the text; the
    first place of a run keeps it. Of rows equal in id and text one is the first. Null texts are
    empty; an empty table gives no rows; other columns are not read.

    Lines are hashed, and each least window of lines that could be a run gives the least of its
    hashes as its fingerprint: two places that share a run of that length share a fingerprint. The
    places of a fingerprint are joined, and a match there is extended to both sides as far as the
    windows around it agree; the fingerprints of a longer run follow each other in it, so that their
    spans cover it from end to end. Guarantee: the lines deleted are those of all runs of least_lines
    and least_words or more that stand earlier, and no others.
    """
    return _deduped(docs.select("doc_id", "text"), least_lines, least_words).select("doc_id", "text", "n_removed", "removed")


def dedup_columns(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, all columns, with later repeated runs deleted from text; n_chars follows the text.

    Texts without a repeat stay as they are, null ones too; rows whose text is left blank by the
    deletion go, rows that were blank before stay.
    """
    found = _deduped(docs, least_lines, least_words).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    out: dict[str, Column] = {"doc_id": F.col("row.doc_id"), "text": F.when(~F.col("row.none"), F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.rest.n_chars"))
    return found.select(*[out[c].alias(c) if c in out else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns])
