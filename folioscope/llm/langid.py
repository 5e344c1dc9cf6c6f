"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import id_and_text, sliced_texts

#: Lengths of the n-grams.
SIZES = (3, 4)
#: Documents of one language that the filters are learned from, in expectation; the bound of the sample.
SAMPLE_DOCS = 3000
#: Values of lang that are taken for languages.
MOST_LANGUAGES = 1024
#: Slots of the filters, each one bit per language, and slots set per n-gram.
SLOTS, HASHES = 1 << 22, 2
_SPACE = 32


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, space for anything else."""
    table = np.full(1 << 16, _SPACE, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of the text) of each n-gram, one array pair per length of n-gram.

    Letters in lower case, runs of anything else count as a space; an n-gram holds letters except
    at its two ends, so it never crosses a word or a text.
    """
    raw = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plane = raw < (1 << 16)
    code = table[np.where(plane, raw, 0)]
    if not plane.all():
        high = np.flatnonzero(~plane)
        code[high] = [ord(c.lower()[0]) if c.isalpha() else _SPACE for c in map(chr, raw[high].tolist())]
    letter = code != _SPACE
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), np.r_[2, sizes])[: len(code)] - 1
    code = code.astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for n in SIZES:
        count = len(code) - n + 1
        inner = letter[1 : 1 + count].copy()
        for k in range(2, n - 1):
            inner &= letter[k : k + count]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ code[at + k]) * step
            h ^= h >> np.uint64(29)
        yield h, owner[at + 1]


@dataclass
class Filters:
    """languages by bit; slots[s] has bit l set if language l's filter has slot s set; false[l]: its false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(22 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _width(languages: int) -> tuple[int, type]:
    """Bits of a word of the slots and its type: one word of the least size if it holds all languages."""
    for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32)):
        if languages <= bits:
            return bits, kind
    return 64, np.uint64


def enter(slots: np.ndarray, language: int, h: np.ndarray) -> None:
    """Set a language's bit in all slots of n-gram hashes."""
    bits, kind = 8 * slots.itemsize, slots.dtype.type
    for k in range(HASHES):
        slots[language // bits, _slots(h, k)] |= kind(1 << language % bits)


def no_slots(languages: int) -> np.ndarray:
    bits, kind = _width(languages)
    return np.zeros((max(1, -(-languages // bits)), SLOTS), kind)


def filters_of(languages: list[str], slots: np.ndarray) -> Filters:
    bits = 8 * slots.itemsize
    fill = [float((slots[k // bits] >> slots.dtype.type(k % bits) & slots.dtype.type(1)).mean()) for k in range(len(languages))]
    return Filters(languages, slots, np.array(fill) ** HASHES)


def decide(filters: Filters, texts: list[str], table: np.ndarray) -> list[tuple[str, float]]:
    """(language, score) of each text: und and 0.0 where there is no letter or nothing was learned.

    Ties go to the language with the fewest n-grams, of which each is the likelier, then to the one sorted first.
    """
    n = len(texts)
    total, hits = np.zeros(n), np.zeros((len(filters.languages), n))
    for h, owner in grams(texts, table):
        total += np.bincount(owner, minlength=n)
        first, second = (_slots(h, k) for k in range(HASHES))
        bits, kind = 8 * filters.slots.itemsize, filters.slots.dtype.type
        for word, slots in enumerate(filters.slots):
            mask = slots[first] & slots[second]
            for bit in range(bits * word, min(bits * word + bits, len(filters.languages))):
                here = (mask >> kind(bit - bits * word) & kind(1)).astype(bool)
                hits[bit] += np.bincount(owner[here], minlength=n)
    if not filters.languages:
        return [("und", 0.0)] * n
    rate = filters.false[:, None]
    true = np.clip((hits - total * rate) / (1 - rate), 0, None)
    by_fill = np.argsort(filters.false, kind="stable")
    best = by_fill[np.round(true[by_fill], 6).argmax(axis=0)]
    score = np.clip(true[best, np.arange(n)] / np.maximum(total, 1), 0, 1)
    return [(filters.languages[b], float(s)) if t else ("und", 0.0) for b, s, t in zip(best.tolist(), score.tolist(), total.tolist(), strict=True)]


def bucket_of(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, folds: int = 5, most_languages: int = MOST_LANGUAGES) -> Filters:
    """Filters from rows with a non-null text and lang whose crc32(doc_id) mod folds is not 0.

    About sample_docs rows of each language are read, drawn by a hash of the id, so repeated rows
    are drawn together; every n-gram of them is entered. Tasks set bits and send the words of slots
    that are not zero, which meet by bitwise or: the driver receives SLOTS words for each 64
    languages at most; more than most_languages values of lang are an error. No labelled row, an empty table among them, gives filters without a language.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null").filter(bucket_of("doc_id", folds) != 0)
    counts = base.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values: it names no languages")
    languages = sorted(lang for lang, _ in counts)
    slots = no_slots(len(languages))
    if not counts:
        return filters_of([], slots)
    fraction = F.lit(0.0)
    for lang, n in counts:
        fraction = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(fraction)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < fraction * (1 << 30)
    number = {lang: k for k, lang in enumerate(languages)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = _letters(), no_slots(len(languages))
        for langs, texts in sliced_texts(batches, 2 << 20):
            of = np.array([number[x] for x in langs])
            for h, owner in grams(texts, table):
                lang = of[owner]
                for k in np.unique(lang).tolist():
                    enter(own, k, h[lang == k])
        for word, row in enumerate(own):
            at = np.flatnonzero(row)
            for s in range(0, len(at), 1 << 16):
                part = at[s : s + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"word": pa.array(np.full(len(part), word, np.int32)), "slot": pa.array(part.astype(np.int32)), "bits": pa.array(row[part].astype(np.uint64).view(np.int64))})

    sent = base.filter(drawn).select("lang", "text").mapInArrow(bits, "word int, slot int, bits long")
    met = sent.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, slot, found = (met.column(c).to_numpy() for c in ("word", "slot", "bits"))
    slots[word, slot] = found.view(np.uint64).astype(slots.dtype)
    return filters_of(languages, slots)


def identify(docs: DataFrame, filters: Filters, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from whole texts alone.

    A null text or one without a letter is `und` with score 0; so is everything if nothing was
    learned. Score: share of the text's n-grams that the language's filter holds, corrected for
    false positives. Null doc_ids and repeated rows stay; an empty table
    gives no rows; ties as in decide().
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for ids, texts in sliced_texts(batches, 1 << 20):
            table = _letters() if table is None else table
            found = decide(filters, texts, table)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=schema)

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (bucket_of("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, filters: Filters, least_score: float = 0.05) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is of a learned language; und and scores below least_score go.

    Null and empty texts and texts without a letter go; null doc_ids and repeated rows are judged
    each by its own text; an empty table stays empty.
    """

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = _letters() if table is None else table
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows), pa.compute.fill_null(part.column(at), "")], names=["id", "text"])
                keep: list[bool] = []
                for _, some in sliced_texts(iter([texts]), 1 << 20):
                    keep += [lang != "und" and s >= least_score for lang, s in decide(filters, some, table)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
