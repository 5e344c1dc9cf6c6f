"""Stupid-backoff scores from n-gram counts of the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import cut_lineage
from folioscope.llm.packed import bounds, check_of, exchange, expand, pack_sorted, sent, squeeze, texts_by_block, unpack_sorted, unpack_texts

#: Longest n-gram and back-off factor.
ORDER, BACKOFF = 3, 0.4

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def word_hashes(texts: list[str], cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII lower case, between ASCII white space), and the number of words of each text."""
    parts, sizes = [], []
    for t in texts:
        ws = t.encode("utf-8").lower().split()
        sizes.append(len(ws))
        parts.append(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, dtype=np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of last words, hashes) of the n-grams of 1 to order words that lie within one text."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = _mixed(words)
    yield np.arange(len(words)), h
    for n in range(2, order + 1):
        h = _mixed(h[:-1] * _STEP + words[n - 1 :])
        ok = place[n - 1 :] >= n - 1
        yield np.flatnonzero(ok) + n - 1, h[ok]


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, bucket, n, counts, tokens, check): for each block and range of hashes, the corpus counts of the block's n-grams.

    The table of counts is partitioned by hash; every count is kept. Keys go as the KEY_BITS leading
    bits within their bucket, so that two n-grams of a bucket meet with a chance of keys / 2**48, about
    one in a hundred million, whatever the input. check is a hash of all the block's n-grams of n words.
    """
    size, buckets = exchange(docs)

    def make(block: int, ids: list, texts: list[str]) -> Iterator[dict]:
        words, sizes = word_hashes(texts, _Hashes())
        for n, (_, h) in enumerate(gram_hashes(words, sizes, order), 1):
            keys, counts = np.unique(h, return_counts=True)
            at = bounds(keys, buckets)
            check = check_of(keys)
            for b in range(buckets):
                own = keys[at[b] : at[b + 1]]
                if len(own):
                    yield {"block": block, "bucket": b, "n": n, "tokens": int(counts[at[b] : at[b + 1]].sum()), "check": check, "keys": pack_sorted(own, b, buckets), "counts": squeeze(counts[at[b] : at[b + 1]].astype(np.uint32))}

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(blob) for blob in rows["keys"]]
        ends = np.cumsum([len(x) for x in keys])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.bincount(place, weights=np.concatenate([expand(c, np.uint32) for c in rows["counts"]])).astype(np.int64)[place]
        answers = [squeeze(found[e - len(x) : e]) for e, x in zip(ends, keys, strict=True)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "n": rows["n"], "counts": answers, "tokens": rows["tokens"], "check": rows["check"]})

    claims = sent(docs, make, "block long, bucket int, n int, tokens long, check long, keys binary, counts binary", size)
    return claims.groupBy("bucket", "n").applyInPandas(count, "block long, bucket int, n int, counts binary, tokens long, check long")


def others(counts: np.ndarray, number: np.ndarray, doc: np.ndarray, keys: int) -> np.ndarray:
    """Corpus counts of the n-grams at some places (by number) less those of the place's own document."""
    _, pair, own = np.unique(doc * max(keys, 1) + number, return_inverse=True, return_counts=True)
    return counts[number] - own[pair]


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, log_score (natural, of the whole text) and mean_log_score of every row.

    Counts are of all documents, repeated rows included; a row is scored by those of all other rows,
    as its own n-grams would each find themselves. A word's score is c(n-gram) / c(context) for the
    longest n-gram ending in it that another row holds, times backoff for each word dropped; a
    single word's is c(word) / all words of the table, and a word that no other row holds counts as
    held once. A null or empty text has no tokens, log_score 0 and a null mean. Null doc_ids and
    repeated rows stay; an empty table gives no rows; other columns are not read. docs must give the
    same rows in the same tasks each time it is read, as tables and checkpoints do; a difference is
    an error.
    """
    counts = cut_lineage(ngram_counts(docs, order))
    total = counts.filter("n = 1").agg(F.sum("tokens")).first()[0] or 0

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in texts["blob"]:
            ids, own = unpack_texts(blob)
            words, sizes = word_hashes(own, _Hashes())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            by_place = []
            for n, (places, h) in enumerate(gram_hashes(words, sizes, order), 1):
                rows = found[found["n"] == n].sort_values("bucket")
                answers = [expand(c, np.int64) for c in rows["counts"]]
                keys, back = np.unique(h, return_inverse=True)
                answer = np.concatenate(answers) if answers else np.zeros(0, np.int64)
                if len(answer) != len(keys) or (rows["check"] != check_of(keys)).any():
                    raise ValueError("the documents changed between two reads")
                c = np.zeros(len(words), np.int64)
                if len(keys):
                    c[places] = others(answer, back, doc[places], len(keys))
                if by_place and len(words):
                    # no n-gram is held more often than its parts; where hashes met, that bounds the harm
                    c = np.minimum(c, np.minimum(by_place[-1], np.r_[0, by_place[-1][:-1]]))
                by_place.append(c)
            best = np.full(len(words), (order - 1) * math.log(backoff)) + (np.log(np.maximum(by_place[0], 1)) - math.log(max(total, 1)) if len(words) else 0)
            for n in range(1, order):
                context = np.r_[0, by_place[n - 1][:-1]] if len(words) else by_place[0]
                have = by_place[n] > 0
                best[have] = (order - 1 - n) * math.log(backoff) + np.log(by_place[n][have]) - np.log(context[have])
            log = np.zeros(len(sizes))
            full = np.flatnonzero(sizes)
            if len(full):  # each text is summed by itself, so that its score does not depend on its block
                log[full] = np.add.reduceat(best, (np.cumsum(sizes) - sizes)[full])
            out.append(pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_tokens": sizes, "log_score": log, "mean_log_score": pd.array([x / s if s else None for x, s in zip(log.tolist(), sizes.tolist(), strict=True)], dtype="Float64")}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_tokens": [], "log_score": [], "mean_log_score": []})

    shape = "doc_id long, n_tokens long, log_score double, mean_log_score double"
    answers = counts.select("block", "bucket", "n", "counts", "check")
    return texts_by_block(docs).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, shape)
