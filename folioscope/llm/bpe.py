"""Byte-level BPE: merges replayed over the distinct words of a block of text, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscope.llm.common import id_and_text, ship, shipped, sliced_texts

#: Characters of text whose new words are replayed together.
BLOCK_CHARS = 16 << 20
#: Bytes of a word from which it is replayed by itself.
LONG_WORD = 2048
#: Words remembered by a worker before it starts anew.
REMEMBERED = 500_000

_NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many distinct words at once by applying merges in rank order.

    Words lie in one array of symbols with linked neighbours; an inverted index leads from a merge
    rank to the places where its pair stands. The lowest rank with places is applied to them, and
    only the pairs at both sides of a merged place are looked up again. In these vocabularies a
    token can be older than its parts, so that a merge makes a pair of a lower rank; ranks that can
    do so are applied to the leftmost place of each word only, the others everywhere at once. Very
    long words, which would take a round for each such place, are replayed one by one, with the
    index as a heap of places by rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged, careful = [], [], set()
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
                    careful.update(x for x in (a, b) if x > r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.merged = np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int32)[order]
        self.careful = careful
        self.pair_rank: dict[int, int] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one word, in time that grows with its length times the logarithm of it."""
        if not self.pair_rank:
            self.pair_rank = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        rank_of = self.pair_rank.get
        start = self.byte[np.frombuffer(word, np.uint8)]
        n = len(start)
        found = self.rank_of(start[:-1], start[1:])
        sym, rank = start.tolist(), [*found.tolist(), _NONE]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.flatnonzero(found != _NONE)
        places = np.sort(found[at].astype(np.int64) << 32 | at).tolist()  # a sorted list is a heap
        push, pop, low = heapq.heappush, heapq.heappop, (1 << 32) - 1
        while places:
            top = pop(places)
            p, r = top & low, top >> 32
            if rank[p] != r:
                continue
            gone = nxt[p]
            after = nxt[gone]
            sym[p], sym[gone], rank[gone], nxt[p] = r, -1, _NONE, after
            rank[p] = _NONE
            if after < n:
                prv[after] = p
                new = rank_of(r << 32 | sym[after])
                if new is not None:
                    rank[p] = new
                    push(places, new << 32 | p)
            before = prv[p]
            if before >= 0:
                new = rank_of(sym[before] << 32 | r)
                rank[before] = _NONE if new is None else new
                if new is not None:
                    push(places, new << 32 | before)
        return [x for x in sym if x >= 0]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token itself is that token."""
        out: list = [[self.ranks[w]] if w in self.ranks else self.encode_long(w) if len(w) > LONG_WORD else None for w in words]
        rest = [k for k, o in enumerate(out) if o is None and words[k]]
        sizes = np.array([len(words[k]) for k in rest], dtype=np.int64)
        if not len(sizes):
            return [o or [] for o in out]
        sym = self.byte[np.frombuffer(b"".join(words[k] for k in rest), dtype=np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(rest), dtype=np.int64), sizes)
        nxt, prv = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(sizes)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        rank = np.full(n, _NONE, dtype=np.int32)
        left = np.flatnonzero(nxt >= 0)
        rank[left] = self.rank_of(sym[left], sym[left + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            found = rank[places]
            keep = found != _NONE
            places, found = places[keep], found[keep]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            for s, e, r in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], found[cuts].tolist(), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[s:e])

        enter(left)
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if r in self.careful:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                later, at = at[~first], at[first]
                if len(later):
                    index[r] = [later]
                    heapq.heappush(heap, r)
            elif len(at) > 1:
                touch = nxt[at[:-1]] == at[1:]
                if touch.any():  # overlapping places of one run: every second one, from the left
                    run = np.maximum.accumulate(np.where(np.r_[False, touch], 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            rank[gone] = _NONE
            sym[gone] = -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            rank[at] = _NONE
            right = at[has]
            rank[right] = self.rank_of(sym[right], sym[after[has]])
            before = prv[at]
            before = before[before >= 0]
            rank[before] = self.rank_of(sym[before], sym[nxt[before]])
            enter(np.concatenate([right, before]) if len(before) else right)
        kept = sym >= 0
        flat, owner = sym[kept].tolist(), word[kept]
        bounds = np.searchsorted(owner, np.arange(len(rest) + 1)).tolist()
        for i, k in enumerate(rest):
            out[k] = flat[bounds[i] : bounds[i + 1]]
        return [o or [] for o in out]


class BlockEncoder:
    """Encodes blocks of whole texts: words are matches of the pattern, each encoded once a block at most."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.words = regex.compile(pattern).findall
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}

    def learn(self, texts_words: Iterable[list[str]]) -> None:
        seen: set[str] = set()
        known = self.ids
        for ws in texts_words:
            seen.update(ws)
        new = seen - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            self.bytes.clear()
            new = seen
        listed = list(new)
        tokens = self.replay.tokens
        for w, ids in zip(listed, self.replay.encode([w.encode("utf-8") for w in listed]), strict=True):
            known[w] = " ".join(map(str, ids))
            self.bytes[w] = b"".join([tokens[i] for i in ids])

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Decimal ids joined by a space, and the bytes that the ids decode to, of each text."""
        words = [self.words(t) for t in texts]
        self.learn(words)
        for ws in words:
            yield " ".join(map(self.ids.__getitem__, ws)), b"".join(map(self.bytes.__getitem__, ws))


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with_ids the ids themselves.

    A null or empty text has no ids, and digests of nothing. Rows with a null doc_id and repeated
    rows stay; an empty table gives no rows; other columns are not read. Each task replays merges over the distinct words of
    runs of about BLOCK_CHARS characters and needs no shuffle; a text that is longer is whole.
    """
    name = ship(docs, ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for ids, texts in sliced_texts(batches, BLOCK_CHARS):
            encoder = encoder or BlockEncoder(shipped(name), pattern)
            rows: list[tuple] = []
            for i, (listed, decoded) in zip(ids, encoder(texts), strict=True):
                n = listed.count(" ") + 1 if listed else 0
                row = (i, n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, list(map(int, listed.split()))) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, fields)


def decode(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """Bytes of a list of ids."""
    return b"".join([tokens[i] for i in ids])
