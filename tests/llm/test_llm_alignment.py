"""Token alignment against the libraries' own encodings and a walk over all pairs."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioscope.llm import alignment
from folioscope.llm.packing import _byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SHAPE = "doc_id long, text string"


def by_hand(texts):
    """Rows by the libraries: whole encodings, every pair of ranges that overlap."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    names, byte = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}, _byte_alphabet()
    rows, all_links = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            rows.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in of]).tolist() for of in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        out, low = [], 0
        for cut in both:
            out.append("|".join(",".join(str(i) for i, e in zip(ids, of, strict=True) if low < e <= cut) for ids, of in zip((a, b), ends, strict=True)))
            low = cut
        starts = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        all_links.update(links)
        rows.append((len(a), len(b), len(both), links, hashlib.sha256(";".join(out).encode()).hexdigest()))
    top = Counter()
    for (_, j), n in all_links.items():
        top[j] = max(top[j], n)
    return [(n_a, n_b, g, len(ls), sum(all_links[x] == top[x[1]] for x in ls), sum(all_links[x] for x in ls), h) for n_a, n_b, g, ls, h in rows]


def check(spark, texts, **kw):
    got = alignment.align(spark.createDataFrame(list(enumerate(texts)), SHAPE).repartition(3), A, B).collect()
    assert len(got) == len(texts)
    want = by_hand([t or "" for t in texts])
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], texts[r.doc_id]


ODD = [
    None, "", " ", "   ", "a", "\n", "a  b\n\n c ", "\x00a\x00", "▁x a▁b", "<s> </s> <0x0A> <unk>", "<|endoftext|> x", "éñß 中文字符 한국어 \U0001f600\U0001f468‍\U0001f469", "a" * 3000, " " * 500 + "x",
    "tab\there\r\nand };\r\n", "ﬁ ligature ① ½ Å", "word " * 400, "�", "It's we'll they've 1234567 3.14", " nbsp　wide",
]


def test_odd_texts(spark):
    check(spark, ODD)


def test_random_texts(spark):
    rng = random.Random(13)
    letters = "abcdefghij   ....\n\t'\"()é中\U0001f600▁0123"
    words = ["the", " and", "tion", "  ", "\n\n", "Über", "<|endoftext|>", "'s", "don't", "x=1;", "\r\n"]
    check(spark, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)] + ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)])


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("substring(text, 1, 3000) AS text").limit(60).collect()
    check(spark, [r.text for r in rows])


def test_blocks_and_known_spans_do_not_matter(spark, monkeypatch):
    texts = [f"{t} {k}" for k in range(3) for t in ODD if t]
    want = by_hand(texts)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 50)
    monkeypatch.setattr(alignment, "KNOWN_SPANS", 3)
    got = alignment.align(spark.createDataFrame(list(enumerate(texts)), SHAPE), A, B).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_tables_that_hold_little(spark):
    assert alignment.align(spark.createDataFrame([], SHAPE), A, B).collect() == []
    clash = spark.createDataFrame([(None, "a b", "x", 1, {"k": 1}), (None, "a b", "y", 2, None), (3, None, None, None, None)], SHAPE + ", pair string, block long, `a.b` map<string,int>")
    got = sorted(map(tuple, alignment.align(clash, A, B).drop("groups_sha256").collect()), key=str)
    assert got == [(3, 0, 0, 0, 0, 0, 0), (None, 2, 2, 2, 2, 2, 4), (None, 2, 2, 2, 2, 2, 4)]


@pytest.mark.parametrize("text", ["a" * 400_000, "word of text, and more. " * 40_000])
def test_very_long_texts(spark, text):
    r = alignment.align(spark.createDataFrame([(1, text)], SHAPE), A, B).first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a and r.n_best and len(r.groups_sha256) == 64
