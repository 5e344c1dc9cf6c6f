"""The pipeline's stages, each against brute force on what the stage before kept."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from folioscope.llm import langid, line_dedup
from test_llm_operators import DOCS, redacted, signed_hash, simhash_of, texts, true_runs
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame(rows, DOCS).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "secrets", "packing"]
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        outs.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    language, lines, near, clean, packed = outs

    # language: texts stay that share n-grams with those learned from, counted in sets
    def grams_of(t):
        low = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in t) + " "
        return [low[k : k + n] for n in langid.SIZES for k in range(len(low) - n + 1) if low[k + 1 : k + n - 1].isalpha()]

    known = defaultdict(set)
    for i, t, x, *_ in rows:
        if t and x and zlib.crc32(("" if i is None else str(i)).encode()) % 5:
            known[x].update(grams_of(t))
    want = Counter()
    for i, t, *_ in rows:
        own = grams_of(t or "")
        if own and max(sum(g in s for g in own) / len(own) for s in known.values()) >= 0.05:
            want[i] += 1
    assert Counter(r.doc_id for r in language) == want
    # lines: exactly the runs go that stand earlier, by brute force over all runs
    text = sorted(((r.doc_id, r.text) for r in language), key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1])))
    split = [[t[a:b] for a, b in line_dedup.lines_of(t)] for _, t in text]
    gone = true_runs([x[:400] for x in split], line_dedup.LEAST_LINES, line_dedup.LEAST_WORDS)
    left = {i: "".join(x for x, g in zip(own, gs, strict=False) if not g) for (i, _), own, gs in zip(text, split, gone, strict=True) if len(own) <= 400}
    after = {r.doc_id: r.text for r in lines}
    assert {i: re.sub(r"\s", "", t) for i, t in after.items() if i in left} == {i: re.sub(r"\s", "", t) for i, t in left.items() if t}
    assert all(len(r.text) == r.n_chars for r in lines)
    # near copies: the smallest id of each group of linked fingerprints stays
    fps = {r.doc_id: simhash_of(r.text) for r in lines if r.doc_id is not None}
    group = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[a]] == group[a] for a in group):
            break
    assert {r.doc_id for r in near if r.doc_id is not None} == {i for i, g in group.items() if i == g}
    # secrets: every span of every rule gives way, the rest of the texts is as it was
    assert sorted((str(r.doc_id), r.text) for r in clean) == sorted((str(r.doc_id), redacted(r.text)) for r in near)
    # packing: each document's pieces are gapless, hold the ids of the tokenizer, and lie one after the other in sequences
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in clean}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by) == set(ids)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == parts[0].doc_tokens
    for parts in sequences.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 1024
    same = corpus_pipeline.run(spark, str(tmp_path))
    assert same.count() == len(packed)


def test_one_row_of_each_group_of_near_copies_stays(spark):
    """Also where rows share a doc_id or have none."""
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "red green blue white"), (None, "red green blue white")]
    rows += [(None, "alpha beta gamma delta"), (3, "nothing like the other texts")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (1, rows[2][1]), (None, rows[4][1]), (3, rows[7][1])], key=str)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS).select(*COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if k < 4 else docs
        assert k == 4 or docs.columns == COLUMNS


def test_extra_columns(spark):
    """The first four stages keep the columns of documents also where names clash with their own."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept_key", "row", "digest", "spans", "nth", "id", "rest", "component_id"]
    docs = spark.createDataFrame([(*r[:5], *([k] * 8)) for k, r in enumerate(texts()[:20])], ", ".join(f"{n} {k}" for n, k in zip(names, ["long", "string", "string", "string", "long"] + ["int"] * 8, strict=True)))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
    assert docs.count() == 20


def test_a_column_of_maps_goes_through(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>"
    docs = spark.createDataFrame([(1, "the same words in a row of some length", "en", "s", 1, {"k": 1}), (2, "the same words in a row of some length", "en", "s", 1, None), (3, "quite another text", "en", "s", 1, {"z": 2})], shape)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {(r.doc_id, str(r.m)) for r in got.collect()} == {(1, "{'k': 1}"), (3, "{'z': 2}")} and got.dtypes == docs.dtypes
