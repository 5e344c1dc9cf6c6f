"""Odd tables through every operator: nothing but nulls, one row, no query, vectors of one component."""

import math
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest

from folioscope.llm import ann, bpe, langid, licenses, line_dedup, lm_score, packing, secrets, simhash, topk
from folioscope.session import cut_lineage

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "columns": line_dedup.dedup_columns,
    "packing": lambda d: packing.pack(d, JSON),
    "secrets": secrets.scan,
    "redact": secrets.redact,
    "language": lambda d: langid.identify(d, langid.learn(d)),
    "near": simhash.near_duplicates,
    "score": lm_score.score,
    "bpe": lambda d: bpe.encode(d, RANKS, P.PATTERN),
    "licenses": licenses.scan,
}
TABLES = {
    "nulls": [(None, None, None, None, None)] * 3,
    "null texts": [(k, None, "en", "s", 0) for k in range(3)],
    "null ids": [(None, t, None, None, None) for t in ("a b c", "a b c", "", "x")],
    "one": [(7, "One short text.", "en", "s", 15)],
    "equal": [(1, "The same line of text stands here. And one more of them follows it, with some words of its own to make it long.", "en", "s", 1)] * 4,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    for label, rows in TABLES.items():
        got = OPERATORS[name](spark.createDataFrame(rows, SHAPE)).collect()
        if name == "columns":
            assert len(got) == (1 if label == "equal" else len(rows)), label
        else:
            assert len(got) == len(rows), label
        if name == "near":
            assert {r.component_id for r in got} == ({None} if label in ("nulls", "null ids") else {min(r[0] for r in rows)}), label
        if name == "score":
            assert all(math.isfinite(r.log_score) for r in got)


def test_odd_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([(None, [1.0])], [(1, [1.0]), (3, [2.0])], [(0, None), (20, [float("nan")])], [(0, []), (100, [0.0])]):
        df = spark.createDataFrame(rows, shape)
        assert not ann.neighbours(df).collect()
        assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df).collect()] == ([(0, 100, 0), (100, 0, 0)] if rows[0][1] == [] else [])
    one = spark.createDataFrame([(0, [2.0]), (7, [-1.5]), (9, [3.0]), (100, [1.0])], shape)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.neighbours(one, k=2).orderBy("query_id", "rank").collect()] == [(0, 9, 6.0), (0, 100, 2.0), (100, 9, 3.0), (100, 0, 2.0)]
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(one, k=1).orderBy("query_id").collect()] == [(0, 9, 512 * 768), (100, 9, 256 * 768)]


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    context = spark.sparkContext

    class Elsewhere:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))})

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Elsewhere(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: None)})})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut_lineage(Frame())
    assert context.master.startswith("local")


def test_truncated_licenses_are_no_licenses(spark):
    """Mandatory wording that is missing from the end of a text is missing."""
    for label in ("unlicense", "boost"):
        words = licenses.TEMPLATES[label].split("<<opt>>For more")[0].replace("<<opt>>", "").replace("<<end>>", "").split()
        texts = [" ".join(words), " ".join(words[:46]), " ".join(words[:75]), " ".join(words[:-2]), " ".join(words[: len(words) // 2])]
        got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert label in got[0].split(",") and not any(label in got[k].split(",") for k in (1, 2, 3, 4)), label


def test_a_column_of_free_text_names_no_languages(spark):
    rows = [(k, f"text {k}", f"lang {k % 30}") for k in range(100)]
    with pytest.raises(ValueError, match="more than 20 values"):
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=20)


def test_probed_axes_of_wide_vectors_stay_small():
    """At 768 components a dense square of axes for 128 queries would take 537 MB."""
    rng = np.random.default_rng(3)
    axes, probes = 2048, 600
    row = np.repeat(np.arange(128), probes)
    first, second = rng.integers(0, axes, (2, len(row)))
    tracemalloc.start()
    seen = set()
    for r, f, bits in ann.probed_cells(row, first, second, axes):
        at, s = np.nonzero(np.unpackbits(bits, axis=1))
        seen |= set(zip(r[at].tolist(), f[at].tolist(), s.tolist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == set(zip(row.tolist(), first.tolist(), second.tolist(), strict=True)) and peak < 200e6
