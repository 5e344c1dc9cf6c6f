"""Near-duplicates by min-max hashing against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import minmax
from folioscope.llm.common import joined_words, shingle_bounds

SHAPE = "doc_id long, text string"


def set_of(text, k=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_hand(rows, percent=85):
    sets, parent = [set_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def drawn(rng, groups, copies, length=(6, 300)):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, copies)):
            words = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5]))
            base = words if rng.random() < 0.3 else base  # chains, whose ends are no copies of each other
            rows.append((rng.choice([" ", "\n", "  \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def found(spark, rows, **kw):
    return sorted(map(tuple, minmax.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(3), **kw).collect()))


def test_random_groups(spark):
    rows = drawn(random.Random(11), 120, 8)
    assert found(spark, rows) == by_hand(rows)


def test_large_clusters_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CHUNK_SHINGLES", 2000)
    rows = drawn(random.Random(3), 6, 60, (40, 120))
    assert found(spark, rows) == by_hand(rows)
    chain, rng = [[f"w{k}" for k in range(120)]], random.Random(4)
    for _ in range(60):  # each is a copy of the one before, few of any other
        chain.append(edited(rng, chain[-1], 2))
    rows = list(enumerate(" ".join(w) for w in chain))
    assert found(spark, rows) == by_hand(rows)


def test_chunks_whose_representatives_do_not_link(spark, monkeypatch):
    """Two hot trees that only a pair of members outside all representatives connects."""
    monkeypatch.setattr(minmax, "CHUNK_SHINGLES", 400)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    left = [edited(rng, base, 1) for _ in range(12)]
    far = base
    for _ in range(12):
        far = edited(rng, far, 3)
    right = [edited(rng, far, 1) for _ in range(12)]
    middle, steps = base, []
    for k in range(0, 100, 3):
        middle = middle[:k] + far[k : k + 3] + middle[k + 3 :]
        steps.append(middle)
    rows = list(enumerate(" ".join(w) for w in left + right + steps))
    assert found(spark, rows) == by_hand(rows)


def test_both_ways_to_fetch_texts(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BROADCAST_ROWS", 0)
    rows = drawn(random.Random(8), 40, 6)
    assert found(spark, rows) == by_hand(rows)


def test_boundary_of_similarity(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    rows = []
    for cut in range(1, 20):
        rows += [(cut * 10, " ".join(f"g{cut}{w}" for w in base)), (cut * 10 + 1, " ".join(f"g{cut}{w}" for w in base[:-cut]))]
    assert found(spark, rows) == by_hand(rows)
    assert {d % 10 for d, _, _, kept in found(spark, rows) if not kept} == {1} and sum(not r[3] for r in found(spark, rows)) == 15


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a\tb  c d\x0b"), (8, "a b c d e"), (9, "É b"), (10, "é b"), (11, "a b"), (4, "a"), (4, "z")]
    assert found(spark, rows) == by_hand(rows)
    assert minmax.near_duplicates(spark.createDataFrame([], SHAPE)).collect() == []
    clash = spark.createDataFrame([(None, "a b", "x", 1, {"k": 1}), (7, "a b", "y", 2, None), (None, None, None, None, None), (None, "q", "", 0, None)], SHAPE + ", cls string, n long, `a.b` map<string,int>")
    got = sorted(map(tuple, minmax.near_duplicates(clash).collect()), key=str)
    assert got == [(7, 1, 7, True), (None, 0, None, True), (None, 1, 7, False), (None, 1, None, True)]


@pytest.mark.parametrize("text", ["a b " * 100_000, "x" * 500_000, " ".join(map(str, range(120_000)))])
def test_very_long_texts(spark, text):
    rows = [(2, text), (1, text + " more"), (3, "other words")]
    assert found(spark, rows) == [(1, len(set_of(rows[1][1])), *((1, True))), (2, len(set_of(text)), *((1, False) if len(text) > 600_000 or " " in text and len(set_of(text)) > 9 else (2, True))), (3, 1, 3, True)]


def test_least_and_largest_estimate_the_similarity():
    rng = np.random.default_rng(1)
    factors = minmax.multipliers()
    errors = []
    for _ in range(40):
        every = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        a, b = minmax.signature(every[:900], factors), minmax.signature(every[100:], factors)
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", " a  b\n", "\n\n", "a b c", "É\x0bB"])
def test_words_are_joined(text):
    joined, spaces = joined_words(text)
    want = text.encode().lower().split()
    assert joined == b" ".join(want) and len(spaces) == max(0, len(want) - 1)
    starts, ends = shingle_bounds(joined, spaces, 2)
    assert [joined[a:b] for a, b in zip(starts, ends, strict=True)] == ([b" ".join(want[i : i + 2]) for i in range(max(1, len(want) - 1))] if want else [])
