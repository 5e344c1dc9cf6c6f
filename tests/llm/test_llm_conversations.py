"""Conversation repair against a search over all edits."""

import heapq
import random
import zlib

import pytest

from folioscope.llm import conversations

WS = " \t\n\x0b\x0c\r"
SHAPE = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """Faults of rows in their order, and the cheapest edits by a search that knows only the rules."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return faults, cost, audit, lines
        steps = [(3, "I", at, r, ((r + ":"),)) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            steps.append((4, "D", at + 1, None, ()))
            if faults[at] not in ("blank", "duplicate"):
                e = 3 if faults[at] == "truncated" else 0
                steps.append((e, "K", at + 1, role, (f"{role}:{text}",)))
                steps += [(e + 3, "R", at + 1, r, (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, letter, to, role, line in steps:
            if role is None:
                heapq.heappush(heap, (cost + c, audit + letter, to, last, lines))
            elif role[:1] in follows[last] and role[:1]:
                heapq.heappush(heap, (cost + c, audit + letter, to, role[:1], lines + line))


def check(spark, conversations_of):
    rows = [(c, t, role, text) for c, turns in conversations_of.items() for t, (role, text) in enumerate(turns)]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, SHAPE)).collect()}
    assert set(got) == set(conversations_of)
    for c, turns in conversations_of.items():
        faults, cost, audit, lines = by_hand(turns)
        r = got[c]
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")], turns
        assert (r.cost, r.audit, tuple(r.lines)) == (cost, audit, lines), turns
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:], strict=False)]
        assert (r.illegal, r.gaps) == (sum(p not in ("su", "ua", "au") for p in pairs), 0)


def drawn(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["One.", "Two", " ", "", "Three!\n", "so?", f"{rng.random()}."])) for _ in range(n)]


def test_random_conversations(spark):
    rng = random.Random(12)
    check(spark, {k: drawn(rng, rng.randint(1, 9)) for k in range(400)} | {1000 + k: drawn(rng, 60) for k in range(20)})


def test_runs_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN", 3)
    rng = random.Random(5)
    check(spark, {k: drawn(rng, rng.randint(1, 12)) for k in range(300)})


def test_a_long_conversation(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(30_000)]
    turns[777] = ("tool", "x.")
    r = conversations.repair(spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], SHAPE)).first()
    assert (r.cost, r.audit.count("K"), r.audit[777], len(r.lines)) == (3, 29_999, "R", 30_000)


def test_damage_and_odd_rows(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t, r, x in ((None, "user", "A."), (None, "user", "A."), (0, None, "B!"), (2, "assistant", None), (7, "user", "\U0001f600 ok. "))]
    df = spark.createDataFrame(rows, SHAPE)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x, kind != 0)] * (2 if kind == 3 else 1)
    got = conversations.damaged(df)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    found = {r.conv_id: r for r in conversations.repair(got).collect()}
    assert set(found) == {*range(40), None}
    for c, r in found.items():
        alive = sorted(((t, role, x) for cc, t, role, x, a in want if cc == c and a), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        faults, cost, audit, lines = by_hand([v[1:] for v in alive])
        turns = {v[0] for v in alive} - {None}
        assert (r.cost, r.audit, tuple(r.lines), r.blank) == (cost, audit, lines, faults.count("blank")), alive
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_tables_that_hold_little(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SHAPE))).collect() == []
    nothing = conversations.repair(conversations.damaged(spark.createDataFrame([(None, None, None, None)] * 3, SHAPE))).collect()
    assert [(r.conv_id, r.gaps, r.blank, r.audit, r.lines) for r in nothing] == [(None, 0, 3, "DDD", [])]
    clash = spark.createDataFrame([(1, 0, "user", "A.", "x", "y", 1, {"a": 1})], SHAPE + ", copy string, fault string, place int, `a.b` map<string,int>")
    assert [r.audit for r in conversations.repair(conversations.damaged(clash)).collect()] == ["KI"]
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = conversations.repair(conversations.damaged(spark.createDataFrame([(dropped, 0, "user", "A.")], SHAPE))).collect()
    assert [tuple(r) for r in gone] == [(dropped, 0, 0, 0, 0, 0, 0, "", [])]


def test_equal_rows_of_one_turn(spark):
    """The first of equal rows stays, however the windows order them."""
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(5):
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two.", "Three"]))] * rng.randint(1, 4)
    rng.shuffle(rows)
    for r in conversations.repair(spark.createDataFrame(rows, SHAPE)).collect():
        turns = [(role, text) for c, t, role, text in sorted(rows) if c == r.conv_id]
        faults, cost, audit, lines = by_hand(turns)
        assert (r.duplicate, r.cost, r.audit, tuple(r.lines)) == (faults.count("duplicate"), cost, audit, lines), turns


@pytest.mark.parametrize("text", ["a" * 300_000, "a." + " " * 300_000, "\n" * 300_000])
def test_very_long_texts(spark, text):
    r = conversations.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "A.")], SHAPE)).first()
    faults, cost, audit, lines = by_hand([("user", text), ("assistant", "A.")])
    assert (r.cost, r.audit, tuple(r.lines)) == (cost, audit, lines)
