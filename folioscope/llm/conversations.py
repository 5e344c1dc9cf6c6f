"""Repair of conversation structure: the cheapest edits that make turns alternate, found by a fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: ASCII white space, as in [\x20\x09-\x0D] (fixed values).
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits and of a truncated turn that stays (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What stands in for a state that is not reached; no sum of costs comes near it.
UNREACHED = 1 << 60
#: Turns that are folded one after the other; a longer conversation is folded in runs of so many, and the runs are joined.
RUN = 512
#: The states of the fold: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: the rows with seeded damage, by crc32 of `conv_id:turn` modulo 20.

    0 drops the row (alive is false), 1 empties its text, 2 takes its marks of sentence ends, 3
    repeats it, 4 makes it a user's. A null role or text, and a null in the key, is one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("`conv_id`").cast("string"), space), F.lit(":"), F.coalesce(F.col("`turn`").cast("string"), space))
    kind = F.crc32(key) % 20
    role, text = F.coalesce(F.col("`role`").cast("string"), space), F.coalesce(F.col("`text`").cast("string"), space)
    own = rows.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Each row with its place, its first fault, whether its turn is new, and whether it may not follow the row before.

    All windows are within a conversation, so that one exchange by conv_id serves them and the
    collection after them. Rows of one turn stand in the order of role and text.
    """
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    line = W.partitionBy("conv_id", "alive").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = W.partitionBy("conv_id", "alive", "role", "text")
    placed = rows.repartition("conv_id").withColumn("place", F.row_number().over(line))
    # rows that are equal in all stand in any order, so the first of them is told by its place
    seen = placed.withColumn("seen", F.col("place") > F.min("place").over(same))
    fault = F.when(text == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    placed_line = W.partitionBy("conv_id", "alive").orderBy("place")
    pair = F.concat(F.lag(initial).over(placed_line), initial)
    return seen.select(
        "*",
        fault.alias("fault"),
        initial.alias("initial"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(placed_line))).alias("new_turn"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, letter: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], letter if isinstance(letter, Column) else F.lit(letter)))


def _never() -> Column:
    return _state(F.lit(UNREACHED), F.lit(""))


def _four(states: list[Column]) -> Column:
    return F.struct(*[s.alias(f"s{k}") for k, s in enumerate(states)])


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often of names it."""
    return F.transform(F.array(value), of)[0]


def _inserted(held: Column) -> Column:
    """The four states after inserts: at most a user's turn and an assistant's, as more only cost. What is not reached carries no audit."""
    start, system, user, assistant = (F.when(held[f"s{k}"]["cost"] >= UNREACHED, _never()).otherwise(held[f"s{k}"]) for k in range(4))
    user = F.least(user, *[_then(held[f"s{k}"], INSERT, "I") for k in (START, SYSTEM, ASSISTANT)])
    return _bound(user, lambda u: _four([start, system, F.when(u["cost"] >= UNREACHED, _never()).otherwise(u), F.least(assistant, _then(u, INSERT, "I"))]))


def _moves(turn: Column) -> Column:
    """What it costs a turn to be the system's, a user's, an assistant's, and the letter of that edit; keeping it is cheaper than giving it the role it has."""
    extra = F.when(F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False)), UNREACHED).when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    own = turn["initial"]
    return F.struct(
        (extra + F.when(own == "s", 0).otherwise(UNREACHED)).alias("s_cost"),
        (extra + F.when(own == "u", 0).otherwise(REROLE)).alias("u_cost"),
        F.when(own == "u", "K").otherwise("R").alias("u_edit"),
        (extra + F.when(own == "a", 0).otherwise(REROLE)).alias("a_cost"),
        F.when(own == "a", "K").otherwise("R").alias("a_edit"),
    )


def _after_turn(held: Column, move: Column) -> Column:
    """The four states after one turn is kept, given another role or deleted, and turns are inserted behind it."""
    start, system, user, assistant = (held[f"s{k}"] for k in range(4))
    moved = _four(
        [
            _then(start, DELETE, "D"),
            F.least(_then(system, DELETE, "D"), _then(start, move["s_cost"], "K")),
            F.least(_then(user, DELETE, "D"), *[_then(s, move["u_cost"], move["u_edit"]) for s in (start, system, assistant)]),
            F.least(_then(assistant, DELETE, "D"), _then(user, move["a_cost"], move["a_edit"])),
        ]
    )
    return _bound(moved, _inserted)


def _fold(turns: Column, begin: Column) -> Column:
    return F.aggregate(turns, begin, _after_turn)


def _only(state: int) -> Column:
    return _four([_state(F.lit(0), F.lit("")) if k == state else _never() for k in range(4)])


def edits(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns' `_moves`; ties to the ASCII-least audit.

    The fold carries, for each state, the cheapest way to it. Two ways of one cost to one state are
    never the beginning of one another, so the lesser stays the lesser whatever follows. More than
    RUN turns are folded in runs from each of the four states, and the runs' ways are put together:
    audits then grow by runs, not by turns.
    """
    begin = _inserted(_only(START))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / RUN).cast("int")), lambda k: F.slice(turns, k * RUN + 1, RUN))
    ways = F.transform(runs, lambda run: F.transform(F.array(*[_only(s) for s in range(4)]), lambda from_state: _fold(run, from_state)))

    def join(held: Column, way: Column) -> Column:
        def to(k: int) -> Column:
            return F.least(*[_state(held[f"s{s}"]["cost"] + way[s][f"s{k}"]["cost"], F.concat(held[f"s{s}"]["audit"], way[s][f"s{k}"]["audit"])) for s in range(4)])

        return _bound(_four([to(k) for k in range(4)]), lambda f: _four([F.when(f[f"s{k}"]["cost"] >= UNREACHED, _never()).otherwise(f[f"s{k}"]) for k in range(4)]))

    last = F.when(F.size(turns) <= RUN, _fold(turns, begin)).otherwise(F.aggregate(ways, begin, join))
    return _bound(last, lambda s: F.least(s["s0"], s["s3"]))


def repaired_lines(turns: Column, audit: Column) -> Column:
    """`role:text` of the turns after the edits of audit, one letter an edit.

    What stays alternates behind the system turn, so a turn inserted or given another role gets the
    role of its place.
    """
    of_turn = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    none = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))

    def made(turn: Column, letters: Column) -> Column:
        edit = F.substring(letters, -1, 1)
        own = F.filter(F.array(F.struct(edit.alias("edit"), turn["role"].alias("role"), F.when(edit == "D", "").otherwise(turn["text"]).alias("text"))), lambda x: x["edit"] != "D")
        return F.concat(F.array_repeat(none, F.length(letters) - 1), own)

    behind = F.array_repeat(none, F.length(F.regexp_extract(audit, "I*$", 0)))
    lines = F.concat(F.flatten(F.zip_with(turns, of_turn, made)), behind)

    def written(all_lines: Column) -> Column:
        first = F.get(all_lines, F.lit(0))
        offset = F.when((first["edit"] == "K") & (F.substring(first["role"], 1, 1) == "s"), 1).otherwise(0)
        return F.transform(all_lines, lambda x, k: F.concat(F.when(x["edit"] == "K", x["role"]).when((k - offset) % 2 == 0, "user").otherwise("assistant"), F.lit(":"), x["text"]))

    return _bound(lines, written)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of conv_id, turn, role, text: its faults, the cheapest edits and the repaired lines.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, lines (array of
    `role:text`). rows may be `damaged` ones: those with alive false count for nothing, but their
    conversation is returned. Null ids are one conversation. A role counts by its first character.
    Rows of one turn stand in the order of role and text; null turns come first and leave no gap. A
    conversation is one row of the result, and its turns meet in one task: that bound is the
    result's own, as its lines are one value.
    """
    own = rows if "alive" in rows.columns else rows.withColumn("alive", F.lit(True))
    turn = F.when(F.col("alive"), F.struct("place", "initial", "fault", "role", "text"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("alive") & c, 1)), F.lit(0)).cast("long")
    turns_at = F.when(F.col("alive"), F.col("turn"))
    gaps = F.coalesce(F.max(turns_at) - F.min(turns_at) + 1, F.lit(0)) - count(F.col("new_turn"))
    found = flagged(own).groupBy("conv_id").agg(
        gaps.alias("gaps"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    # the edits are found once and then used for the lines too
    best = _bound(edits(F.transform("turns", _moves)), lambda b: F.struct(b["cost"].alias("cost"), b["audit"].alias("audit"), repaired_lines(F.col("turns"), b["audit"]).alias("lines")))
    return found.withColumn("best", best).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.lines")
