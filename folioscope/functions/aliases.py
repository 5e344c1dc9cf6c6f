"""Words of any number looked for in one pass over a text: an Aho-Corasick automaton in each worker."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions.text import _c

#: Characters of all words that are sent to every worker; more are an error.
MOST_CHARS = 32 << 20


def shared_words(spark: SparkSession, words: list[tuple[str, str]], ignore_case: bool = True, most: int = MOST_CHARS) -> Broadcast:
    """(word, name) pairs for the functions below, in the order of their rank; of a word that comes twice the first counts.

    The words are broadcast, so their size is checked first. A worker builds its automaton once and
    keeps it with the broadcast value.
    """
    size = sum(len(w) for w, _ in words)
    if size > most:
        raise ValueError(f"{size} characters of words, {most} at most")
    first: dict[str, tuple[int, str]] = {}
    for rank, (word, name) in enumerate(words):
        first.setdefault(word.lower() if ignore_case else word, (rank, name))
    first.pop("", None)
    return spark.sparkContext.broadcast({"words": first, "ignore_case": ignore_case})


def _automaton(shared: Broadcast):
    held = shared.value
    if "automaton" not in held:
        built = ahocorasick.Automaton()
        for word, found in held["words"].items():
            built.add_word(word, found)
        if held["words"]:
            built.make_automaton()
        held["automaton"] = built
    return held["automaton"] if held["words"] else None


def _over(x: Column | str, shared: Broadcast, of, kind: str) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared)
        for s in texts:
            yield pd.Series([of(automaton.iter(t) if automaton is not None else ()) if t is not None else None for t in s], dtype=object)

    held = F.lower(_c(x)) if shared.value["ignore_case"] else _c(x)
    return F.pandas_udf(run, kind)(held)


def first_name(x: Column | str, shared: Broadcast) -> Column:
    """The name of the word of least rank that a text holds, else null; equal to a chain of conditions in the order of the words."""

    def of(hits) -> str | None:
        best = None
        for _, found in hits:
            if best is None or found < best:
                best = found
                if not best[0]:
                    break
        return best and best[1]

    return _over(x, shared, of, "string")


def all_names(x: Column | str, shared: Broadcast) -> Column:
    """The distinct names of all words that a text holds, in the order of their rank; null for a null text."""

    def of(hits) -> list[str]:
        return list(dict.fromkeys(name for _, name in sorted({found for _, found in hits})))

    return _over(x, shared, of, "array<string>")


def words_of(rows: DataFrame, word: str, name: str, rank: str, ignore_case: bool = True, most: int = MOST_CHARS) -> Broadcast:
    """shared_words of a table's rows in the order of a column; the size is added up before a row is fetched."""
    kept = rows.filter(F.col(word).isNotNull()).select(F.col(word).alias("w"), F.col(name).cast("string").alias("n"), F.col(rank).alias("r"))
    size = kept.agg(F.coalesce(F.sum(F.char_length("w")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{size} characters of words, {most} at most")
    return shared_words(rows.sparkSession, [(r.w, r.n) for r in kept.orderBy("r", "w", "n").collect()], ignore_case, most)
