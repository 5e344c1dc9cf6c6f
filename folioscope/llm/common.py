"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from folioscope.session import cut_lineage  # noqa: F401  the operators take it from here


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns under fixed names, whatever else docs holds; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def sliced_texts(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in runs of about most_chars characters, in the order read; a longer text stands alone.

    Keeps what a worker holds at once bounded by the run and the longest single text.
    """
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # a batch's texts are never all strings at once
            part = batch.slice(start, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if texts and (size + len(t) > most_chars or len(texts) >= 100_000):
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
    if texts:
        yield ids, texts


def ship(df: DataFrame, path: str) -> str:
    """Send a vocabulary file to the executors; the name under which they find it."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def shipped(name: str) -> str:
    return SparkFiles.get(name)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def joined_words(text: str) -> tuple[bytes, np.ndarray]:
    """A text's words in ASCII lower case, each joined to the next by one space, and where those spaces are.

    Words are what stands between ASCII white space; their edges are found on the bytes, so that no
    list of words is held.
    """
    raw = np.frombuffer(text.encode("utf-8").lower(), np.uint8)
    white = _WHITE[raw]
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    keep = ~white
    keep[ends] = True  # one white byte behind each word
    joined = np.where(white, np.uint8(32), raw)[keep]
    if len(joined) and white[-1] and joined[-1] == 32:
        joined = joined[:-1]
    return joined.tobytes(), np.flatnonzero(joined == 32)


def shingle_bounds(joined: bytes, spaces: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the shingles of so many words start and end in joined words; fewer words are one, none give none."""
    n = len(spaces) + 1 if joined else 0
    if n <= words:
        return np.zeros(min(n, 1), np.int64), np.full(min(n, 1), len(joined), np.int64)
    return np.r_[0, spaces + 1][: n - words + 1], np.r_[spaces, len(joined)][words - 1 :]
