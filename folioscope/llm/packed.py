"""An exchange of hashed keys between blocks of documents and buckets of keys.

Exploding every n-gram or line of a corpus to a row of its own costs a shuffle of one row per
token. Here a block, a run of documents that one task reads, sends each bucket one row: the sorted
distinct keys that the block holds in the bucket's range, and what it knows of each. A bucket sees
every block's claim to a key and answers each block in one row, aligned with the keys that the
block sent. A key that a third of all rows hold reaches its bucket once per block. Blocks and
buckets grow with the square root of the text, so that the rows sent, one for each block and
bucket, grow with the text and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import id_and_text, sliced_texts

#: Leading bits of a key within its bucket that are sent.
KEY_BITS = 48
#: Least characters of text of a block, and of all text for each bucket; and characters of all text for each row sent, at least.
BLOCK_CHARS, ROW_CHARS = 8 << 20, 1024

_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def pack_sorted(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
    """The leading KEY_BITS bits, within the bucket's range, of sorted keys: as differences, byte planes apart."""
    low = (bucket << 64) // buckets
    shift = max(0, (((bucket + 1) << 64) // buckets - low - 1).bit_length() - KEY_BITS)
    gaps = np.diff((keys - np.uint64(low)) >> np.uint64(shift), prepend=np.uint64(0))
    width = 4 if gaps.max() < (1 << 32) else 8
    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + squeeze(planes)


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = expand(blob[1:], np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_texts(ids: list, texts: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], schema=_TEXTS))
    return sink.getvalue().to_pybytes()


def unpack_texts(blob: bytes) -> tuple[list, list[str]]:
    table = pa.ipc.open_stream(blob).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def exchange(docs: DataFrame) -> tuple[int, int]:
    """(characters of a block, buckets). With b characters of each, T of text make (T / b)**2 rows, which are T / ROW_CHARS at most."""
    chars = int(id_and_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = max(BLOCK_CHARS, math.isqrt(chars * ROW_CHARS))
    return size, max(1, -(-chars // size))


def check_of(keys: np.ndarray) -> int:
    """A hash of sorted keys, as a signed long."""
    digest = xxhash.xxh64_intdigest(np.ascontiguousarray(keys))
    return digest - (digest >> 63 << 64)


def bounds(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket's range of sorted 64-bit keys begins and ends."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[str]]]:
    """(number, ids, texts) of each block; a task that runs again makes the same blocks of the same rows."""
    part = TaskContext.get().partitionId() << 32
    for k, (ids, texts) in enumerate(sliced_texts(batches, size)):
        yield part | k, ids, texts


def sent(docs: DataFrame, make: Callable[[int, list, list[str]], Iterator[dict]], schema: str, size: int) -> DataFrame:
    """Rows that make() gives for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, size):
            rows = list(make(block, ids, texts))
            for s in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[s : s + 64], schema=arrow)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return id_and_text(docs).mapInArrow(run, schema)


def texts_by_block(docs: DataFrame) -> DataFrame:
    """(block, blob): the same blocks with their packed texts."""
    size, _ = exchange(docs)
    return sent(docs, lambda block, ids, texts: iter([{"block": block, "blob": pack_texts(ids, texts)}]), "block long, blob binary", size)
