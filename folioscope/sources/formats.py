"""Data sources of the package: one file per row, and the aligned file of vectors, read and written by ranges."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folioscope.session import cut_lineage

#: The header of a file of vectors: how many and how wide, two little-endian unsigned 32-bit integers (fixed value).
HEADER, HEADER_BYTES = "<II", 8
#: Bytes of vectors that one task reads.
SPLIT_BYTES = 64 << 20
#: Threads that move files into place.
MOVERS = 32


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path within it: local or mounted, or of a scheme that Arrow opens (hdfs, s3, gs)."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), os.path.abspath(path))


# one file per row


@dataclass
class _Folder(WriterCommitMessage):
    name: str
    files: int


class _FileWriter(DataSourceArrowWriter):
    """Each task writes below a folder of its own attempt; only folders of tasks that count are moved into the target."""

    def __init__(self, root: str):
        self.root, self.stage = root, f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Folder:
        files, root = _opened(self.root)
        context = TaskContext.get()
        own, n = f"{context.partitionId()}-{context.taskAttemptId()}", 0
        known = set()
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                target = f"{root}/{self.stage}/{own}/{path.as_py()}"
                folder = target.rsplit("/", 1)[0]
                if folder not in known:
                    files.create_dir(folder, recursive=True)
                    known.add(folder)
                value = content.as_py()
                with files.open_output_stream(target) as out:
                    out.write(value.encode() if isinstance(value, str) else value)
                n += 1
        return _Folder(own, n)

    def commit(self, messages: list[_Folder | None]) -> None:
        files, root = _opened(self.root)
        stage = f"{root}/{self.stage}"
        try:
            with ThreadPoolExecutor(MOVERS) as pool:
                for m in messages:
                    if m is not None and m.files:
                        list(pool.map(lambda pair: files.move(*pair), self._moves(files, f"{stage}/{m.name}", root)))
        finally:
            self._drop(files, stage)

    def _moves(self, files: arrow_fs.FileSystem, source: str, target: str) -> list[tuple[str, str]]:
        """What is renamed: a folder that is new as a whole, else what is in it."""
        out = []
        for info in files.get_file_info(arrow_fs.FileSelector(source)):
            to = f"{target}/{info.base_name}"
            there = files.get_file_info(to).type
            if info.type == arrow_fs.FileType.Directory and there == arrow_fs.FileType.Directory:
                out += self._moves(files, info.path, to)
            elif info.type == arrow_fs.FileType.Directory and there == arrow_fs.FileType.NotFound:
                files.move(info.path, to)  # at once, as the next task's folder may hold files of it too
            else:
                out.append((info.path, to))
        return out

    def _drop(self, files: arrow_fs.FileSystem, stage: str) -> None:
        if files.get_file_info(stage).type == arrow_fs.FileType.Directory:
            files.delete_dir(stage)

    def abort(self, messages: list[_Folder | None]) -> None:
        files, root = _opened(self.root)
        self._drop(files, f"{root}/{self.stage}")


class FilesSource(DataSource):
    """Writes the rows (path, content) as files of those paths below a folder."""

    @classmethod
    def name(cls) -> str:
        return "one_file_per_row"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def write_files(df: DataFrame, path_col: str, content_col: str, root: str) -> int:
    """Each row's text or bytes as the file of its path below root; the number of files.

    Paths are relative, name no parent, and are told apart: a path that is none, that two rows have,
    or that is the folder of another is an error that names one, before anything is written; so is a null content. All
    files are written to a hidden folder and renamed into place when every task has ended: a failed
    write leaves nothing. Files that stood at those paths are replaced, others stay.
    """
    path = F.col(f"`{path_col}`")
    rows = cut_lineage(df.select(path.alias("path"), F.col(f"`{content_col}`").cast("binary").alias("content")))
    bad = rows.filter(F.col("path").isNull() | (F.col("path") == "") | F.col("path").rlike(r"(^|/)(\.{0,2})(/|$)") | F.col("path").rlike(r"[\x00-\x1f]") | F.col("content").isNull()).select("path").first()
    if bad:
        raise ValueError(f"no file can be written at {bad.path!r}")
    twice = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path").first()
    if twice:
        raise ValueError(f"several rows have the path {twice.path!r}")
    parts = F.split("path", "/")
    folders = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder"), F.col("path").alias("whole")).filter("folder <> whole").select("folder").distinct()
    both = rows.join(folders, F.col("path") == F.col("folder"), "left_semi").select("path").first()
    if both:
        raise ValueError(f"{both.path!r} is a file and a folder")
    df.sparkSession.dataSource.register(FilesSource)
    rows.write.format("one_file_per_row").mode("append").option("path", root).save()
    return rows.count()


# aligned vectors


def _header(files: arrow_fs.FileSystem, path: str) -> tuple[int, int]:
    size = files.get_file_info(path).size
    with files.open_input_file(path) as f:
        raw = f.read(HEADER_BYTES)
    n, width = struct.unpack(HEADER, raw) if len(raw) == HEADER_BYTES else (0, 0)
    if size != HEADER_BYTES + 4 * n * width:
        raise ValueError("the file's size does not fit its header")
    return n, width


@dataclass
class _Rows(InputPartition):
    start: int
    end: int
    width: int


class _VectorReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[_Rows]:
        n, width = _header(*_opened(self.path))
        step = max(1, self.split_bytes // max(1, 4 * width))
        return [_Rows(s, min(n, s + step), width) for s in range(0, n, step)] or [_Rows(0, 0, width)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        files, path = _opened(self.path)
        with files.open_input_file(path) as f:
            for s in range(partition.start, partition.end, 4096):
                e = min(partition.end, s + 4096)
                raw = f.read_at(4 * partition.width * (e - s), HEADER_BYTES + 4 * partition.width * s)
                flat = np.frombuffer(raw, "<f4")
                if len(flat) != partition.width * (e - s):
                    raise ValueError("the file became shorter while it was read")
                ends = np.arange(e - s + 1, dtype=np.int32) * partition.width
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, e)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["pos", "embedding"])


@dataclass
class _Wrote(WriterCommitMessage):
    rows: int


class _VectorWriter(DataSourceArrowWriter):
    """Tasks write their rows at their places of one file; its header is written when all have ended."""

    def __init__(self, path: str, count: int, width: int, start: int):
        self.path, self.count, self.width, self.start = path, count, width, start

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        fd, n = os.open(self.path, os.O_WRONLY), 0
        try:
            for batch in iterator:
                pos, held = batch.column("pos").to_numpy(zero_copy_only=False), batch.column("embedding")
                flat = np.asarray(held.flatten().to_numpy(zero_copy_only=False), "<f4")
                if held.null_count or len(flat) != len(pos) * self.width or not (np.diff(held.offsets.to_numpy()) == self.width).all():
                    raise ValueError(f"not all vectors have {self.width} components")
                if len(pos) and (pos.min() < self.start or pos.max() >= self.count):
                    raise ValueError("a position is out of range")
                rows = flat.reshape(len(pos), self.width)
                cuts = np.flatnonzero(np.diff(pos) != 1) + 1
                for run in np.split(np.arange(len(pos)), cuts):
                    if len(run):
                        os.pwrite(fd, np.ascontiguousarray(rows[run]).tobytes(), HEADER_BYTES + 4 * self.width * int(pos[run[0]]))
                n += len(pos)
            os.fsync(fd)
        finally:
            os.close(fd)
        return _Wrote(n)

    def commit(self, messages: list[_Wrote | None]) -> None:
        if sum(m.rows for m in messages if m is not None) != self.count - self.start:
            self.abort(messages)
            raise ValueError("not every position was written once")
        fd = os.open(self.path, os.O_WRONLY)
        try:
            os.pwrite(fd, struct.pack(HEADER, self.count, self.width), 0)
            os.fsync(fd)
        finally:
            os.close(fd)

    def abort(self, messages: list[_Wrote | None]) -> None:
        """What was written goes: all of a new file, the rows behind the old ones of one that was appended to."""
        if self.start:
            os.truncate(self.path, HEADER_BYTES + 4 * self.width * self.start)
        elif os.path.exists(self.path):
            os.remove(self.path)


class VectorsSource(DataSource):
    """(pos, embedding) of a file with a header and rows of little-endian floats; option split_bytes: what one task reads."""

    @classmethod
    def name(cls) -> str:
        return "aligned_vectors"

    def schema(self) -> str:
        return "pos long, embedding array<float>"

    def reader(self, schema) -> _VectorReader:
        return _VectorReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> _VectorWriter:
        o = self.options
        return _VectorWriter(o["path"], int(o["count"]), int(o["width"]), int(o["start"]))


def read_vectors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(pos, embedding) of a file of vectors, one task for each range of split_bytes; a size that does not fit the header is an error."""
    spark.dataSource.register(VectorsSource)
    return spark.read.format("aligned_vectors").option("split_bytes", split_bytes).load(path)


def _local(path: str) -> str:
    files, inner = _opened(path)
    if not isinstance(files, arrow_fs.LocalFileSystem):
        raise ValueError(f"{path}: rows can be written at their places on mounted file systems only")
    return inner


def _write_rows(vectors: DataFrame, path: str, start: int, width: int | None) -> int:
    """Rows (pos, embedding) with positions from start on, written at their places; the new count."""
    rows = cut_lineage(vectors.select(F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<float>").alias("embedding")))
    n, low, high, narrow, wide = rows.agg(F.count("pos"), F.min("pos"), F.max("pos"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    width = width or wide or 0
    if n != rows.count() or (n and (low != start or high != start + n - 1)) or rows.groupBy("pos").agg(F.count("*").alias("n")).filter("n > 1").first():
        raise ValueError(f"positions are not {start}, {start + 1} and so on")
    if n and (narrow != width or wide != width or not rows.filter("embedding IS NULL").isEmpty()):
        raise ValueError(f"not all vectors have {width} components")
    if not start:
        with open(path, "wb") as f:
            f.truncate(HEADER_BYTES + 4 * width * n)
    rows.sparkSession.dataSource.register(VectorsSource)
    ranged = rows.repartitionByRange(max(1, -(-4 * width * n // SPLIT_BYTES)), "pos").sortWithinPartitions("pos")
    ranged.write.format("aligned_vectors").mode("append").options(path=path, count=start + n, width=width, start=start).save()
    return start + n


def write_vectors(vectors: DataFrame, path: str) -> int:
    """Rows (pos, embedding), positions 0, 1 and so on, as one file of vectors, put in place when it is whole; their number."""
    target = _local(path)
    fresh = f"{target}.staged-{uuid.uuid4().hex}"
    try:
        n = _write_rows(vectors, fresh, 0, None)
        os.replace(fresh, target)
        return n
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)


def append_pair(rows: DataFrame, lines: str, vectors: str, order: str) -> int:
    """New rows, with a column embedding, behind those of a folder of JSON lines and its file of vectors; the new count.

    The new rows are numbered on in the order of a column. What is stored is neither read nor
    rewritten: lines are added as files of their own, vectors behind the old ones, and the header
    counts them last. If the lines cannot be put in place, the vectors are cut back.
    """
    from folioscope.sources.files import renumber

    spark, target = rows.sparkSession, _local(vectors)
    files, inner = _opened(target)
    start, width = _header(files, inner)
    numbered = cut_lineage(renumber(rows.withColumnRenamed(order, "__order"), "__order").withColumn("pos", F.col("pos") + start))
    path = spark._jvm.org.apache.hadoop.fs.Path
    stage = f"{lines}/_staged-{uuid.uuid4().hex}"
    fs = path(lines).getFileSystem(spark._jsc.hadoopConfiguration())
    moved: list[str] = []
    try:
        own = numbered.drop("embedding", "__order") if order == "pos" else numbered.withColumnRenamed("__order", order).drop("embedding")
        own.repartitionByRange("pos").sortWithinPartitions("pos").write.json(stage)
        count = _write_rows(numbered.select("pos", "embedding"), target, start, width if start else None)
        for k, f in enumerate(fs.globStatus(path(f"{stage}/part-*"))):
            to = f"{lines}/part-{start:012d}-{k:05d}.json"
            if not fs.rename(f.getPath(), path(to)):
                raise OSError(f"{to} cannot be put in place")
            moved.append(to)
        return count
    except BaseException:
        for to in moved:
            fs.delete(path(to), False)
        os.truncate(target, HEADER_BYTES + 4 * width * start)
        with open(target, "r+b") as f:
            f.write(struct.pack(HEADER, start, width))
        raise
    finally:
        fs.delete(path(stage), True)
