"""Data sources: one file per row, aligned vectors, line numbers by split."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, formats


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_one_file_per_row(spark, tmp_path):
    rows = [(f"a{k % 3}/2024-0{k % 4}/t{k}/index.md", f"# {k} é") for k in range(40)] + [("top.md", "")]
    assert formats.write_files(spark.createDataFrame(rows, "p string, t string").repartition(5), "p", "t", str(tmp_path)) == 41
    assert tree(tmp_path) == dict(rows)
    assert formats.write_files(spark.createDataFrame([("a0/2024-00/t0/index.md", "new"), ("b/x.bin", "y")], "p string, t string"), "p", "t", f"file://{tmp_path}") == 2
    assert tree(tmp_path) == {**dict(rows), "a0/2024-00/t0/index.md": "new", "b/x.bin": "y"}
    back = files.read_articles(spark, str(tmp_path)).select("text").collect()
    assert sorted(r.text for r in back) == sorted([t for p, t in rows if p.endswith("index.md") and p != "a0/2024-00/t0/index.md"] + ["new"])
    assert formats.write_files(spark.createDataFrame([], "p string, t string"), "p", "t", str(tmp_path)) == 0


@pytest.mark.parametrize("paths", [["../x"], ["/x"], ["a//b"], ["a/./b"], [""], [None], ["a/"], ["x\ny"], ["a", "a"], ["a", "a/b"]])
def test_paths_that_no_file_can_have(spark, tmp_path, paths):
    with pytest.raises(ValueError):
        formats.write_files(spark.createDataFrame([(p, "t") for p in paths], "p string, t string"), "p", "t", str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "kept.md").write_text("old")
    rows = [(f"d{k}/f.md", "x") for k in range(20)] + [("kept.md/" + "n" * 300, "name too long")]
    with pytest.raises(Exception):  # noqa: B017  the task's own error comes wrapped
        formats.write_files(spark.createDataFrame(rows, "p string, t string").repartition(7), "p", "t", str(tmp_path))
    assert tree(tmp_path) == {"kept.md": "old"} and sorted(p.name for p in tmp_path.iterdir()) == ["kept.md"]


def vectors(spark, n, width, start=0):
    rng = np.random.default_rng(n)
    return [(start + k, rng.random(width, np.float32).tolist()) for k in range(n)]


def test_vectors_by_ranges(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "v.bin"), vectors(spark, 1000, 7)
    shape = "pos long, embedding array<float>"
    monkeypatch.setattr(formats, "SPLIT_BYTES", 3000)
    assert formats.write_vectors(spark.createDataFrame(rows, shape).orderBy(F.rand(1)), path) == 1000
    raw = (tmp_path / "v.bin").read_bytes()
    assert struct.unpack("<II", raw[:8]) == (1000, 7) and np.array_equal(np.frombuffer(raw[8:], "<f4").reshape(1000, 7), np.array([v for _, v in rows], np.float32))
    back = formats.read_vectors(spark, path, 999)
    assert back.rdd.getNumPartitions() == 29
    assert sorted((r.pos, r.embedding) for r in back.collect()) == rows
    assert back.filter("pos >= 998").count() == 2
    assert formats.write_vectors(spark.createDataFrame([], shape), path) == 0 and formats.read_vectors(spark, path).collect() == []
    for wrong in ([(0, [1.0]), (0, [1.0])], [(1, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(None, [1.0])]):
        with pytest.raises(ValueError):
            formats.write_vectors(spark.createDataFrame(wrong, shape), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v.bin"]
    (tmp_path / "v.bin").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="does not fit its header"):
        formats.read_vectors(spark, path).collect()


def test_appends_touch_new_rows_only(spark, tmp_path):
    lines, path = str(tmp_path / "rows"), str(tmp_path / "v.bin")
    formats.write_vectors(spark.createDataFrame(vectors(spark, 50, 3), "pos long, embedding array<float>"), path)
    spark.range(50).selectExpr("id AS pos", "'old' AS name").write.json(lines)
    before = {p.name: (p.stat().st_mtime_ns, p.stat().st_ino) for p in (tmp_path / "rows").glob("part-*")}
    old = (tmp_path / "v.bin").read_bytes()
    new = spark.createDataFrame([(f"n{k}", 100 - k, v) for k, v in vectors(spark, 30, 3)], "name string, at long, embedding array<float>")
    assert formats.append_pair(new, lines, path, "at") == 80
    assert {p.name: (p.stat().st_mtime_ns, p.stat().st_ino) for p in (tmp_path / "rows").glob("part-*") if p.name in before} == before
    assert (tmp_path / "v.bin").read_bytes()[8 : len(old)] == old[8:]
    both = files.aligned(spark.read.json(lines), formats.read_vectors(spark, path)).orderBy("pos").collect()
    want = {f"n{k}": v for k, v in vectors(spark, 30, 3)}
    assert len(both) == 80 and [r.name for r in both[50:]] == [f"n{k}" for k in reversed(range(30))] and all(want[r.name] == r.embedding for r in both[50:])
    held = ((tmp_path / "v.bin").read_bytes(), sorted(p.name for p in (tmp_path / "rows").glob("[!._]*")))
    with pytest.raises(ValueError):
        formats.append_pair(spark.createDataFrame([("x", 1, [1.0])], "name string, at long, embedding array<float>"), lines, path, "at")
    assert ((tmp_path / "v.bin").read_bytes(), sorted(p.name for p in (tmp_path / "rows").glob("[!._]*"))) == held


def test_line_numbers_of_files_of_several_splits(spark, tmp_path):
    lines = [json.dumps({"n": k, "t": "x" * (k % 50)}) if k % 11 else ("" if k % 2 else "[1]") for k in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:500]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = files.read_json_objects(spark, str(tmp_path), "n int")
        assert sorted(r.n for r in got.collect()) == sorted([k for k in range(3000) if k % 11] + [k for k in range(500) if k % 11])
        for file, line in (("a.jsonl", 2345), ("b.jsonl", 7), ("a.jsonl", 1)):
            broken = (tmp_path / file).read_text().split("\n")
            (tmp_path / file).write_text("\n".join([*broken[: line - 1], "{bad", *broken[line:]]))
            with pytest.raises(Exception, match=f"{file}:{line}: no JSON"):
                files.read_json_objects(spark, str(tmp_path), "n int").collect()
            (tmp_path / file).write_text("\n".join(broken))
        good, bad = files.read_json_lines_split(spark, str(tmp_path), "n int")
        assert good.count() + bad.count() > 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
