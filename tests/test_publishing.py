"""Golden cases of documents, staged commits, aligned tables, leases and run folders."""

import json
import zipfile
from datetime import UTC, datetime, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folioscope.operators import publishing
from folioscope.plans import control, leases
from folioscope.sources import files


def test_documents(spark):
    page = '<h2>Head</h2><p>one <img alt="a" src="//i.example/x.png"> two <img src="https://i.example/y.png"></p>'
    rows = [("p/a", 'T "q"', "A", "2024-01-01", "https://u", page), ("p/b", "T", "A", None, "https://v", "<p> 　</p>"), ("p/c", "T", "A", None, "https://w", None)]
    df = spark.createDataFrame(rows, "path string, title string, author string, date string, url string, page string")
    (cdn,) = publishing.documents(df).collect()
    assert cdn.path == "p/a" and cdn.text.startswith('---\ntitle: "T \\"q\\""\nauthor: "A"\ndate: "2024-01-01"\nurl: "https://u"\n---\n\n# T "q"\n\n## Head')
    assert "(https://i.example/x.png)" in cdn.text and "(https://i.example/y.png)" in cdn.text
    (indexed,) = publishing.documents(df, "indexed").collect()
    assert "](images/1)" in indexed.text and "](images/2)" in indexed.text and "i.example" not in indexed.text
    with pytest.raises(ValueError, match="images"):
        publishing.documents(df, "none")


def test_commit_is_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "table")
    one = spark.range(10).withColumn("v", F.rand())
    assert files.write_staged(one, target, after=lambda path: None) == 10
    held = sorted(map(tuple, spark.read.parquet(target).collect()))

    def broken(path):
        raise RuntimeError("index")

    with pytest.raises(RuntimeError, match="index"):
        files.write_staged(spark.range(3).withColumn("v", F.lit(0.5)), target, after=broken)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == held
    with pytest.raises(ValueError, match="rows"):
        files.write_staged(spark.range(3), target, least_rows=4)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == held
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_rows_and_vectors_stay_aligned(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"r{k}", [float(k), 0.5]) for k in range(20)], "pos long, name string, embedding array<float>")
    target = str(tmp_path / "t")
    assert files.rewrite_aligned(rows, F.col("pos") % 3 != 0, target) == 13
    kept = spark.read.parquet(target).orderBy("pos").collect()
    assert [r.pos for r in kept] == list(range(13)) and all(r.name == f"r{int(r.embedding[0])}" for r in kept)
    new = spark.createDataFrame([(5, "n5", [5.0, 1.0]), (2, "n2", [2.0, 1.0])], rows.schema)
    assert files.append_aligned(spark.read.parquet(target), new, str(tmp_path / "u")) == 15
    assert [(r.pos, r.name) for r in spark.read.parquet(str(tmp_path / "u")).orderBy("pos").collect()[-2:]] == [(13, "n2"), (14, "n5")]


def test_leases(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert leases.acquire(a, "me", 60, "w", now) == "acquired" and leases.acquire(a, "me", 60, "w", now) == "already-owned"
    assert leases.acquire(a, "you", 60, "w", now) == "busy" and not leases.renew(a, "you", 60, now) and not leases.release(a, "you")
    assert leases.renew(a, "me", 120, now) and leases.status(a, now + timedelta(seconds=100))[0] == "active"
    late = now + timedelta(seconds=120)
    assert not leases.renew(a, "me", 60, late) and leases.acquire(a, "you", 60, "w", late) == "reclaimed-stale"
    a.write_text("{")
    assert leases.status(a)[0] == "invalid" and leases.acquire(a, "me", 60, "w", now) == "reclaimed-stale"
    assert leases.acquire_all([b, a], "you", 60, "w", now) == "busy" and not b.exists()
    assert leases.acquire_all([a, b], "me", 60, "w", now) == "acquired" and leases.release(b, "me") and not b.exists()
    for bad in (lambda: leases.acquire_all([a, a], "me", 60, "w"), lambda: leases.acquire(a, " ", 60, "w"), lambda: leases.acquire(a, "me", 0, "w")):
        with pytest.raises(ValueError, match="lease"):
            bad()
    state = tmp_path / "state.json"
    state.write_text("{}")
    gate, before = dict.fromkeys(control.GATES, True), control.snapshot(state)
    assert leases.publish(state, {"x": 1}, gate, before, [a], "you", now) == ["gate:lease_valid"] and state.read_text() == "{}"
    assert leases.publish(state, {"x": 1}, gate, before, [a], "me", now) == [] and json.loads(state.read_text()) == {"x": 1}


def test_run_folders(tmp_path):
    now = datetime(2026, 1, 1, tzinfo=UTC)
    first = leases.reserve_run(tmp_path, "daily-1", "me", now)
    assert first.name == "20260101T000000Z-me" and leases.reserve_run(tmp_path, "daily-1", "me", now) == first
    (first / "run.json").write_text('{"owner_token": "you"}')
    other = leases.reserve_run(tmp_path, "daily-1", "me", now)
    assert other != first and other.name.startswith(first.name)
    with pytest.raises(ValueError, match="workflow"):
        leases.reserve_run(tmp_path, "Daily", "me", now)


def test_strict_json_lines(spark, tmp_path):
    file = tmp_path / "a.jsonl"
    file.write_text('{"a": 1}\n\n[2]\n{"a": 3}\n')
    assert [r.a for r in files.read_json_objects(spark, str(file), "a int").orderBy("a").collect()] == [1, 3]
    file.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="a.jsonl:2: no JSON"):
        files.read_json_objects(spark, str(file), "a int").collect()


def test_sheet(spark, tmp_path):
    target = tmp_path / "t.xlsx"
    df = spark.createDataFrame([(1, 2.5, "a <b> & \x01c\nd", True, None), (None, float("nan"), "漢" * 32_767, False, [1, 2])], "i long, x double, s string, b boolean, l array<int>")
    assert files.write_sheet(df, str(target), "Name & more") == 2
    with zipfile.ZipFile(target) as book:
        assert all(ElementTree.fromstring(book.read(n)) is not None for n in book.namelist())
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        rows = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).findall(".//m:row", ns)
    cells = [["".join(c.itertext()) for c in r] for r in rows]
    assert cells[0] == ["i", "x", "s", "b", "l"] and cells[1] == ["1", "2.5", "a <b> & c\nd", "1", ""]
    assert cells[2][1] == "nan" and len(cells[2][2]) == files.CELL_CHARS and cells[2][3:] == ["0", "[1, 2]"]
    before = target.read_bytes()
    with pytest.raises(ValueError, match="row 2: a cell holds 32767 characters, not 32768"):
        files.write_sheet(spark.createDataFrame([("a",), ("x" * 32_768,)], "s string").coalesce(1), str(target))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.xlsx"] and target.read_bytes() == before


def test_staged_tables_may_hold_maps_and_dots(spark, tmp_path):
    df = spark.createDataFrame([(1, {"k": 1}), (2, None)], "`a.b` int, m map<string,int>")
    assert files.write_staged(df, str(tmp_path / "t")) == 2


def test_images_within_pages(spark):
    pages = spark.createDataFrame([("u", '<img src="//i/1">', ["//i/1", "//i/2"])], "url string, html string, resources array<string>")
    stored = spark.createDataFrame([("//i/1", "image/png", b"abc")], "resource string, mime string, content binary")
    assert publishing.with_assets(pages, publishing.data_uris(stored)).first().html == '<img src="data:image/png;base64,YWJj">'


def test_pages_of_one_url_take_their_own_images(spark):
    rows = [("u", "'//i/1' '//i/2'", ["//i/1"]), ("u", "'//i/1' '//i/2'", ["//i/2"]), ("u", "'//i/2'", None), (None, "'//i/1'", ["//i/1"]), ("u", "'//i/2' '//i/9'", ["//i/9"])]
    pages = spark.createDataFrame(rows, "url string, html string, resources array<string>")
    assets = spark.createDataFrame([("//i/1", "a"), ("//i/2", "b")], "resource string, asset string")
    got = sorted(r.html for r in publishing.with_assets(pages, assets).collect())
    assert got == sorted(["'a' '//i/2'", "'//i/1' 'b'", "'//i/2'", "'a'", "'//i/2' '//i/9'"])


def test_lists_of_leading_blocks(spark):
    text = "---\na: [x, 'y z', \"q\"]\nb:\n  - one\n  - 'two: 2'\nc: single\nd: []\n---\nb:\n- no"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(*[publishing.list_field("t", k) for k in "abcde"]).first()[:] == (["x", "y z", "q"], ["one", "two: 2"], ["single"], [], [])
