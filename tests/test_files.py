from __future__ import annotations

import csv
import io
import struct
import zlib

from pyspark.sql import functions as F

from gridloom.operators import catalog
from gridloom.sources import files
from gridloom.streaming.ingest import ingest_files


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(range(width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(12, 9))
    (tmp_path / "bad.png").write_bytes(b"no image")
    found = files.images(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, r.channels) for r in found] == [(12, 9, 1)]
    assert [r[:] for r in files.corrupt_images(spark, str(tmp_path)).collect()] == [("bad.png", "corrupt_image", "critical")]
    gray = files.gray_images(spark, str(tmp_path)).first()
    assert gray.pixels == list(range(12)) * 9 and gray.mean_colors == [5.5] and len(files.png_files(spark, str(tmp_path)).collect()) == 2


ODD = [["a", "$1,234.50", 'say "no"', ""], ["two\nlines", "and\r\ntwo", " ", "é"], ["", "", "", '"'], [",", '","', "x", "1"]]


def test_grids_go_out_and_come_back(spark, tmp_path):
    grids = {"odd": ODD, "one": [["h"], [""], ["x"]], "plain": [["a", "b"], ["1", ""], ["", "x"]]}
    df = spark.createDataFrame(list(grids.items()), "name string, cells array<array<string>>")
    for _ in range(2):  # the second time in place of the first
        assert files.write_grids(df, str(tmp_path / "out")) == 3
        assert {r.name: r.cells for r in files.read_grids(spark, str(tmp_path / "out")).collect()} == grids
    for r in files.table_files(df).collect():
        assert list(csv.reader(io.StringIO(r.content, newline=""))) == grids[r.name]
    assert files.write_grids(df.limit(0), str(tmp_path / "none")) == 0


def test_files_are_exported_one_by_one(spark, tmp_path):
    df = spark.createDataFrame([("t1", ODD), ("t2", [["a"], ["b"]])], "name string, cells array<array<string>>")
    files.export_files(files.table_files(df), str(tmp_path / "out"))
    for name, cells in (("t1", ODD), ("t2", [["a"], ["b"]])):
        assert files.delimited_grids(spark, str(tmp_path / "out" / f"name={name}")).first().cells == cells


def test_documents_and_summary(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"doc_id":1,"tables":[]}'), (2, '{"doc_id":2,"tables":[]}')], "doc_id long, document string")
    files.write_documents(docs, str(tmp_path / "d"))
    assert sorted(r.doc_id for r in spark.read.json(str(tmp_path / "d")).collect()) == [1, 2]
    (tmp_path / "m.json").write_text('{"images": [{"page": 1}],\n "n": 2}')
    assert files.metadata_json(spark, str(tmp_path / "m.json")).first().n == 2
    files.write_summary(spark.createDataFrame([('a "b", c', 1)], "name string, n int"), str(tmp_path / "s"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "s")).first()[:] == ('a "b", c', "1")
    files.write_summary(docs.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()


def test_faults(spark):
    cases = {"": ["empty_file"], "\n\r\n": ["pandas_empty_data"], "a,b\n1,2,3\n": ["read_error"], 'a,b\n"1,2\n': ["read_error"], "a,b\n": ["no_data", "single_line_file"], "a,b\r\n1,2\r\n": ["mixed_line_endings"], '"a\n",b\n1,"2,3"\n': []}
    rows = [(i, f"f{i}", c, True) for i, c in enumerate(cases)] + [(90, "f90", None, True), (91, "f91", "", False)]
    df = spark.createDataFrame(rows, "doc_id long, name string, content string, on_disk boolean")
    found = {}
    for r in catalog.verify_files(df).collect():
        found.setdefault(r.doc_id, []).append(r.issue)
    assert found == {**{i: want for i, want in enumerate(cases.values()) if want}, 90: ["read_error"]}
    first = catalog.first_critical(catalog.verification(df)).collect()
    assert [(r.name, r.issue) for r in first] == [("f0", "empty_file"), ("f1", "pandas_empty_data"), ("f2", "read_error"), ("f3", "read_error")]


def test_new_files_are_ingested_once(spark, tmp_path):
    for d in ("in", "out"):
        (tmp_path / d).mkdir()

    def run():
        ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length"), "*.csv").awaitTermination(60)
        return sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect())

    (tmp_path / "in" / "a.csv").write_text("1")
    assert run() == ["a.csv"]
    (tmp_path / "in" / "b.csv").write_text("22")
    assert run() == ["a.csv", "b.csv"]
