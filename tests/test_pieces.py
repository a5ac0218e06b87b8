"""Long files are read in parts."""

from __future__ import annotations

from vecfold.catalog import QUERIES
from vecfold.catalog import ingest as I
from vecfold.sources.files import read_content


def test_files_come_in_parts(spark, tmp_path):
    files = {"empty": b"", "short": b"abc", "even": b"01234567", "long": bytes(range(250))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    keys = spark.createDataFrame([(n, f"file:{tmp_path}/{n}") for n in [*files, "gone"]], "filename string, path string")
    rows = read_content(keys, 4).collect()
    assert max(len(r.content) for r in rows) == 4
    for name, data in files.items():
        parts = sorted((r.part, bytes(r.content)) for r in rows if r.filename == name)
        assert [p for p, _ in parts] == list(range(max(1, -(-len(data) // 4))))
        assert b"".join(d for _, d in parts) == data
    assert {r.filename: bytes(r.content) for r in read_content(keys).collect()} == files


def test_table_files_are_read_whole_in_parts(spark, tmp_path, monkeypatch):
    asked = []
    kept = I.read_content
    monkeypatch.setattr(I, "read_content", lambda keys, piece: asked.append(piece) or kept(keys, piece))
    monkeypatch.setattr(I, "PIECE_BYTES", 1 << 10)
    (tmp_path / "a.parquet").write_bytes(b"x" * 5000)
    (tmp_path / "b.parquet").write_bytes(b"y" * 1024)
    found = {tuple(r) for r in QUERIES["read_table_files"](spark, str(tmp_path)).collect()}
    assert found == {("a.parquet", True), ("b.parquet", True)} and asked == [1 << 10]
