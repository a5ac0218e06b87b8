import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vecfold.functions.embedders import CharFold, LoopbackService
from vecfold.functions.names import is_image, table_name, table_name_of
from vecfold.functions.payloads import reply_vectors
from vecfold.functions.vectors import pack_f32, pool, unpack_f32
from vecfold.operators.embed import Remote, call_with_retry, embed, embed_remote, guard_input
from vecfold.operators.ingest import ingest, ingest_files
from vecfold.sources import store
from vecfold.sources.files import scan_files
from vecfold.streaming.ingest import ingest_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FILES = ["a.jpg", "b.JPG", "c.tif", "d.webp", "e.txt", "noext", "name with space.png"]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "sub").mkdir(parents=True)
    (root / "k=v").mkdir()
    for name in [*FILES, ".h.png", "_u.png", "sub/f.jpg", "k=v/g.jpg"]:
        (root / name).write_bytes(f"bytes of {name}".encode())
    return str(root)


def test_scan_lists_direct_files_only(spark, folder):
    assert {r["filename"] for r in scan_files(spark, folder).select("filename").collect()} == set(FILES)
    images = scan_files(spark, folder, images_only=True).select("filename").collect()
    assert {r[0] for r in images} == {"a.jpg", "b.JPG", "d.webp", "name with space.png"}
    assert [r[0] for r in scan_files(spark, f"{folder}/e.txt").select("filename").collect()] == ["e.txt"]
    with pytest.raises(FileNotFoundError):
        scan_files(spark, folder + "/missing")


def test_listing_does_not_read_content(spark, folder):
    plan = scan_files(spark, folder).select("filename", "path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_ingest_files_is_incremental(spark, folder):
    table = "images_incremental"
    ingest_files(spark, folder, table, CharFold(), "openclip", "m", slices=2)
    assert spark.table(table).count() == 4
    with open(f"{folder}/new.gif", "wb") as f:
        f.write(b"fresh")
    ingest_files(spark, folder, table, CharFold(), "openclip", "m")
    assert spark.table(table).count() == 5
    stored = {r["filename"]: r["embedding"] for r in spark.table(table).collect()}
    want = CharFold().embed_batch([b"fresh"])[0].astype("f4")
    assert np.allclose(stored["new.gif"], want)


def test_ingest_stops_between_slices_and_resumes(spark):
    rows = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(40)], "filename string, content string")
    calls = iter([False, True])
    ingest(rows, "stopping", CharFold(), "ollama", "m", order="content", slices=4, stopped=lambda: next(calls))
    some = spark.table("stopping").count()
    assert 0 < some < 40
    ingest(rows, "stopping", CharFold(), "ollama", "m", order="content", slices=4)
    assert spark.table("stopping").count() == 40
    assert spark.table("stopping").select("filename").distinct().count() == 40


def test_ingest_refuses_vectors_of_another_size(spark):
    rows = spark.createDataFrame([("a", "text")], "filename string, content string")
    for number, embedder in enumerate([Remote(LoopbackService("content", CharFold(5)), 7), Remote(LoopbackService("model", CharFold(5)), 5, "model")]):
        table = f"remote_{number}"
        if embedder.dim == 5:
            ingest(rows, table, embedder, "remote", "m", order="content")
            assert [len(r["embedding"]) for r in spark.table(table).collect()] == [5]
        else:
            with pytest.raises(Exception, match="vector size mismatch: expected 7, got 5"):
                ingest(rows, table, embedder, "remote", "m", order="content")
            assert spark.table(table).count() == 0


def test_hot_key_keeps_first_row(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("filename"), F.col("id").alias("n"))
    first = store.first_per_key(rows.unionByName(rows.limit(1).withColumn("filename", F.lit("cold"))), "filename", "n")
    assert {(r["filename"], r["n"]) for r in first.collect()} == {("hot", 0), ("cold", 0)}


def test_table_dimension_is_checked(spark):
    store.create_if_missing(spark, "dims", 3)
    store.create_if_missing(spark, "dims", 3)
    with pytest.raises(ValueError, match="size 3, not 4"):
        store.create_if_missing(spark, "dims", 4)
    bad = spark.createDataFrame([("a", [1.0, 2.0])], "filename string, embedding array<float>")
    with pytest.raises(Exception, match="expected 3, got 2"):
        store.load_vectors(bad, 3).collect()


def test_stream_ingest_twice_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(10)], "filename string, content string").write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema("filename string, content string").parquet(source)
        query = ingest_stream(stream, "streamed", CharFold(), "ollama", "m", str(tmp_path / f"cp{run}"), order="content")
        query.awaitTermination()
    with pytest.raises(ValueError, match="order"):
        ingest_stream(stream, "streamed", CharFold(), "ollama", "m", str(tmp_path / "unordered"))
    assert spark.table("streamed").count() == 10


def test_names(spark):
    names = ["a.jpg", ".png", "x.tar.TIFF", "noext", "a.", "b.tif"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(is_image(F.col("n"))).collect()] == [True, False, True, False, False, False]
    model = "Org/Modèl-1.5 ü٣"
    got = spark.createDataFrame([(model,)], "m string").select(table_name("ollama", F.col("m"))).first()[0]
    assert got == table_name_of("ollama", model) == "results_ollama_org_modèl_1_5_ü٣"
    with pytest.raises(ValueError):
        table_name_of("other", "m")


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x00\x00\x00@\x01\x02"),)], "b binary")
    out = df.select(unpack_f32("b").alias("v"), pack_f32(unpack_f32("b")).alias("b2")).first()
    assert list(out["v"]) == [1.0, 2.0] and bytes(out["b2"]) == b"\x00\x00\x80?\x00\x00\x00@"


def test_pool_rules(spark):
    df = spark.createDataFrame([([[3.0, 4.0]],), ([[1.0, 0.0], [-1.0, 0.0]],)], "v array<array<double>>")
    assert [list(r[0]) for r in df.select(pool(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="empty list"):
        spark.createDataFrame([([],)], "v array<array<double>>").select(pool(F.col("v"))).collect()


class Wrong:
    dim = 4

    def embed_batch(self, items):
        return np.zeros((len(items), 3))


class Sizes:
    dim = 1

    def embed_batch(self, items):
        return [[len(items)]] * len(items)


def test_embed_checks(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k int, t string")
    with pytest.raises(Exception, match="embedder returned"):
        embed(df, "t", "e", Wrong()).collect()
    with pytest.raises(Exception, match="is null"):
        embed(df.withColumn("t", F.lit(None).cast("string")), "t", "e", CharFold()).collect()
    with pytest.raises(TypeError):
        guard_input(df, "k")
    sizes = {r["e"][0] for r in embed(df.coalesce(1), "t", "e", Sizes(), batch=4).collect()}
    assert sizes <= {4.0, 2.0}
    empty = embed(df.filter("k < 0"), "t", "e", CharFold())
    assert empty.collect() == [] and empty.columns == ["k", "e"]


def test_retries_then_fails():
    waits, tries = [], []

    def flaky(request):
        tries.append(request)
        if len(tries) < 3:
            raise OSError("down")
        return "ok"

    assert call_with_retry(flaky, "r", (1.0, 2.0, 3.0), waits.append) == "ok"
    assert waits == [1.0, 2.0]

    def dead(request):
        raise OSError("down")

    with pytest.raises(OSError):
        call_with_retry(dead, "r", (1.0, 2.0, 3.0), waits.append)
    assert waits == [1.0, 2.0, 1.0, 2.0, 3.0]


class SlowFirst:
    """Replies in another order than asked."""

    def __init__(self):
        self.inner = LoopbackService("content")

    def __call__(self, request):
        import time

        time.sleep(0.05 if len(request) % 2 else 0.0)
        return self.inner(request)


def test_remote_replies_stay_on_their_row(spark):
    rows = [(i, "x" * (i + 1) + str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, t string")
    out = {r["k"]: r["e"] for r in embed_remote(df, "t", "e", SlowFirst()).collect()}
    for k, text in rows:
        assert np.allclose(out[k], CharFold().embed_batch([text])[0], atol=1e-6)


def test_bad_reply_raises(spark):
    df = spark.createDataFrame([("not json",)], "r string")
    with pytest.raises(Exception):
        df.select(reply_vectors(F.col("r"), "content")).collect()
