"""Blob stores, page readers, scripts and the streaming loop."""

import pytest
from pyspark.sql import functions as F

from weftgraph.sources.blobs import BlobStore, run_script, statements, text_pages
from weftgraph.streaming import status


def test_blobs(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/blobs")
    store.upload("docs", "some/where/a.txt", b"one\ftwo")
    store.upload("docs", "b.txt", b"x")
    assert store.download("docs", "a.txt") == b"one\ftwo"
    pages = {(r["doc_id"], r["page_no"]): r["text"] for r in text_pages(store.read("docs")).collect()}
    assert pages == {("a.txt", 0): "one", ("a.txt", 1): "two", ("b.txt", 0): "x"}
    assert store.delete("docs", "b.txt") and not store.delete("docs", "b.txt")
    store.clear("docs")
    with pytest.raises(FileNotFoundError):
        store.download("docs", "a.txt")


def test_script(spark):
    assert run_script(spark, "-- views\nCREATE OR REPLACE TEMP VIEW va AS SELECT ';' AS x;\nCREATE OR REPLACE TEMP VIEW vb AS SELECT * FROM va;") == 2
    assert spark.table("vb").first()["x"] == ";"


def test_ingest_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/landing")
    seen = []
    q = status.ingest_stream(status.read_landing(spark, f"{tmp_path}/landing", "doc_id long, text string"), lambda df, i: seen.append(df.count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(seen) == 2


def test_status_stream(spark, tmp_path):
    ev = spark.createDataFrame([(1, 10, "x", "processing", 10), (2, 20, "x", "done", 100), (3, 5, "y", "processing", 30)], "event_id long, t long, doc_id string, status string, progress_pct int")
    ev.select("event_id", F.timestamp_seconds("t").alias("ts"), "doc_id", "status", "progress_pct", F.lit(None).cast("string").alias("error")).write.parquet(f"{tmp_path}/ev")
    schema = spark.read.parquet(f"{tmp_path}/ev").schema
    q = status.status_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev"), "memory", f"{tmp_path}/cp2", "latest")
    q.awaitTermination()
    assert {(r["doc_id"], r["status"]) for r in spark.table("latest").collect()} == {("x", "done"), ("y", "processing")}
    batch = spark.read.parquet(f"{tmp_path}/ev")
    stored = spark.createDataFrame([("z", None, None)], "doc_id string, status string, progress_pct int")
    asked = spark.createDataFrame([("x",), ("z",), ("q",)], "doc_id string")
    got = {r["doc_id"]: (r["status"], r["progress_pct"]) for r in status.status_of(status.latest_status(batch), stored, asked).collect()}
    assert got == {"x": ("done", 100), "z": ("processing", 10), "q": ("NOT_FOUND", None)}


def test_statements():
    assert statements("select 1; select 'it\"s'") == ["select 1", "select 'it\"s'"]
    assert statements("select 1; -- it's\nselect 2") == ["select 1", "select 2"]
    assert statements("a ';' \"x;'y\" `b;`; c 'it''s; d'") == ["a ';' \"x;'y\" `b;`", "c 'it''s; d'"]
    assert statements(r"a '\';' ; b '\\'; c") == [r"a '\';'", r"b '\\'", "c"]
    assert statements("// head; er\na 'http://x' /* ; ' */ b\n  // it's\n;;\n--") == ["a 'http://x'   b"]
    assert statements("a '-- no; /* no */ // no'; b") == ["a '-- no; /* no */ // no'", "b"]
    assert statements("") == [] and statements(" ;\n; -- x") == []
    for bad in ("select 'a", 'x "', "`a", "a /* b"):
        with pytest.raises(ValueError, match="not closed"):
            statements(bad)
