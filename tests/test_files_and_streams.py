import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vellum.sources import files
from vellum.streaming import stateful


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"question": "q1"}, {"question": "q2", "reference_contexts": ["c"]}]))
    assert [(r.source_row, r.question) for r in files.json_array(spark, str(tmp_path / "g.json")).collect()] == [(0, "q1"), (1, "q2")]
    (tmp_path / "m.json").write_text(json.dumps({"0": {"source_file": "a.pdf", "reason": "matched"}, "1": {"source_file": None, "reason": "no_match"}}))
    assert [(r.source_row, r.source_file) for r in files.json_map(spark, str(tmp_path / "m.json")).collect()] == [(0, "a.pdf")]
    qas = [{"question": "a?", "is_impossible": False, "answers": [{"text": "answer"}]}, {"question": "b?", "is_impossible": True, "answers": []}, {"question": "c?", "answers": []}]
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "ctx", "qas": qas}]}]}))
    assert [r.question for r in files.qa_corpus(spark, str(tmp_path / "c.json")).collect()] == ["a?"]
    (tmp_path / "x.csv").write_text('id,text\n1,"two\nlines and ""quotes"""\n')
    assert files.csv_rows(spark, str(tmp_path / "x.csv"), "id int, text string").first().text == 'two\nlines and "quotes"'
    (tmp_path / "n.txt").write_text(" a.pdf \n\n\tb.PDF\n")
    assert [r.name for r in files.names(spark, str(tmp_path / "n.txt")).collect()] == ["a.pdf", "b.PDF"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"1234")
    (tmp_path / "d" / "b.PDF").write_bytes(b"1" * 100)
    assert files.listing(spark, str(tmp_path / "d"), max_bytes=50).count() == 1
    with pytest.raises(ValueError, match="lacks|missing"):
        files.require(spark.range(1), ["id", "x"])
    assert [r.x for r in spark.createDataFrame([('["a","b"]',), ("plain",), (None,)], "t string").select(files.list_column(F.col("t")).alias("x")).collect()] == [["a", "b"], ["plain"], None]


def test_replace_delete_update(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_partitions(spark.createDataFrame([("u1", "f1", 1), ("u2", "f1", 2)], "user_id string, source_file string, v int"), path, ["user_id", "source_file"])
    files.replace_partitions(spark.createDataFrame([("u1", "f1", 9)], "user_id string, source_file string, v int"), path, ["user_id", "source_file"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 9]
    files.rewrite_without(spark.read.parquet(path), spark.createDataFrame([("u2",)], "user_id string"), ["user_id"], str(tmp_path / "t2"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t2")).collect()] == [9]
    a = spark.createDataFrame([(1, None, "x"), (2, 0.5, "y")], "id int, m double, e string")
    u = files.update_columns(a, spark.createDataFrame([(1, 0.9, None)], "id int, m double, e string"), "id", ["m", "e"])
    assert {(r.id, r.m, r.e) for r in u.collect()} == {(1, 0.9, "x"), (2, 0.5, "y")}


def attempts():
    t0 = datetime(2024, 1, 1)
    at = lambda m, ok: (t0 + timedelta(minutes=m), ok)
    return {"a": [at(i, False) for i in range(5)] + [at(6, False), at(10, True), at(25, False)], "b": [at(i, False) for i in range(4)] + [at(5, True), at(6, False)], "c": [at(i, False) for i in range(4)] + [at(40, False), at(60, False)]}


def test_lockout_batch_equals_stream(spark, tmp_path):
    rows = [(u, ts, ok) for u, xs in attempts().items() for ts, ok in xs]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, ok boolean")
    want = {(u, ts) for u, xs in attempts().items() for ts, _ in stateful.lockouts_of([(pd.Timestamp(t), ok) for t, ok in xs])[0]}
    assert {(r.user_id, pd.Timestamp(r.locked_at)) for r in stateful.lockouts_batch(df).collect()} == want and len(want) == 2
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stateful.lockouts_stream(stateful.stream_table(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, pd.Timestamp(r.locked_at)) for r in spark.sql("SELECT * FROM locks").collect()} == want


def test_frames_stream_equals_batch(spark, tmp_path):
    schema, src = "id string, seq long, kind string, payload string", str(tmp_path / "in")
    first = [("a", 2, "token", "llo"), ("a", 1, "token", "he"), ("b", 1, "token", "x"), ("c", 1, "token", "open")]
    later = [("a", 3, "done", "[1]"), ("a", 4, "verification", "{}"), ("b", 2, "error", "bad")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in (first, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stateful.frames_stream(stateful.stream_table(spark, src, schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in stateful.fold_frames(spark.createDataFrame(first + later, schema)).drop("n_frames").collect() if r.id != "c"}
    assert got == want and len(got) == 2


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    a = spark.read.parquet(f"{DATA}/audit_logs.parquet").filter("ip_address IS NOT NULL").select("ip_address", "action", F.col("created_at").cast("timestamp").alias("created_at"))
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stateful.rate_limits(stateful.stream_table(spark, str(tmp_path / "in"), a.schema), 0).writeStream.format("memory").queryName("limits").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM limits").first().n == a.count()


def test_append_audit(spark, tmp_path):
    a = spark.read.parquet(f"{DATA}/audit_logs.parquet")
    a.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stateful.append_audit(stateful.stream_table(spark, str(tmp_path / "in"), a.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == a.count()
