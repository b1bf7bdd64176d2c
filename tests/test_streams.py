"""Streams run with availableNow over files and give what the batch gives."""

import json

from pyspark.sql import functions as F

from tessera.streaming import feeds as M

SF = "/root/testdata/sf0.001"


def drained(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def feed(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "events"))
    return d, M.file_feed(spark, str(tmp_path / "events"), d.schema, 1)


def test_windowed_counts(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    got = drained(M.windowed_counts(stream, late="60 days"), "complete", tmp_path, "counts")
    want = {tuple(r) for r in M.windowed_counts(batch).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_deduplicated(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    batch.limit(50).write.mode("append").parquet(str(tmp_path / "events"))
    assert drained(M.deduplicated(stream, late="90 days"), "append", tmp_path, "distinct_events").count() == batch.count()


def test_in_batches(spark, tmp_path):
    _, stream = feed(spark, tmp_path)
    sizes = []
    q = M.in_batches(stream, lambda df, i: sizes.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(sizes) == 1000 and len(sizes) == 4


def test_patches():
    doc = {"a": 1, "l": [1, 2]}
    ops = [{"op": "add", "path": "/b", "value": {"c": 1}}, {"op": "replace", "path": "/a", "value": 5}, {"op": "add", "path": "/l/-", "value": 3}, {"op": "remove", "path": "/l/0"}, {"op": "move", "from": "/b/c", "path": "/d"}, {"op": "copy", "from": "/d", "path": "/b/e"}]
    assert M.patched(doc, ops) == {"a": 5, "l": [2, 3], "b": {"e": 1}, "d": 1}
    assert doc == {"a": 1, "l": [1, 2]}
    assert M.patched(doc, [{"op": "test", "path": "/a", "value": 9}, {"op": "remove", "path": "/a"}]) == doc


def test_documents_under_patch(spark, tmp_path):
    rows = [("x", 1, json.dumps([{"op": "add", "path": "/n", "value": 1}])), ("x", 2, json.dumps([{"op": "replace", "path": "/n", "value": 2}])), ("y", 1, json.dumps([{"op": "add", "path": "/m", "value": 0}])), ("x", 2, json.dumps([{"op": "replace", "path": "/n", "value": 99}]))]
    spark.createDataFrame(rows, "id string, seq long, patch string").coalesce(1).write.parquet(str(tmp_path / "p"))
    s = M.file_feed(spark, str(tmp_path / "p"), "id string, seq long, patch string")
    got = drained(M.documents_under_patch(s), "update", tmp_path, "patched_docs")
    assert {(r.id, r.document) for r in got.collect()} == {("x", '{"n": 2}'), ("y", '{"m": 0}')}


def test_state_machine(spark, tmp_path):
    rows = [("c", 1, "connecting"), ("c", 2, "connected"), ("c", 3, "connecting"), ("c", 4, "reconnecting")]
    spark.createDataFrame(rows, "id string, seq long, state string").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = drained(M.state_machine(M.file_feed(spark, str(tmp_path / "s"), "id string, seq long, state string")), "update", tmp_path, "machine")
    assert [tuple(r) for r in got.collect()] == [("c", "reconnecting", 1)]
