"""A knowledge base is published whole: a crash between its tables leaves the version before."""

import pytest
from pyspark.sql import DataFrameWriter

from tessera.api import TABLES, KnowledgeBase
from tessera.sources import versions as V


def base(spark, name):
    k = KnowledgeBase.empty(spark)
    rows = spark.createDataFrame([(name, "t", [], "p", "a", "o", "c", None, False, False)], k.entities.schema)
    edges = spark.createDataFrame([(name, name, "related", 1.0)], k.edges.schema)
    return KnowledgeBase(spark, rows, k.atoms, edges)


def content(k):
    return [r.id for r in k.entities.collect()], [r.from_id for r in k.edges.collect()]


def test_a_crash_in_between(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        KnowledgeBase.load(spark, path)
    assert base(spark, "old").save(path) == 1
    written, write = [], DataFrameWriter.parquet

    def failing(self, to, *args, **more):
        if len(written) == 2:
            raise OSError("the disk is full")
        written.append(to)
        return write(self, to, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        base(spark, "new").save(path)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert len(written) == 2 and content(KnowledgeBase.load(spark, path)) == (["old"], ["old"])
    assert base(spark, "new").save(path) == 2 and content(KnowledgeBase.load(spark, path)) == (["new"], ["new"])
    assert content(KnowledgeBase.load(spark, path, 1)) == (["old"], ["old"])


def test_versions_before_the_last_two_go(spark, tmp_path):
    path = str(tmp_path / "kb")
    for i in range(4):
        (KnowledgeBase.load(spark, path).pin("x") if i == 2 else base(spark, f"n{i}")).save(path)
    assert V.numbers(spark, path) == [3, 4] and len([p for p in (tmp_path / "kb").iterdir() if p.is_dir()]) == 2 * len(TABLES)
    assert content(KnowledgeBase.load(spark, path, 3)) == (["n1"], ["n1"])


def test_the_slower_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    base(spark, "first").save(path)
    read = V.read

    def late(spark, path, number=None):
        monkeypatch.setattr(V, "read", read)
        out = read(spark, path, number)
        base(spark, "fast").save(path)
        return out

    monkeypatch.setattr(V, "read", late)
    with pytest.raises(V.Conflict):
        base(spark, "slow").save(path)
    assert content(KnowledgeBase.load(spark, path)) == (["fast"], ["fast"])
