"""The facade's tools on a small base."""

from datetime import datetime

import pytest

from tessera.api import ATOM, EDGE, ENTITY, KnowledgeBase


@pytest.fixture(scope="module")
def kb(spark):
    at = datetime(2024, 3, 9)
    rows = [("a", "note", ["x"], "p", "alpha text", "about alpha", "alpha beta gamma", at, False, False), ("b", "note", ["x", "note"], "p", "beta", "b", "beta only", at, True, False), ("c", "task", None, "p", None, None, "", at, False, False)]
    k = KnowledgeBase.empty(spark).write(spark.createDataFrame(rows, ENTITY))
    atoms = [("a", "1", None, "Root", "alpha " * 30, 1, "a0"), ("a", "2", "1", "alpha part", "alpha", 2, "a1"), ("a", "3", "2", "Leaf", "z" * 400, 3, "a2")]
    k = KnowledgeBase(spark, k.entities, spark.createDataFrame(atoms, ATOM), k.edges)
    return k.relate(spark.createDataFrame([("a", "b", "calls", None), ("a", "b", "calls", 0.9)], EDGE))


def test_tools(spark, kb, tmp_path):
    assert kb.entities.count() == 2  # c has no content
    assert [r.id for r in kb.search("alpha").collect()] == ["a"]
    assert kb.search("lph").first()["id"] == "a"  # substring fallback
    assert kb.read("a", 0).first()["content"] is None and kb.read("a/2").first()["name"] == "alpha part"
    assert {r.path for r in kb.entity_atoms("a").collect()} == {"Root", "Root > alpha part", "Root > alpha part > Leaf"}
    assert {r.local_id for r in kb.context_level("a", 2).collect()} == {"1", "2"}
    got = kb.context_budget("alpha", 50).collect()
    assert {r.local_id for r in got} == {"1", "2"} and max(r.used for r in got) <= 50
    assert kb.edges.count() == 1 and {(r.id, r.depth) for r in kb.graph("a").collect()} == {("a", 0), ("b", 1)}
    assert {r.topic: r.n for r in kb.topics().collect()} == {"note": 3, "x": 2}
    assert kb.status().first()["pending"] == 1
    server = spark.createDataFrame([("a", "other"), ("zz", "h")], "source_id string, hash string")
    assert {r.source_id: r.action for r in kb.sync_preview(server).collect()} == {"a": "conflict", "b": "upload", "zz": "delete"}
    assert kb.conflicts(server).count() == 1 and kb.full_sync(kb.fingerprints()).status().first()["pending"] == 0
    assert kb.quality().first()["isolated_entities"] == 0 and kb.diagnose().count() >= 1
    assert kb.suggest("alp").count() == 1 and kb.recent(1).count() == 1 and kb.timeline().count() == 2
    assert kb.pin("a").entities.where("pinned").count() == 1 and kb.recommend().count() >= 1
    kb.save(str(tmp_path / "kb"))
    assert KnowledgeBase.load(spark, str(tmp_path / "kb")).edges.count() == 1


def test_incremental_sync_and_chinese_budget(spark, kb):
    server = spark.createDataFrame([("zz", "h")], "source_id string, hash string")
    same, run = kb.incremental_sync(server)
    assert same is kb and {r.source_id: r.status for r in run.collect()} == {"a": "pending", "b": "pending", "zz": "to_delete"}
    after, run = kb.incremental_sync(server, accepted=spark.createDataFrame([("a",)], "source_id string"))
    assert {r.source_id: r.status for r in run.collect()} == {"a": "uploaded", "b": "failed", "zz": "to_delete"}
    assert {r.id: r.synced for r in after.entities.collect()} == {"a": True, "b": False}
    atoms = spark.createDataFrame([("e", "1", None, "x", "知识图谱" * 5, 2, "a"), ("e", "2", None, "y", "zzzz " * 4, 2, "b")], ATOM)
    k = KnowledgeBase(spark, kb.entities, atoms, kb.edges)
    assert [r.local_id for r in k.context_budget("知识图谱", 32).collect()] == ["1"]
    assert kb.health_check().first()["entity_count"] == 2
