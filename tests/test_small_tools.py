"""Procedures, presentation and the command line."""

from tessera import cli
from tessera import presentation as P
from tessera.api import ATOM, EDGE, ENTITY, KnowledgeBase
from tessera.operators import sop


def test_sop(spark):
    s = sop.parse('name: tidy  # a comment\nsteps:\n  - action: detect_isolated\n    note: "x"\n  - action: unknown\n  - action: verify\n')
    assert s["name"] == "tidy" and len(s["steps"]) == 3
    n = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, abstract string")
    e = spark.createDataFrame([], EDGE)
    r = sop.run(s, n, e, skip=(3,))
    assert [x["status"] for x in r] == ["done", "done", "skipped"] and r[0]["found"] == 2 and sop.tally(r) == {"done": 2, "skipped": 1, "failed": 0}


def test_presentation(spark, capsys, tmp_path):
    assert P.bars({"a": 2, "bb": 1}, 4) == "a  ████ 2\nbb ██ 1"
    assert P.sparkline([0, 1]) == "▁█" and P.progress(5, 10, 4) == "[██░░] 50%" and P.arrow("up") == "↑"
    kb = KnowledgeBase.empty(spark)
    from datetime import datetime

    rows = [("a", "note", [], "p", "abs", "over", "alpha beta", datetime(2024, 1, 1), False, False)]
    kb = KnowledgeBase(spark, spark.createDataFrame(rows, ENTITY), spark.createDataFrame([("a", "1", None, "Root", "x", 1, "a")], ATOM), kb.edges)
    kb.save(str(tmp_path / "kb"))
    for args in (["search", "alpha"], ["index"], ["tree", "a"], ["topics"]):
        cli.main([str(tmp_path / "kb"), *args])
    out = capsys.readouterr().out
    assert "## By type" in out and "Root" in out


def test_missing_relations_send_each_source_once(spark):
    """Edges are folded to their sources before they meet the nodes."""
    from tessera.operators import graph as G

    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")] * 5, "from_id string, to_id string")
    left = G.without_out_edges(nodes, edges)
    assert [r.id for r in left.collect()] == ["b"] and "Aggregate [" in left._jdf.queryExecution().optimizedPlan().toString()
