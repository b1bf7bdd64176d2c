"""Entries, logs, graph files and state through files and back."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources import readers as R
from tessera.sources import sinks as K


def test_entry_round_trip(spark, tmp_path):
    rows = [("01A", "2024-03-09T10:00:00", "note", "p", "abs", "over: view", "con\ntent"), ("01B", "2024-03-10T10:00:00", "task", "q", "", "", "x")]
    e = spark.createDataFrame(rows, "id string, date string, type string, project string, abstract string, overview string, content string")
    from tessera.functions import scalars as S

    files = e.select(F.concat(F.lit("/m/timeline/2024/03/09/entry_"), "id", F.lit(".md")).alias("path"), S.markdown_entry({c: F.col(c) for c in e.columns}).alias("text"))
    folder = tmp_path / "timeline/2024/03/09"
    folder.mkdir(parents=True)
    for r in files.collect():
        (folder / r.path.split("/")[-1]).write_text(r.text)
    back = R.entries(spark, str(tmp_path))
    assert sorted(tuple(r) for r in back.select(*e.columns).collect()) == sorted(rows)
    assert {str(r.day) for r in back.collect()} == {"2024-03-09"}


def test_entry_atoms(spark):
    text = '---\nid: 1\n---\n# ≡≡≡ Abstract ≡≡≡\n```\nshort\n```\n# ≡≡≡ Atoms ≡≡≡\n```json\n[{"local_id":"a","name":"A"}]\n```\n'
    bad = text.replace('[{"local', '[{local')
    e = R.parsed_entries(spark.createDataFrame([("p", text), ("q", bad)], "path string, text string"))
    got = {r.path: r.atoms for r in e.collect()}
    assert got["p"][0]["local_id"] == "a" and not (got["q"] or [None])[0]
    assert R.by_atom(e, "a").count() == 1


def test_catalog_override(spark):
    c = spark.createDataFrame([("1", "a.md", "t", "old", "o"), ("2", "gone.md", "t", "x", "y")], "id string, path string, type string, abstract string, overview string")
    f = spark.createDataFrame([("a.md", "", "new", "o2")], "path string, type string, abstract string, overview string")
    assert [tuple(r) for r in R.catalogued(c, f).collect()] == [("1", "a.md", "t", "new", "o2")]


def test_graph_file(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "n", "label": "a.js"}], "links": []}))
    nodes, links = R.graph_file(spark, str(p))
    assert nodes.count() == 1 and links.count() == 0 and G.classified_nodes(nodes).first()["kind"] == "entity"
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        R.graph_file(spark, str(tmp_path / "bad.json"))


def test_missing_state_is_empty(spark, tmp_path):
    assert R.state(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_logs_and_project_files(spark):
    logs = spark.createDataFrame([("l", "# Title\n\n## One\n**Date**: 2024-01-01\n**Type**: note\n\n## Undated\nx")], "path string, text string")
    assert [(r.date, r.type) for r in R.log_entries(logs).collect()] == [("2024-01-01", "note")]
    files = spark.createDataFrame([("src/a.js", "x"), ("node_modules/b.js", "x"), ("src/c.txt", "x"), ("src/long.py", "\n" * 2000)], "path string, text string")
    assert [r.path for r in R.project_files(files).collect()] == ["src/a.js"]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("1", "2024-03-09"), ("2", "2024-04-01")], "id string, date string")
    K.by_day(e, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).where("yyyy = 2024 AND mm = 4")
    assert [r.id for r in back.collect()] == ["2"] and "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()
    assert e.select(K.csv_line(["id", "date"])).first()[0] == "1,2024-03-09"
    assert spark.createDataFrame([("a,b", 1)], "x string, y int").select(K.csv_line(["x", "y"])).first()[0] == '"a,b",1'
    K.published(e, str(tmp_path / "stage"), str(tmp_path / "final"), lambda d: d.count() == 2)
    with pytest.raises(ValueError):
        K.published(e.limit(1), str(tmp_path / "stage"), str(tmp_path / "final"), lambda d: d.count() == 2)
    assert spark.read.parquet(str(tmp_path / "final")).count() == 2
    assert K.upload_rows(spark.createDataFrame([("x", None)], "id string, type string")).first()["type"] == "general"


def test_pushdown(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_totalprice > 1000").select("o_orderkey")
    plan = d._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[-1]
