"""Depth, size and odd shapes: chains of a thousand rows, cycles, tables that replace themselves, Chinese queries, languages."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.api import ATOM, EDGE, ENTITY, KnowledgeBase
from tessera.functions import scalars as S
from tessera.operators import code as C
from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.operators import index as X
from tessera.operators import project as P
from tessera.operators import recommend as RC
from tessera.operators import retrieval as R
from tessera.operators import sync as Y

TREE = "local_id string, parent_id string, name string, heading_level int"


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(str(i), str(i - 1) if i else None, f"n{i}", 1) for i in range(1000)]
    return spark.createDataFrame(rows, TREE).repartition(4)


def test_deep_chain(spark, chain):
    paths = {r.local_id: (r.depth, r.path) for r in H.tree_paths(chain).collect()}
    assert len(paths) == 1000 and paths["999"] == (1000, " > ".join(f"n{i}" for i in range(1000)))
    assert {r.local_id for r in H.tree_paths(chain, max_level=3).collect()} == {"0", "1", "2"}
    assert H.cyclic(chain).count() == 0
    ops = spark.createDataFrame([(1, "remove", "300", None, None), (2, "update", "700", "10", "moved")], "seq int, op string, local_id string, parent_id string, name string")
    assert {int(r.local_id) for r in H.applied_operations(chain, ops).collect()} == {*range(300), *range(700, 1000)}
    assert H.level_filter(chain, 2).count() == 1000 and H.level_filter(chain, 1).count() == 1


def test_cycles_of_many_sizes(spark):
    rows, want = [], {}
    for size in (1, 2, 3, 7, 300):
        ids = [f"c{size:03d}-{i:03d}" for i in range(size)]
        rows += [(x, ids[(i + 1) % size], x, 1) for i, x in enumerate(ids)]
        rows += [(f"tail{size}-{k}", ids[0] if k == 0 else f"tail{size}-{k - 1}", "t", 1) for k in range(5)]
        want |= {x: ids[0] for x in ids}
    rows += [("root", None, "r", 1), ("leaf", "root", "l", 1), ("lost", "nowhere", "l", 1)]
    d = spark.createDataFrame(rows, TREE)
    assert {r.local_id for r in H.cyclic(d).collect()} == {r[0] for r in rows} - {"root", "leaf", "lost"}
    assert {r.local_id: r.cycle for r in H.on_cycles(d).collect()} == want
    assert {r.local_id for r in H.tree_paths(d).collect()} == {"root", "leaf", "lost"}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}", "calls", 1.0) for i in range(300)], "from_id string, to_id string, type string, weight double")
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(305)], "id string")
    labels = G.components(e, nodes)
    assert {r.id: r.component for r in labels.collect()} == {f"{i:04d}": "0000" if i <= 300 else f"{i:04d}" for i in range(305)}
    got = {r.component: (r.size, r.is_largest, r.is_small) for r in G.component_summary(labels).collect()}
    assert got["0000"] == (301, True, False) and got["0302"] == (1, False, True) and sum(x[1] for x in got.values()) == 1


def test_a_base_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "kb")
    rows = [("a", "note", ["x"], "p", "alpha", "about", "alpha", None, False, False), ("b", "note", None, "p", "beta", "b", "beta", None, False, False)]
    k = KnowledgeBase(spark, spark.createDataFrame(rows, ENTITY), spark.createDataFrame([], ATOM), spark.createDataFrame([("a", "b", "calls", 0.5)], EDGE))
    k.save(path)
    for _ in range(2):
        KnowledgeBase.load(spark, path).pin("a").save(path)
    again = KnowledgeBase.load(spark, path)
    assert again.entities.count() == 2 and [r.id for r in again.entities.where("pinned").collect()] == ["a"] and again.edges.count() == 1


def test_budget_against_plain_greedy(spark):
    r = random.Random(2)
    rows = [(f"e{r.randrange(4)}", str(i), r.randrange(0, 60), round(r.random(), 3), r.choice([None, 1, 2, 3]), f"{i:05d}") for i in range(800)]
    d = spark.createDataFrame(rows, "entity_id string, local_id string, tokens long, relevance double, heading_level int, `order` string").repartition(5)
    for strategy, key in (("relevance", lambda x: (-x[3], x[5], x[1], x[2])), ("hierarchy", lambda x: (99 if x[4] is None else x[4], -x[3], x[1], x[2]))):
        want = {}
        for e in {x[0] for x in rows}:
            used, ids = 0, []
            for x in sorted((x for x in rows if x[0] == e), key=key):
                if used + x[2] <= 200:
                    used += x[2]
                    ids.append(x[1])
            want[e] = (used, sorted(ids))
        got = {}
        for x in R.budget_select(d, 200, strategy).collect():
            got.setdefault(x.entity_id, (x.used, []))[1].append(x.local_id)
        assert {e: (u, sorted(i)) for e, (u, i) in got.items()} == want
        for large in (0, 200):  # all groups, and some, by rounds over ranges
            again = {}
            for x in R.budget_select(d, 200, strategy, large=large).collect():
                again.setdefault(x.entity_id, (x.used, []))[1].append(x.local_id)
            assert {e: (u, sorted(i)) for e, (u, i) in again.items()} == want


def test_routed_search(spark, tmp_path):
    entities = spark.createDataFrame([(str(i), "note", t) for i, t in enumerate(["知识图谱 与 异步编程", "alpha beta", "gamma delta", "other words"])], "id string, type string, content string")
    atoms = spark.createDataFrame([("1", "x", "section", "head", "zeta eta"), ("2", "y", "code", "head", "alpha zeta")], "entity_id string, local_id string, type string, name string, content string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(X.routed_search(entities, atoms, "异步编程")) == {"0"}  # Chinese terms as well
    assert ids(X.routed_search(entities, atoms, "alpha")) == {"1", "2/y"}
    assert ids(X.routed_search(entities, atoms, "alpha", "entity")) == {"1"}
    assert ids(X.routed_search(entities, atoms, "alpha", "atom")) == {"2/y"}
    assert ids(X.routed_search(entities, atoms, "alpha", "atom", ["section"])) == {"1"}  # no such atom: all are searched
    assert ids(R.search(entities.withColumnsRenamed({"id": "doc_id", "content": "text"}), "知识图谱")) == {"0"}
    with pytest.raises(ValueError):
        X.routed_search(entities, atoms, "alpha", "nowhere")
    index = X.TextIndex.of(entities, "id", "content")
    index.save(str(tmp_path / "i"))
    loaded = X.TextIndex.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "alpha"), (2, "zzz")], "query_id int, text string")
    assert [(r.query_id, r.id) for r in loaded.search(asked).collect()] == [(1, "1")]
    again = loaded.upsert(spark.createDataFrame([("1", "nothing"), ("9", "alpha alpha")], "id string, content string"), "id", "content")
    assert [(r.query_id, r.id) for r in again.search(asked).collect()] == [(1, "9")] and again.stats().first()["n"] == 5
    names = X.names_and_abstracts(entities.withColumn("abstract", F.col("content")), atoms, "alpha")
    assert {r.suggestion for r in names.collect()} == {"alpha beta", "head"}


def test_nearest_vectors_against_all_pairs(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = set()
    for i, v in rows[:20]:
        near = sorted(((-round(cos(v, w), 9), j) for j, w in rows if j != i and cos(v, w) >= 0.3))[:4]
        want |= {(i, j, n) for n, (_, j) in enumerate(near, 1)}
    assert {(x.from_id, x.to_id, x["rank"]) for x in RC.similar_to(d, 20, 4, 0.3).collect()} == want


def test_same_type_against_all_pairs(spark):
    r = random.Random(9)
    ents = [(i, f"t{r.randrange(3)}") for i in range(60)]
    links = {(r.randrange(60), r.randrange(60)) for _ in range(150)} | {(5, j) for j in range(60)}
    got = RC.same_type(spark.createDataFrame(ents, "id long, type string"), spark.createDataFrame(sorted(links), "from_id long, to_id long"), 3)
    want = {(i, j) for i, t in ents for j in [j for j, u in ents if u == t and j != i and (i, j) not in links][:3]}
    assert {(x.from_id, x.to_id) for x in got.collect()} == want


def test_similar_uploads_against_all_pairs(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    stored = [(i, v) for i, v in enumerate(base)]
    new = [(100 + i, [x + r.gauss(0, 0.01) for x in v]) for i, v in enumerate(base[:20])] + [(200 + i, [r.gauss(0, 1) for _ in range(64)]) for i in range(20)]
    schema = "vec_id long, embedding array<double>"
    got = {x.id: x.duplicate_of for x in Y.similar_on_upload(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema), 0.99).collect()}
    assert got == {100 + i: i for i in range(20)}


def test_languages(spark):
    sources = {
        "a.ts": "import { x } from './x';\nimport y from 'react';\nexport * from './z';\nexport class Store<T> extends Base<T> implements One, Two<T> {\n  private async load(id: string): Promise<void> {\n    if (id) { fetchAll(id); }\n  }\n}\nexport interface Shape {\n  area(): number;\n}\nconst add = async (a: number, b: number): number => {\n  return a ? b : 0;\n};\n",
        "b.go": "package m\n\nimport (\n\t\"fmt\"\n\tx \"github.com/a/b\"\n)\n\ntype Reader interface {\n}\ntype T struct {\n\tn int\n}\nfunc (t *T) Run(a int) error {\n\tfor i := 0; i < a; i++ {\n\t\tfmt.Println(i)\n\t}\n\treturn nil\n}\nfunc New() *T { return &T{} }\n",
        "c.rs": "use std::io::Read;\npub use crate::a;\n\npub struct P { x: i32 }\nenum E { A }\npub trait Shape { fn area(&self) -> f64; }\nimpl Shape for P {\n    fn area(&self) -> f64 {\n        if self.x > 0 { helper(1.0) } else { 0.0 }\n    }\n}\npub async fn run<T>(x: T) { println!(\"{}\", 1); }\n",
        "D.java": "package p;\nimport java.util.List;\nimport static java.lang.Math.max;\npublic final class D extends Base implements Runnable, java.io.Closeable {\n  @Override\n  public void run() {\n    while (true) { step(1); }\n  }\n  private static <T> List<T> of(T a, T b) throws Exception {\n    return make(a);\n  }\n  enum Kind { A }\n}\n",
    }
    a = C.analysed(spark.createDataFrame(list(sources.items()), "path string, text string")).cache()
    kinds = {}
    for r in C.symbols(a).collect():
        kinds.setdefault(r.path, {})[r.name] = (r.kind, r.super_class, tuple(r.implements))
    assert kinds["a.ts"] == {"Store": ("class", "Base", ("One", "Two")), "load": ("function", None, ()), "Shape": ("interface", None, ()), "add": ("function", None, ())}
    assert kinds["b.go"] == {"Reader": ("interface", None, ()), "T": ("class", None, ()), "Run": ("function", None, ()), "New": ("function", None, ())}
    assert {k: v[0] for k, v in kinds["c.rs"].items()} == {"P": "class", "E": "class", "Shape": "interface", "area": "function", "run": "function"}
    assert kinds["D.java"] == {"D": ("class", "Base", ("Runnable", "java.io.Closeable")), "run": ("function", None, ()), "of": ("function", None, ()), "Kind": ("class", None, ())}
    found = {(r.from_path, r.module): r.kind for r in C.imports(a).collect()}
    assert found == {
        ("a.ts", "./x"): "internal", ("a.ts", "react"): "external", ("a.ts", "./z"): "internal", ("b.go", "fmt"): "builtin", ("b.go", "github.com/a/b"): "internal",
        ("c.rs", "std::io::Read"): "builtin", ("c.rs", "crate::a"): "external", ("D.java", "java.util.List"): "builtin", ("D.java", "java.lang.Math.max"): "builtin",
    }
    calls = {(r.path, r.caller, r.target) for r in C.calls(a).collect()}
    assert {("a.ts", "load", "fetchAll"), ("b.go", "Run", "fmt.Println"), ("c.rs", "area", "helper"), ("D.java", "run", "step"), ("D.java", "of", "make")} <= calls


def test_very_long_file(spark):
    text = "".join(f"function f{i}(a) {{ return g(a); }}\n" for i in range(12_000))
    a = C.analysed(spark.createDataFrame([("long.js", text)], "path string, text string")).first()
    assert len(a.symbols) == 12_000 and a.lines == 12_001


def test_percentiles_against_numpy(spark):
    import numpy as np

    from tessera.operators import quality as Q

    r = random.Random(1)
    rows = [("a", r.gauss(0, 1)) for _ in range(5001)] + [("b", float(r.randrange(3))) for _ in range(2000)] + [("c", 7.5), ("d", None), (None, 1.0), (None, 3.0)]
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: x for x in Q.exact_percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "g", "x", points).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        v = [x for k, x in rows if k == g]
        for k, p in points.items():
            assert got[g][k] == pytest.approx(np.percentile(v, 100 * p)), (g, k)


def test_delays_and_ids(spark):
    d = spark.createDataFrame([(n, draw) for n in range(5) for draw in (0.0, 0.999)], "n int, draw double")
    for r in d.select("n", "draw", S.retry_delay("n", 100.0, "draw").alias("x"), S.reconnect_delay(F.col("n") + 1, 100.0, 500.0, "draw").alias("y")).collect():
        assert 50 * 2**r.n <= r.x <= 100 * 2**r.n and min(100 * 2**r.n, 500) <= r.y <= min(100 * 2**r.n, 500) + 1000
    ids = [r.i for r in spark.range(1000).select(S.sortable_id(F.col("id") * 7 + 1_700_000_000_000, "id").alias("i")).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 1000 and all(len(i) == 26 and set(i) <= set(S.BASE32) for i in ids)


def test_facade_additions(spark):
    rows = [("a", "note", ["x"], "p", "alpha", "about", "alpha beta", None, False, False), ("b", "note", None, "p", "beta", "b", "beta", None, True, False)]
    k = KnowledgeBase(spark, spark.createDataFrame(rows, ENTITY), spark.createDataFrame([("a", "1", None, "n", "c", 1, "a0")], ATOM), spark.createDataFrame([], EDGE))
    assert tuple(k.index_status().select("n", "pending").first()) == (2, 1)
    assert tuple(k.rebuild_index().first()) == (1, 0, 0) and tuple(k.rebuild_index(spark.createDataFrame([("a",)], "id string")).first()) == (1, 1, 0)
    server = spark.createDataFrame([("a", "h", "other", "p/a"), ("z", "h2", "x", "p/z")], "source_id string, hash string, content string, path string")
    assert [r.resolved for r in k.conflict_resolve(server, "merge").collect()] == ["alpha beta\nother"]
    assert [(r.source_id, r.total) for r in k.sync_checkpoint(server, 1).collect()] == [("a", 2)]
    more = k.add_atoms(spark.createDataFrame([("a", "1", None, "new", "c", 1, "a0"), ("b", "2", None, "m", "c", 1, "a0")], ATOM))
    assert sorted(r.name for r in more.atoms.collect()) == ["m", "new"]
    assert [r.name for r in more.remove_atoms(spark.createDataFrame([("a", "1")], "entity_id string, local_id string")).atoms.collect()] == ["m"]


def test_presentation(spark):
    from tessera import presentation as T

    assert T.line([0, 1, 2], 3).split("\n")[0].endswith("┤  ●") and T.box("t", ["ab"]).split("\n")[1] == "│ t  │"
    d = spark.createDataFrame([("isolated", "high"), ("isolated", "high"), ("weak", "low")], "issue string, severity string")
    text = T.dashboard(spark.createDataFrame([(3, 0.5)], "entity_count int, network_density double"), d, [1, 2, 3])
    assert "entity_count: 3" in text and "isolated" in text.split("Issues")[1].split("weak")[0] and "Trend ▁▄█" in text
    files = spark.createDataFrame([("a.py", "python", 10, 2, 5), ("b.py", "python", 90, 1, 7)], "path string, language string, lines int, functions int, complexity int")
    assert T.project_report(files, files.groupBy().count()).index("b.py") < T.project_report(files, files.groupBy().count()).index("a.py") and '"path": "a.py"' in T.as_json(files)


def test_queries_of_all_sizes_are_one_pass(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(12)] + [(300, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {tuple(x) for x in RC.similar_to(d.where("embedding IS NOT NULL"), 212, 4, 0.3).select("from_id", "to_id", "rank").collect()}
    got = RC.similar_in_blocks(d, d, 4, 0.3, block=1)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x) for x in got.select("from_id", "to_id", "rank").collect()} == want


def test_queries_and_vectors_of_several_shares(spark, monkeypatch):
    monkeypatch.setattr(RC, "CELL", 40)
    r = random.Random(10)
    d = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(150)], "vec_id long, embedding array<double>")
    pairs = lambda df: {(x.from_id, x.to_id, round(x.similarity, 9), x["rank"]) for x in df.collect()}
    assert pairs(RC.similar_in_blocks(d, d, 3, 0.2)) == pairs(RC.similar_to(d, 150, 3, 0.2))
    assert pairs(RC.similar_in_blocks(d, d.limit(0), 3, 0.2)) == set()


def test_hits_of_a_document_are_summed_where_they_are_made(spark, monkeypatch):
    """Two exchanges for a batch of queries, of postings by document and of the best by query; none of hits, which are as many as postings times queries."""
    words = [f"w{i}" for i in range(30)]
    r = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=20))) for i in range(300)] + [(300, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=6))) for q in range(20)], "query_id int, text string")
    one = {(x.query_id, x.id, x["rank"]) for x in R.bm25_batch(docs, queries, 5).collect()}
    monkeypatch.setattr(R, "POSTINGS", 100)
    dealt = R.bm25_batch(docs, queries, 5)
    assert dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    assert {(x.query_id, x.id, x["rank"]) for x in dealt.collect()} == one
    monkeypatch.setattr(R, "FEW_ROWS", 0)
    assert {(x.query_id, x.id, x["rank"]) for x in R.bm25_batch(docs, queries, 5).collect()} == one
    gone = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    left = X.TextIndex.of(docs).delete(gone).delete(gone.limit(1)).upsert(docs.where("doc_id = 3"))
    want = R.bm25_batch(docs.where("doc_id % 3 <> 0 OR doc_id = 3"), queries, 5)
    assert {(x.query_id, x.id, x["rank"]) for x in left.search(queries, 5).collect()} == {(x.query_id, x.id, x["rank"]) for x in want.collect()}
    assert R.bm25_batch(docs.limit(0), queries).count() == 0


def test_a_project_is_parsed_once(spark):
    files = spark.createDataFrame([("src/a.py", "def f():\n    return g()\n\ndef g():\n    pass\n"), ("src/b.py", "def h():\n    f()\n")], "path string, text string")
    found = P.loaded(files)
    assert "MapInPandas" not in found["references"]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.from_id, r.to_id) for r in found["references"].where("type = 'calls'").collect()} == {("src/a.py#f#1", "src/a.py#g#4"), ("src/b.py#h#1", "src/a.py#f#1")}


def test_link_diff_of_sets(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_ROWS", 4)
    links = lambda *rows: spark.createDataFrame(rows, "source long, target long, relation string")
    old = links((1, 1, "a"), (1, 1, "a"), (2, 2, "a"), (3, None, "a"), (4, None, "a"), (4, None, "a"))
    new = links((2, 2, "a"), (2, 2, "a"), (2, 2, "b"), (2, 2, "b"), (3, None, "a"))
    got = Y.link_diff(old, new)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, 1, "a", "removed"), (4, None, "a", "removed"), (2, 2, "b", "added")]))
    assert got.rdd.getNumPartitions() == 3 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_deleted_edges_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_ROWS", 10)
    e = spark.createDataFrame([(i % 7, i % 5, "A") for i in range(70)] + [(None, 1, "A")], "from_id long, to_id long, type string")
    left = G.delete_edges(e, e.where("from_id = 3").distinct())
    assert left.rdd.getNumPartitions() == 8 and left.where("from_id IS NULL").count() == 1
    assert sorted((r.from_id, r.to_id) for r in left.where("from_id IS NOT NULL").collect()) == sorted((i % 7, i % 5) for i in range(70) if i % 7 != 3)


def test_edges_of_components_shrink(spark, monkeypatch):
    """Against union-find, with loops, repeats, unknown nodes and nulls; of 900 edges between 60 nodes 29 are left after the first round."""
    r, kept, plain = random.Random(3), [], G.checkpointed

    def counted(df):
        out = plain(df)
        if set(out.columns) == {"a", "b"}:
            kept.append(out.count())
        return out

    monkeypatch.setattr(G, "checkpointed", counted)
    labels = lambda e, n: {x.id: x.component for x in G.components(spark.createDataFrame(e, "from_id long, to_id long"), spark.createDataFrame([(i,) for i in n], "id long")).collect()}
    assert labels([(i, 100 + j) for i in range(30) for j in range(30)], [*range(30), *range(100, 130)]) == {i: 0 for i in (*range(30), *range(100, 130))}
    assert kept == [29, 0]
    known = set(range(0, 300)) - {7, 11}
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5), (7, 8), (7, 9), (7, 7), (None, 3), (11, 500), (500, 12)]
    up = {i: i for i in known}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a in known and b in known:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert labels(edges, known) == {i: root(i) for i in known}


def test_all_hits_of_a_search_are_not_ranked_in_one_task(spark, monkeypatch):
    """Words of any script, a repeated word, and blank queries; no window over one query's hits."""
    monkeypatch.setattr(R, "scored_terms", None)
    entities = spark.createDataFrame([(str(i), "note", "", "", t) for i, t in enumerate(["知识图谱 与 异步编程", "alpha beta beta", "gamma alpha", None])], "id string, type string, abstract string, overview string, content string")
    atoms = spark.createDataFrame([], "entity_id string, local_id string, type string, name string, content string")
    ids = lambda query: [r.id for r in X.routed(entities, atoms, query, "keyword").orderBy("rank").collect()]
    assert ids("异步编程") == ["0"] and ids("beta beta alpha") == ["1", "2"] and ids("") == []
