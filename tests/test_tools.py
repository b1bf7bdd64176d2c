"""Numbers in an order, path patterns, keywords, procedures, health check and sync on small inputs."""

import random

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import numbering as N
from tessera.operators import project as P
from tessera.operators import quality as Q
from tessera.operators import retrieval as R
from tessera.operators import sop
from tessera.operators import sync as Y


def test_numbers_are_those_of_a_sort(spark):
    r = random.Random(3)
    items = [(r.choice([None, 1, 1, 1, 5]), i) for i in range(5000)]
    df = spark.createDataFrame(items, "k int, i int").repartition(7)
    got = [(x.k, x.i) for x in sorted(N.numbered(df, "k", "i").collect(), key=lambda x: x.n)]
    assert got == sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    b = {x.batch: [i.i for i in x["items"]] for x in N.batches(df, ["i"], 300).collect()}
    assert sorted(b) == list(range(1, 18)) and [i for k in sorted(b) for i in b[k]] == list(range(5000))
    assert N.numbered(df.limit(0), "k", "i").count() == 0 and N.batches(df.limit(0), ["i"]).count() == 0


def test_patterns(spark):
    patterns = spark.createDataFrame([(1, "@/*", "src/*"), (2, "@lib", "packages/lib"), (3, "@lib/ui/*", "never/*"), (0, "@app/deep/*", "app/deep/src/*"), (5, "@app/*", "app/*")], "n int, alias string, target string")
    modules = ["@/a/b", "@lib", "@lib/ui/x", "@libs/x", "@app/deep/y", "@app/z", "@app", "./c", "react", "@/"]
    imports = spark.createDataFrame([("src/m.ts", m) for m in modules + ["@lib"]] + [("src/m.ts", None)], "from_path string, module string")
    got = {r.module: r.target for r in P.aliased_by(imports, patterns).collect()}
    assert got == {"@/a/b": "src/a/b", "@lib": "packages/lib", "@lib/ui/x": "packages/lib/ui/x", "@app/deep/y": "app/deep/src/y", "@app/z": "app/z", "@/": "src/"}
    files = spark.createDataFrame([(p,) for p in ("src/a/b.ts", "src/a/b.js", "packages/lib/index.js", "src/c.py")], "path string")
    assert {(r.module, r.to_path) for r in P.resolved_modules(imports, patterns, files).collect()} == {("@/a/b", "src/a/b.js"), ("@lib", "packages/lib/index.js"), ("./c", "src/c.py")}


def test_keywords_and_tags(spark):
    texts = ["**Tags**: A, bee ;C3\n**Type**: Note\n**Project**: my-app x", "plain", None, "**tags**: ,;,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(S.metadata_keywords("t").alias("k")).collect()] == [["bee", "c3", "note", "my-app", "my", "app"], [], [], []]
    tags = spark.createDataFrame([(" a, b ,,c ",), ("",), (None,), (" , ",)], "t string").select(S.normalised_tags("t").alias("k"))
    assert [r.k for r in tags.collect()] == [["a", "b", "c"], [], [], []]


def test_results_with_one_local_id(spark):
    rows = [("q", "e/1", "1", 1), ("q", "f/1", "1", 2), ("q", "g", None, 3), ("q", "g", None, 4), ("q", "1", None, 5), ("r", "f/1", "1", 1)]
    df = spark.createDataFrame(rows, "query string, id string, local_id string, rank int")
    assert [tuple(r) for r in R.distinct_results(df, ["query"]).orderBy("query", "rank").select("query", "id", "rank").collect()] == [("q", "e/1", 1), ("q", "g", 2), ("r", "f/1", 1)]
    one = R.distinct_results(df.where("query = 'q'").drop("query"))
    assert [(r.id, r.rank) for r in one.orderBy("rank").collect()] == [("e/1", 1), ("g", 2)]


def test_procedures(spark):
    text = "name: {}\ndescription: 'does it'  # now\ncategory: ops\nsteps:\n  - action: verify\n    name: inner\n"
    files = spark.createDataFrame([("1", text.format('"Zeta"')), ("2", text.format("alpha").replace("category: ops\n", "")), ("3", "steps:\n  - name: none\n"), ("4", None), ("5", text.format("Beta"))], "path string, text string")
    runs = spark.sql("SELECT 'alpha' AS name, TIMESTAMP '2024-01-01' AS at UNION ALL SELECT 'alpha', TIMESTAMP '2024-02-01'")
    got = sop.listed(files, runs).orderBy("position").collect()
    assert [(r.name, r.description, r.category, r.last_run and r.last_run.month) for r in got] == [("alpha", "does it", "general", 2), ("Beta", "does it", "ops", None), ("Zeta", "does it", "ops", None)]
    assert [r.name for r in sop.listed(files, category="ops").orderBy("position").collect()] == ["Beta", "Zeta"]
    steps = [(1, 1, "a", "success", None, 5, 2, None), (1, 2, "b", "failed", None, 1, None, "no"), (1, 3, "c", "success", None, 9, None, None), (2, 1, "a", "failed", "continue", 1, None, None), (2, 2, "b", "success", None, 1, 0, None)]
    r = {x.run: x for x in sop.reports(spark.createDataFrame(steps, "run int, n int, action string, status string, on_failure string, duration_ms int, affected int, error string"), ["run"]).collect()}
    assert (r[1].executed, r[1].success, r[1].failed, r[1].duration_ms) == (2, 1, 1, 6) and (r[2].executed, r[2].failed) == (2, 1)
    assert r[1].report == "**Steps**: 2 executed, 1 success, 1 failed\n\n### a\n- Status: success\n- Duration: 5ms\n- Affected: 2\n\n### b\n- Status: failed\n- Duration: 1ms\n- Error: no"


def test_health_check(spark):
    n = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    e = spark.createDataFrame([("0", "1", "calls", 0.5)], "from_id string, to_id string, type string, weight double")
    h = Q.health_check(n, e, F.lit(1.0)).first()
    assert {w.type: w.message for w in h.warnings} == {"health_score": "Health score 50 is below threshold 80", "orphan_rate": "Orphan rate 80.0% exceeds threshold 20.0% (8 isolated entities)"}
    assert Q.health_check(n, e, F.lit(1.0), least_health=1, most_orphans=0.9).first().warnings == []
    assert {w.type for w in Q.health_check(n.limit(0), e.limit(0)).first().warnings} == {"health_score", "network_density"}


def test_sync_runs(spark):
    df = lambda rows, *c: spark.createDataFrame(rows, ", ".join(f"{x} string" for x in c))
    local, server = df([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "source_id", "hash"), df([("a", "1"), ("b", "x"), ("z", "9")], "source_id", "hash")
    files, took = df([("a",), ("b",), ("c",)], "source_id"), df([("b",), ("b",)], "source_id")
    got = {r.source_id: r.status for r in Y.synced_incrementally(local, server, files, took).collect()}
    assert got == {"a": "unchanged", "b": "uploaded", "c": "failed", "d": "skipped", "z": "to_delete"}
    dry = Y.synced_incrementally(local, server)
    assert {r.source_id: r.status for r in dry.collect()} == {"a": "unchanged", "b": "pending", "c": "pending", "d": "pending", "z": "to_delete"}
    s = Y.sync_summary(dry).first()
    assert (s.pending, s.to_delete, s.unchanged, s.up_to_date) == (3, 1, 1, False) and Y.sync_summary(Y.synced_incrementally(local, local)).first().up_to_date
