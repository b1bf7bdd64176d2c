"""Cases with typed-in rows and typed-in answers, for the operators' rules at their edges. The answers are SQL, which DuckDB evaluates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import code as C
from tessera.operators import evaluate as V
from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.operators import quality as Q
from tessera.operators import recommend as RC
from tessera.operators import retrieval as R
from tessera.operators import sync as Y
from tessera.plans.registry import Tables, rounded, values

CASES = {}


def query(sql: str):
    def keep(f):
        CASES[f.__name__] = (f, sql)
        return f

    return keep


@query("SELECT * FROM (VALUES ('a', 'l', 's', 'l', 's', 'l' || chr(10) || 's')) AS t(id, local, server, keep_local, keep_server, merge)")
def conflict_policies(t: Tables):
    c = values(t.spark, [("a", "l", "s")], "id string, local string, server string")
    for p in ("keep_local", "keep_server", "merge"):
        c = Y.resolved_conflicts(c, p).withColumnRenamed("resolved", p)
    return c


@query("SELECT * FROM (VALUES ('id', 'a=1,password=[REDACTED],Token=[REDACTED]')) AS t(k, v)")
def redact_map(t: Tables):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("password"), F.lit("x"), F.lit("Token"), F.lit("y"))
    v = F.array_join(F.transform(F.map_entries(S.redacted(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return values(t.spark, [("id",)], "k string").select("k", v.alias("v"))


@query("SELECT * FROM (VALUES ('0 9 * * *', 86400000), ('0 */6 * * *', 21600000), ('*/30 * * * *', 1800000), ('bad', 86400000)) AS t(cron, ms)")
def cron_intervals(t: Tables):
    return values(t.spark, [("0 9 * * *",), ("0 */6 * * *",), ("*/30 * * * *",), ("bad",)], "cron string").select("cron", S.cron_interval_ms("cron").alias("ms"))


@query("SELECT * FROM (VALUES ('git@github.com:o/r.git', '@o/r'), ('https://github.com/o/r2', '@o/r2'), ('x', NULL)) AS t(url, project)")
def git_projects(t: Tables):
    return values(t.spark, [("git@github.com:o/r.git",), ("https://github.com/o/r2",), ("x",)], "url string").select("url", S.project_of_git_url("url").alias("project"))


@query("SELECT * FROM (VALUES ('contains', NULL, 1.0::DOUBLE), ('calls', 'INFERRED', 0.5), ('calls', 'EXTRACTED', 0.7), ('imports_from', NULL, 0.8), ('zz', 'EXTRACTED', 0.5)) AS t(relation, confidence, weight)")
def edge_weights(t: Tables):
    rows = [("contains", None), ("calls", "INFERRED"), ("calls", "EXTRACTED"), ("imports_from", None), ("zz", "EXTRACTED")]
    return values(t.spark, rows, "relation string, confidence string").select("relation", "confidence", S.edge_weight("relation", "confidence").alias("weight"))


@query("SELECT * FROM (VALUES ('fs', 'builtin'), ('node:os', 'builtin'), ('./a', 'internal'), ('react', 'external')) AS t(module, kind)")
def dependency_kinds(t: Tables):
    return values(t.spark, [("fs",), ("node:os",), ("./a",), ("react",)], "module string").select("module", S.dependency_kind("module").alias("kind"))


@query("SELECT * FROM (VALUES ('timeline/2024/03/09/entry_1.md', DATE '2024-03-09'), ('x/y.md', NULL)) AS t(path, day)")
def dates_of_paths(t: Tables):
    return values(t.spark, [("timeline/2024/03/09/entry_1.md",), ("x/y.md",)], "path string").select("path", S.date_of_path("path").alias("day"))


@query("SELECT * FROM (VALUES ('a,b', 'design', 'core')) AS t(tags, type, project)")
def metadata_fields(t: Tables):
    m = values(t.spark, [("x\n**Tags**: A; b\n**Type**: Design\n**Project**: Core \n",)], "text string").select(S.metadata("text").alias("m"))
    return m.select(F.array_join("m.tags", ",").alias("tags"), "m.type", "m.project")


@query("SELECT * FROM (VALUES (90.0::DOUBLE, 0.05::DOUBLE, 0.05::DOUBLE, ''), (90.0, 0.05, 0.3, 'orphan_rate'), (70.0, 0.01, 0.2, 'health_score,network_density'), (80.0, 0.02, 0.21, 'orphan_rate')) AS t(health_score, network_density, orphan_rate, warnings)")
def threshold_warnings(t: Tables):
    v = values(t.spark, [(90.0, 0.05, 0.05), (90.0, 0.05, 0.3), (70.0, 0.01, 0.2), (80.0, 0.02, 0.21)], "health_score double, network_density double, orphan_rate double")
    return v.withColumn("warnings", F.array_join(Q.warnings_of(), ","))


NODES = [("n1", "app.js", "src/app.js", None, 0), ("n2", "main()", "src/app.js", "L10", 0), ("n3", "Widget", "src/app.js", "LL20-40", 1), ("n4", "util.py", "src/util.py", None, 1), ("n5", "help()", "src/util.py", "L3", 1)]


LINKS = [("n1", "n2", "contains", "EXTRACTED"), ("n2", "n5", "calls", "INFERRED"), ("n2", "n3", "calls", None), ("n4", "n5", "contains", "EXTRACTED"), ("n3", "zz", "imports", "EXTRACTED"), ("n3", "n4", "uses", "EXTRACTED")]


def _external(t: Tables):
    return values(t.spark, NODES, "id string, label string, source_file string, source_location string, community int"), values(t.spark, LINKS, "source string, target string, relation string, confidence string")


@query("SELECT * FROM (VALUES ('n2', 'n1', 'main', 'function', 10, NULL), ('n3', 'n1', 'Widget', 'class', 20, 40), ('n5', 'n4', 'help', 'function', 3, NULL)) AS t(atom_id, entity_id, name, type, start_line, end_line)")
def graph_import_atoms(t: Tables):
    return G.imported(*_external(t))[1]


@query("SELECT * FROM (VALUES ('n1', 'n2', 'contains', 1.0::DOUBLE), ('n2', 'n5', 'calls', 0.5), ('n2', 'n3', 'calls', 0.7), ('n4', 'n5', 'contains', 1.0), ('n3', 'n4', 'uses', 0.5)) AS t(from_id, to_id, type, weight)")
def graph_import_references(t: Tables):
    return G.imported(*_external(t))[2]


@query("SELECT * FROM (VALUES ('n3', 'zz', 'imports')) AS t(source, target, relation)")
def graph_import_skipped(t: Tables):
    return G.imported(*_external(t))[3].select("source", "target", "relation")


@query("SELECT * FROM (VALUES ('n1', 'javascript', 'community:0'), ('n4', 'python', 'community:1')) AS t(entity_id, language, tag)")
def graph_import_entities(t: Tables):
    return G.imported(*_external(t))[0].select("entity_id", "language", "tag")


@query("SELECT * FROM (VALUES ('n4', 'n5')) AS t(from_id, to_id)")
def cascade_delete(t: Tables):
    ent, atoms, refs, _ = G.imported(*_external(t))
    return G.cascade_delete(ent, atoms, refs, values(t.spark, [("n1",)], "entity_id string"))[2].select("from_id", "to_id")


@query("SELECT * FROM (VALUES ('f', 'lib.parse', 's2'), ('f', 'x.run', 's1'), ('g', 'run', 's1')) AS t(caller, target, symbol_id)")
def resolved_calls(t: Tables):
    calls = values(t.spark, [("f", "lib.parse"), ("f", "x.run"), ("g", "run"), ("g", "none")], "caller string, target string")
    return G.resolved_calls(calls, values(t.spark, [("run", "s1"), ("lib.parse", "s2"), ("parse", "s3"), ("run", "s9")], "name string, id string"))


@query("SELECT * FROM (VALUES ('b', 'a', 'extends', 0.9::DOUBLE), ('b', 'i', 'implements', 0.8)) AS t(from_id, to_id, type, weight)")
def inheritance(t: Tables):
    rows = [("a", "A", None, []), ("b", "B", "A", ["I", "J"]), ("i", "I", None, [])]
    return G.inheritance(values(t.spark, rows, "id string, name string, super_class string, implements array<string>"))


@query("SELECT * FROM (VALUES ('src/a.js', './b', 'src/b.js'), ('src/x/c.js', '../b.js', 'src/b.js'), ('src/a.js', './d', 'src/d/index.js')) AS t(from_path, module, to_path)")
def resolved_imports(t: Tables):
    imp = values(t.spark, [("src/a.js", "./b"), ("src/x/c.js", "../b.js"), ("src/a.js", "./d"), ("src/a.js", "react"), ("src/a.js", "./zz")], "from_path string, module string")
    return G.resolved_imports(imp, values(t.spark, [("src/b.js",), ("src/b.ts",), ("src/d/index.js",)], "path string"))


@query("SELECT * FROM (VALUES (0.9::DOUBLE, 'auto'), (0.85, 'auto'), (0.8, 'review'), (0.75, 'review'), (0.7, 'ignored')) AS t(similarity, route)")
def dual_threshold_cases(t: Tables):
    v = values(t.spark, [(0.9,), (0.85,), (0.8,), (0.75,), (0.7,)], "similarity double")
    return v.withColumn("route", RC.recommendation_class("similarity"))


@query("SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (1.0, 1.0, 1.0), (0.5, 2.0, 0.85), (-3.0, 0.0, 0.3)) AS t(frequency, strength, weight)")
def modelled_weights(t: Tables):
    v = values(t.spark, [(0.0, 0.0), (1.0, 1.0), (0.5, 2.0), (-3.0, 0.0)], "frequency double, strength double")
    return v.withColumn("weight", F.round(G.modelled_weight("frequency", "strength"), 6))


@query("SELECT * FROM (VALUES ('log()', 'L206', 'function', 206, NULL), ('WrapperClient', 'LL206-230', 'class', 206, 230), ('x', 'invalid', 'function', NULL, NULL)) AS t(label, loc, type, s, e)")
def node_parsing(t: Tables):
    v = values(t.spark, [("log()", "L206"), ("WrapperClient", "LL206-230"), ("x", "invalid")], "label string, loc string")
    return v.select("label", "loc", S.atom_type("label").alias("type"), S.start_line("loc").alias("s"), S.end_line("loc").alias("e"))


@query("SELECT * FROM (VALUES ('health_score', 85.0::DOUBLE, 85.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, true), ('search_latency', 200.0, 200.0, 0.0, 50.0, true), ('entity_count', 150.0, 200.0, 50.0, 75.0, false), ('isolated_entities', 4.0, 0.0, -4.0, 0.0, false), ('search_latency', 300.0, 200.0, -100.0, 25.0, false)) AS t(metric, value, target, gap, progress, on_target)")
def target_gap(t: Tables):
    rows = [("health_score", 85.0), ("search_latency", 200.0), ("entity_count", 150.0), ("isolated_entities", 4.0), ("search_latency", 300.0)]
    return Q.against_targets(values(t.spark, rows, "metric string, value double"))


@query("SELECT * FROM (VALUES (50.0::DOUBLE, 85.0::DOUBLE, 2.0::DOUBLE, 18), (50.0, 85.0, 0.0, NULL), (50.0, 85.0, -1.0, NULL), (85.0, 85.0, 1.0, 0)) AS t(value, target, per_day, days)")
def days_to_target(t: Tables):
    v = values(t.spark, [(50.0, 85.0, 2.0), (50.0, 85.0, 0.0), (50.0, 85.0, -1.0), (85.0, 85.0, 1.0)], "value double, target double, per_day double")
    return v.withColumn("days", Q.days_to_target(F.col("value"), F.col("target"), F.col("per_day")))


@query("SELECT * FROM (VALUES (4.0::DOUBLE, 0, 0, 'A'), (4.0, 1, 0, 'B'), (11.0, 9, 9, 'C'), (12.0, 0, 0, 'D')) AS t(avg, risky, large, grade)")
def project_grade(t: Tables):
    v = values(t.spark, [(4.0, 0, 0), (4.0, 1, 0), (11.0, 9, 9), (12.0, 0, 0)], "avg double, risky int, large int")
    return v.withColumn("grade", Q.project_grade("avg", "risky", "large"))


SOURCES = [
    ("src/app.py", "import os\nfrom .util import help\n\nclass App(Base):\n    def run(self, x):\n        for i in x:\n            if i and x:\n                help(i)\n        return os.path.join('a')\n"),
    ("src/util.js", "import { a } from './a';\nclass W extends Base implements I {\n  go(x) {\n    if (x && a) { log(x); }\n    console.log(x);\n  }\n}\nfunction help(n) { return n ? go(n) : 0; }\n"),
    ("src/bad.py", "def broken(:\n"),
]


def _analysis(t: Tables):
    return C.analysed(values(t.spark, SOURCES, "path string, text string"))


@query("SELECT * FROM (VALUES ('src/app.py', 'App', 'class', 4, 1, 0), ('src/app.py', 'run', 'function', 5, 4, 2), ('src/util.js', 'W', 'class', 2, 1, 2), ('src/util.js', 'go', 'function', 3, 3, 1), ('src/util.js', 'help', 'function', 8, 2, 0)) AS t(path, name, kind, start_line, complexity, nesting)")
def code_symbols(t: Tables):
    return C.symbols(_analysis(t)).select("path", "name", "kind", "start_line", "complexity", "nesting")


@query("SELECT * FROM (VALUES ('src/app.py', 'run', 'help', 8), ('src/app.py', 'run', 'os.path.join', 9), ('src/util.js', 'go', 'log', 4), ('src/util.js', 'help', 'go', 8)) AS t(path, caller, target, line)")
def code_calls(t: Tables):
    return C.calls(_analysis(t))


@query("SELECT * FROM (VALUES ('src/app.py', 'os', 'builtin'), ('src/app.py', '.util', 'internal'), ('src/util.js', './a', 'internal')) AS t(from_path, module, kind)")
def code_imports(t: Tables):
    return C.imports(_analysis(t))


@query("SELECT * FROM (VALUES ('src/app.py', 4, 4, 2.0::DOUBLE, 2, 1), ('src/util.js', 3, 3, 0.5, 1, 2)) AS t(path, cyclomatic, max_function_complexity, avg_nesting, max_nesting_depth, functions)")
def code_complexity(t: Tables):
    return C.rollup(_analysis(t))


@query("SELECT * FROM (VALUES ('a.go', 'function', 'Run'), ('a.go', 'class', 'T'), ('b.rs', 'function', 'go'), ('b.rs', 'import', 'std::io'), ('C.java', 'class', 'C'), ('C.java', 'function', 'main')) AS t(path, capture, name)")
def code_captures(t: Tables):
    rows = [("a.go", "type T struct {}\nfunc (t T) Run() {}"), ("b.rs", "use std::io;\npub fn go() {}"), ("C.java", "class C {\n  public static void main(String[] a) {}\n}"), ("x.txt", "def f")]
    return C.captured(values(t.spark, rows, "path string, text string"))


@query("SELECT 'Adds two numbers.' AS description, 'a,b' AS params, 'the sum' AS returns")
def code_docs(t: Tables):
    v = values(t.spark, [("/**\n * Adds two\n * numbers.\n * @param {number} a first\n * @param b\n * @returns {number} the sum\n */\nfunction add(a, b) {}",)], "text string")
    return v.select(C.jsdoc("text").alias("d")).select("d.description", F.array_join("d.params", ",").alias("params"), "d.returns")


@query("SELECT 1 AS isolated, 1 AS weak, 2 AS missing, 1 AS duplicates")
def sop_steps(t: Tables):
    from tessera.operators import sop

    n = values(t.spark, [("a", "x"), ("b", "x"), ("c", "")], "id string, abstract string")
    e = values(t.spark, [("a", "b", "calls", 0.4)], "from_id string, to_id string, type string, weight double")
    cols = [sop.ACTIONS[a](n, e).select(F.col("found").cast("int").alias(k)) for a, k in (("detect_isolated", "isolated"), ("detect_low_weight", "weak"), ("detect_missing_relations", "missing"), ("detect_duplicates", "duplicates"))]
    out = cols[0]
    for c in cols[1:]:
        out = out.join(c)
    return out


@query("SELECT * FROM (VALUES ('知识图谱', '知识 识图 图谱'), ('异步编程与错误处理 ok go', 'ok go 错误处理 异步编程'), ('a', ''), ('学', ''), ('Vue 组件化开发 x1', 'vue x1 组件化 开发')) AS t(text, tokens)")
def tokenize_bm25_cjk(t: Tables):
    rows = [("知识图谱",), ("异步编程与错误处理 ok go",), ("a",), ("学",), ("Vue 组件化开发 x1",)]
    return values(t.spark, rows, "text string").select("text", F.array_join(S.bm25_tokens("text"), " ").alias("tokens"))


@query("SELECT * FROM (VALUES ('abcd', 1, 1), ('abcde', 2, 2), ('a', 1, 1), ('hello world', 3, 3), ('Hello 世界', 5, 3), ('你好世界测试', 9, 3), ('', 0, 0)) AS t(text, v1, v2)")
def estimate_tokens_cases(t: Tables):
    rows = [(x,) for x in ("abcd", "abcde", "a", "hello world", "Hello 世界", "你好世界测试", "")]
    return values(t.spark, rows, "text string").select("text", S.estimate_tokens("text").cast("int").alias("v1"), S.estimate_tokens_by_code_point("text").cast("int").alias("v2"))


@query("""SELECT * FROM (VALUES ('promise', 'hybrid', 'promise Promise async await then catch'), ('git log', 'hybrid', 'git log Git GitFlow GitHub Flow 分支 merge'), ('git log', 'keyword', 'git log'),
  ('one two three', 'hybrid', 'one two three'), ('异步 async', 'hybrid', 'async 异 步'), ('错误', 'keyword', '错 误'), ('promise', 'vector', 'promise'), ('zebra', 'hybrid', 'zebra')) AS t(query, mode, rewritten)""")
def query_rewrite(t: Tables):
    rows = [("promise", "hybrid"), ("git log", "hybrid"), ("git log", "keyword"), ("one two three", "hybrid"), ("异步 async", "hybrid"), ("错误", "keyword"), ("promise", "vector"), ("zebra", "hybrid")]
    return values(t.spark, rows, "query string, mode string").select("query", "mode", S.rewritten_query("query", "mode").alias("rewritten"))


@query("SELECT * FROM (VALUES ('setup function basics', 2, 0.0::DOUBLE, 0.35::DOUBLE), ('other', 1, 20.0, 0.7), ('setup', 4, 5.0, 0.475), ('function setup', 1, 10.0, 1.0)) AS t(name, heading_level, bm25, relevance)")
def atom_relevance(t: Tables):
    rows = [("setup function basics", 2, 0.0), ("other", 1, 20.0), ("setup", 4, 5.0), ("function setup", 1, 10.0)]
    v = values(t.spark, rows, "name string, heading_level int, bm25 double")
    return v.select("name", "heading_level", "bm25", F.round(R.relevance("bm25", "name", "setup function", "heading_level"), 6).alias("relevance"))


@query("SELECT 0.333333::DOUBLE AS precision, 0.5::DOUBLE AS recall, 0.4::DOUBLE AS f1, 0.386853::DOUBLE AS ndcg, 0.5::DOUBLE AS mrr")
def ir_metrics_case(t: Tables):
    res = values(t.spark, [(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "b", 4)], "query_id int, id string, rank int")
    rel = values(t.spark, [(1, "b"), (1, "d")], "query_id int, id string")
    return rounded(V.ir_metrics(res, rel, 3).drop("query_id"), "precision", "recall", "f1", "ndcg", "mrr")


@query("SELECT * FROM (VALUES ('a'), ('d')) AS t(local_id)")
def tree_level_filter_hides(t: Tables):
    """A child of a row at the level is hidden although its own level qualifies; a root above the level goes."""
    rows = [("a", None, "A", 2), ("b", "a", "B", 1), ("c", None, "C", 3), ("d", None, "D", 1), ("e", "d", "E", 3)]
    return H.level_filter(values(t.spark, rows, "local_id string, parent_id string, name string, heading_level int"), 2).select("local_id")


@query("SELECT * FROM (VALUES ('s'), ('x'), ('y'), ('z')) AS t(local_id)")
def cycle_check(t: Tables):
    rows = [("s", "s"), ("x", "y"), ("y", "x"), ("z", "y"), ("r", None), ("q", "r"), ("o", "gone")]
    return H.cyclic(values(t.spark, rows, "local_id string, parent_id string"))


@query("SELECT * FROM (VALUES ('a', NULL, 'A2'), ('d', 'a', 'D')) AS t(local_id, parent_id, name)")
def batch_operations(t: Tables):
    atoms = values(t.spark, [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "local_id string, parent_id string, name string")
    ops = values(t.spark, [(1, "update", "a", None, "A1"), (2, "update", "a", None, "A2"), (3, "add", "d", "a", "D"), (4, "remove", "b", None, None)], "seq int, op string, local_id string, parent_id string, name string")
    return H.applied_operations(atoms, ops)


@query("SELECT 'e' AS entity_id, 0.833::DOUBLE AS coverage, 0.5::DOUBLE AS consistency, 0.5::DOUBLE AS link_validity, 0.75::DOUBLE AS hierarchy, 0.65::DOUBLE AS overall")
def faithfulness_case(t: Tables):
    atoms = values(t.spark, [("e", "a", None, "alpha", "alpha beta [[b]]", 1), ("e", "b", "a", "gamma", "beta delta [[zz]]", 1)], "entity_id string, local_id string, parent_id string, name string, content string, heading_level int")
    ent = values(t.spark, [("e", "alpha beta zz", "alpha")], "entity_id string, content string, abstract string")
    return H.faithfulness(atoms, ent)
