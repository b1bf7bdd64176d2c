"""Queries that put the operators' rules to rows derived from the tables: parsers, weights, grades, imports, resolution, code analysis."""

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
from tessera.operators import sop
from tessera.operators import sync as Y
from tessera.plans.registry import EDGE, NODE, Tables, query, rounded


@query("SELECT c_custkey AS id, c_mktsegment AS keep_local, c_name AS keep_server, c_mktsegment || chr(10) || c_name AS merge FROM customer")
def conflict_policies(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("local"), F.col("c_name").alias("server"))
    for p in ("keep_local", "keep_server", "merge"):
        c = Y.resolved_conflicts(c, p).withColumnRenamed("resolved", p)
    return c.drop("local", "server")


@query("SELECT c_custkey AS id, 'name=' || c_name || ',Password=[REDACTED],api_key=[REDACTED],token=[REDACTED],segment=' || c_mktsegment AS fields FROM customer")
def redact_map(t: Tables):
    pairs = [x for k, c in (("name", "c_name"), ("Password", "c_name"), ("api_key", "c_mktsegment"), ("token", "c_name"), ("segment", "c_mktsegment")) for x in (F.lit(k), F.col(c))]
    shown = F.transform(F.map_entries(S.redacted(F.create_map(*pairs))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.customer.select(F.col("c_custkey").alias("id"), F.array_join(shown, ",").alias("fields"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 86400000 WHEN 1 THEN (doc_id % 23 + 1) * 3600000 WHEN 2 THEN (doc_id % 59 + 1) * 60000 ELSE 86400000 END AS ms FROM documents""")
def cron_intervals(t: Tables):
    cron = F.expr("CASE doc_id % 4 WHEN 0 THEN '0 9 * * *' WHEN 1 THEN concat('0 */', doc_id % 23 + 1, ' * * *') WHEN 2 THEN concat('*/', doc_id % 59 + 1, ' * * * *') ELSE lang END")
    return t.documents.select("doc_id", S.cron_interval_ms(cron).alias("ms"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '@' || source || '/r' || doc_id END AS project FROM documents")
def git_projects(t: Tables):
    url = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('git@github.com:', source, '/r', doc_id, '.git') WHEN 1 THEN concat('https://github.com/', source, '/r', doc_id) ELSE concat('folder ', source) END")
    return t.documents.select("doc_id", S.project_of_git_url(url).alias("project"))


RELATION = "CASE l_returnflag WHEN 'A' THEN 'contains' WHEN 'N' THEN 'calls' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'imports_from' ELSE 'unknown_kind' END END"
CONFIDENCE = "CASE WHEN l_linestatus = 'F' THEN 'INFERRED' WHEN l_linenumber = 1 THEN NULL ELSE 'EXTRACTED' END"
WEIGHT = f"CASE WHEN {RELATION} = 'unknown_kind' THEN 0.5 WHEN {CONFIDENCE} = 'INFERRED' THEN CASE {RELATION} WHEN 'calls' THEN 0.5 ELSE -1 END WHEN {RELATION} = 'contains' THEN 1.0 WHEN {RELATION} = 'calls' THEN 0.7 ELSE 0.8 END"


@query(f"SELECT relation, confidence, weight, count(*) AS n FROM (SELECT {RELATION} AS relation, {CONFIDENCE} AS confidence, CAST({WEIGHT} AS DOUBLE) AS weight FROM lineitem) x WHERE weight >= 0 GROUP BY 1, 2, 3")
def edge_weights(t: Tables):
    """Inferred links other than calls have weights of their own, which goldens cover."""
    x = t.lineitem.select(F.expr(RELATION).alias("relation"), F.expr(CONFIDENCE).alias("confidence")).where("NOT (confidence <=> 'INFERRED' AND relation IN ('contains', 'imports_from'))")
    return x.withColumn("weight", S.edge_weight("relation", "confidence")).groupBy("relation", "confidence", "weight").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'builtin' WHEN 1 THEN 'builtin' WHEN 2 THEN 'internal' WHEN 3 THEN 'external' WHEN 4 THEN 'builtin' ELSE 'internal' END AS kind FROM documents")
def dependency_kinds(t: Tables):
    module = F.expr("CASE doc_id % 6 WHEN 0 THEN 'fs' WHEN 1 THEN concat('node:', lang) WHEN 2 THEN concat('./', source) WHEN 3 THEN concat('pkg-', source) WHEN 4 THEN 'os' ELSE concat('/', lang) END")
    return t.documents.select("doc_id", S.dependency_kind(module).alias("kind"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'builtin' WHEN 1 THEN 'builtin' WHEN 2 THEN 'internal' WHEN 3 THEN 'builtin' ELSE 'external' END AS kind FROM documents""")
def dependency_kinds_by_language(t: Tables):
    lang = F.expr("CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE 'java' END")
    module = F.expr("CASE doc_id % 5 WHEN 0 THEN 'os.path' WHEN 1 THEN 'net/http' WHEN 2 THEN concat('github.com/', source, '/x') WHEN 3 THEN 'std::io' ELSE concat('org.', source) END")
    return t.documents.select("doc_id", S.dependency_kind(module, lang).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS day FROM events")
def dates_of_paths(t: Tables):
    path = F.when(F.col("event_id") % 4 < 3, F.concat(F.lit("timeline/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/entry_1.md"))).otherwise("notes/2024.md")
    return t.events.select("event_id", S.date_of_path(path).alias("day"))


@query("SELECT doc_id, source || ',' || lang AS tags, 'design' AS type, lower(source) AS project FROM documents")
def metadata_fields(t: Tables):
    text = F.format_string("x\n**Tags**: %s; %s\n**Type**: Design\n**Project**: %s \n", F.initcap("source"), F.upper("lang"), F.upper("source"))
    d = t.documents.select("doc_id", S.metadata(text).alias("m"))
    return d.select("doc_id", F.array_join("m.tags", ",").alias("tags"), "m.type", "m.project")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 101 < 80 THEN 'health_score' END, CASE WHEN doc_id % 50 / 1000.0 < 0.02 THEN 'network_density' END, CASE WHEN doc_id % 40 / 100.0 > 0.2 THEN 'orphan_rate' END) AS warnings FROM documents""")
def threshold_warnings(t: Tables):
    m = t.documents.selectExpr("doc_id", "n_chars % 101 AS health_score", "doc_id % 50 / 1000.0D AS network_density", "doc_id % 40 / 100.0D AS orphan_rate")
    return m.select("doc_id", F.array_join(Q.warnings_of(), ",").alias("warnings"))


# An external graph from the tables: suppliers are files, parts are symbols of the file of their number, line items are links.
FILE = "'src/f' || s_suppkey || CASE s_suppkey % 2 WHEN 0 THEN '.js' ELSE '.py' END"
OWNER = "(p_partkey % (SELECT count(*) FROM supplier))"
LABEL = "CASE p_partkey % 3 WHEN 0 THEN 'Class' || p_partkey ELSE 'f' || p_partkey || '()' END"
LINK = "SELECT DISTINCT 'S' || l_suppkey AS source, 'P' || (l_partkey + CASE WHEN l_partkey % 50 = 0 THEN 10000000 ELSE 0 END) AS target, CASE l_returnflag WHEN 'A' THEN 'contains' ELSE 'calls' END AS relation FROM lineitem"


def _external(t: Tables):
    n = t.supplier.count()
    files = t.supplier.selectExpr("concat('S', s_suppkey) AS id", "concat('f', s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN '.js' ELSE '.py' END) AS label", "concat('src/f', s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN '.js' ELSE '.py' END) AS source_file", "CAST(NULL AS STRING) AS source_location", "s_nationkey AS community")
    symbols = t.part.selectExpr(
        "concat('P', p_partkey) AS id", "CASE p_partkey % 3 WHEN 0 THEN concat('Class', p_partkey) ELSE concat('f', p_partkey, '()') END AS label", f"concat('src/f', p_partkey % {n}, CASE p_partkey % {n} % 2 WHEN 0 THEN '.js' ELSE '.py' END) AS source_file",
        "CASE WHEN p_partkey % 2 = 0 THEN concat('L', p_size) ELSE concat('LL', p_size, '-', p_size + 7) END AS source_location", "p_size AS community",
    )
    links = t.lineitem.selectExpr("concat('S', l_suppkey) AS source", "concat('P', l_partkey + CASE WHEN l_partkey % 50 = 0 THEN 10000000 ELSE 0 END) AS target", "CASE l_returnflag WHEN 'A' THEN 'contains' ELSE 'calls' END AS relation", "CAST(NULL AS STRING) AS confidence").distinct()
    return files.unionByName(symbols), links


ATOMS = f"""SELECT 'P' || p_partkey AS atom_id, 'S' || {OWNER} AS entity_id, CASE p_partkey % 3 WHEN 0 THEN 'Class' ELSE 'f' END || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'class' ELSE 'function' END AS type,
  p_size AS start_line, CASE WHEN p_partkey % 2 = 1 THEN p_size + 7 END AS end_line FROM part"""


@query(ATOMS)
def graph_import_atoms(t: Tables):
    return G.imported(*_external(t))[1]


@query(f"SELECT source AS from_id, target AS to_id, relation AS type, CASE relation WHEN 'contains' THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM ({LINK}) l WHERE target IN (SELECT 'P' || p_partkey FROM part)")
def graph_import_references(t: Tables):
    return G.imported(*_external(t))[2]


@query(f"SELECT source, target, relation FROM ({LINK}) l WHERE target NOT IN (SELECT 'P' || p_partkey FROM part)")
def graph_import_skipped(t: Tables):
    return G.imported(*_external(t))[3].select("source", "target", "relation")


@query("SELECT 'S' || s_suppkey AS entity_id, CASE s_suppkey % 2 WHEN 0 THEN 'javascript' ELSE 'python' END AS language, 'community:' || s_nationkey AS tag FROM supplier")
def graph_import_entities(t: Tables):
    return G.imported(*_external(t))[0].select("entity_id", "language", "tag")


@query(f"SELECT relation AS type, count(*) AS n FROM ({LINK}) l WHERE target IN (SELECT 'P' || p_partkey FROM part) GROUP BY 1")
def import_relation_counts(t: Tables):
    return G.imported(*_external(t))[2].groupBy("type").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT source AS from_id, target AS to_id FROM ({LINK}) l JOIN ({ATOMS}) a ON l.target = a.atom_id WHERE CAST(substr(source, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(a.entity_id, 2) AS BIGINT) % 3 <> 0""")
def cascade_delete(t: Tables):
    ent, atoms, refs, _ = G.imported(*_external(t))
    gone = t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    return G.cascade_delete(ent, atoms, refs, gone)[2].select("from_id", "to_id").distinct()


@query("""WITH s AS (SELECT p_name AS name, min('P' || p_partkey) AS id FROM part GROUP BY 1), c AS (SELECT DISTINCT 'L' || l_orderkey AS caller, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN 'lib.' || p_name ELSE 'lib.none' END AS target, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT DISTINCT caller, target, s.id AS symbol_id FROM c JOIN s ON c.p_name = s.name WHERE target <> 'lib.none'""")
def resolved_calls(t: Tables):
    calls = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("concat('L', l_orderkey) AS caller", "CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN concat('lib.', p_name) ELSE 'lib.none' END AS target").distinct()
    return G.resolved_calls(calls, t.part.select(F.col("p_name").alias("name"), F.concat(F.lit("P"), "p_partkey").alias("id")))


@query("""WITH c AS (SELECT c_custkey AS id, 'C' || c_custkey AS name, c_custkey // 3 AS up, c_custkey // 5 AS i FROM customer)
  SELECT id AS from_id, up AS to_id, 'extends' AS type, 0.9::DOUBLE AS weight FROM c WHERE id % 2 = 0 UNION ALL SELECT id, i, 'implements', 0.8 FROM c WHERE id % 7 = 0""")
def inheritance(t: Tables):
    c = t.customer.selectExpr(
        "c_custkey AS id", "concat('C', c_custkey) AS name", "CASE WHEN c_custkey % 2 = 0 THEN concat('C', c_custkey DIV 3) ELSE 'Elsewhere' END AS super_class",
        "CASE WHEN c_custkey % 7 = 0 THEN array(concat('C', c_custkey DIV 5), 'Nowhere') ELSE CAST(array() AS ARRAY<STRING>) END AS implements",
    )
    return G.inheritance(c)


IMPORTER = "'src/' || lang || '/' || source || '/m' || doc_id || '.js'"


@query(f"""WITH d AS (SELECT DISTINCT doc_id, lang, source, {IMPORTER} AS from_path FROM documents)
  SELECT from_path, './index' AS module, 'src/' || lang || '/' || source || CASE WHEN length(source) = 4 THEN '/index.js' ELSE '/index.ts' END AS to_path FROM d
  UNION ALL SELECT from_path, '../' || source, 'src/' || lang || '/' || source || '/index.js' FROM d WHERE length(source) = 4
  UNION ALL SELECT from_path, './m' || (doc_id + 1), 'src/' || lang || '/' || source || '/m' || (doc_id + 1) || '.js' FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id + 1 AND e.lang = d.lang AND e.source = d.source)""")
def resolved_imports(t: Tables):
    """Every folder has an index.ts, and those of sources with one digit an index.js, which counts first."""
    d = t.documents.selectExpr("doc_id", "source", "concat('src/', lang, '/', source) AS folder")
    files = d.selectExpr("concat(folder, '/m', doc_id, '.js') AS path").union(d.selectExpr("concat(folder, '/index.ts')")).union(d.where("length(source) = 4").selectExpr("concat(folder, '/index.js')"))
    imports = d.selectExpr("concat(folder, '/m', doc_id, '.js') AS from_path", "explode(array('./index', concat('../', source), concat('./m', doc_id + 1), 'react', './none')) AS module")
    return G.resolved_imports(imports, files)


@query(f"""WITH d AS (SELECT DISTINCT doc_id, lang, source, {IMPORTER} AS from_path FROM documents),
  r AS (SELECT DISTINCT from_path AS from_id, 'src/' || lang || '/' || source || '/m' || (doc_id + 1) || '.js' AS to_id, doc_id FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id + 1 AND e.lang = d.lang AND e.source = d.source))
  SELECT from_id, to_id, 'depends_on' AS type, 0.8::DOUBLE AS weight FROM r WHERE doc_id % 2 = 0""")
def depends_on(t: Tables):
    """Dependencies between files; those of odd documents are there already."""
    d = t.documents.selectExpr("doc_id", "concat('src/', lang, '/', source) AS folder")
    files = d.selectExpr("concat(folder, '/m', doc_id, '.js') AS path")
    found = G.resolved_imports(d.selectExpr("concat(folder, '/m', doc_id, '.js') AS from_path", "explode(array(concat('./m', doc_id + 1), 'fs', 'react')) AS module"), files)
    old = found.where(F.regexp_extract("from_path", r"m(\d+)\.js$", 1).cast("long") % 2 == 1).select(F.col("from_path").alias("from_id"), F.col("to_path").alias("to_id"), F.lit("depends_on").alias("type"))
    return G.depends_on(found, old)


@query("SELECT vec_id AS id, CASE WHEN (vec_id % 100) / 100.0 >= 0.85 THEN 'auto' WHEN (vec_id % 100) / 100.0 >= 0.75 THEN 'review' ELSE 'ignored' END AS route FROM embeddings")
def recommendation_classes(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 100) / 100.0).alias("similarity")).select("id", RC.recommendation_class("similarity").alias("route"))


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(0.5 + 0.3 * least(l_discount * 12 - 0.2, 1) + 0.2 * least(l_tax * 15, 1), 0.3), 1), 6) AS weight FROM lineitem")
def modelled_weights(t: Tables):
    x = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_discount * 12 - 0.2D AS frequency", "l_tax * 15 AS strength")
    return x.select("l_orderkey", "l_linenumber", F.round(G.modelled_weight("frequency", "strength"), 6).alias("weight"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'class' ELSE 'function' END AS type, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS s, CASE p_partkey % 4 WHEN 1 THEN p_size + 9 END AS e FROM part""")
def node_parsing(t: Tables):
    n = t.part.selectExpr(
        "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('run', p_partkey, '()') WHEN 1 THEN concat('Widget', p_partkey) ELSE concat('value', p_partkey) END AS label",
        "CASE p_partkey % 4 WHEN 0 THEN concat('L', p_size) WHEN 1 THEN concat('LL', p_size, '-', p_size + 9) WHEN 2 THEN 'line 7' END AS loc",
    )
    return n.select("p_partkey", S.atom_type("label").alias("type"), S.start_line("loc").alias("s"), S.end_line("loc").alias("e"))


@query("""SELECT doc_id, 'entity_count' AS metric, n_chars::DOUBLE AS value, 200.0::DOUBLE AS target, 200.0 - n_chars AS gap, floor(greatest(least(n_chars / 200.0 * 100, 100), 0) * 100 + 0.5) / 100 AS progress, n_chars >= 200 AS on_target FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'search_latency', n_chars::DOUBLE, 200.0, 200.0 - n_chars, floor(greatest(least((400 - n_chars) / 400.0 * 100, 100), 0) * 100 + 0.5) / 100, n_chars <= 200 FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'isolated_entities', n_chars::DOUBLE, 0.0, 0.0 - n_chars, CASE WHEN n_chars = 0 THEN 100.0 ELSE 0.0 END, n_chars <= 0 FROM documents WHERE doc_id % 3 = 2""")
def target_gap(t: Tables):
    v = t.documents.selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'entity_count' WHEN 1 THEN 'search_latency' ELSE 'isolated_entities' END AS metric", "CAST(n_chars AS DOUBLE) AS value")
    return Q.against_targets(v, keep=["doc_id"])


@query("SELECT c_custkey, CASE WHEN floor(c_acctbal / 100) = 50 THEN 0 WHEN c_custkey % 5 = 0 THEN NULL WHEN (50 - floor(c_acctbal / 100)) / (c_custkey % 5 - 2.5) > 0 THEN ceil((50 - floor(c_acctbal / 100)) / (c_custkey % 5 - 2.5)) END::BIGINT AS days FROM customer")
def days_to_target(t: Tables):
    per_day = F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_custkey") % 5 - 2.5)
    return t.customer.select("c_custkey", Q.days_to_target(F.floor(F.col("c_acctbal") / 100).cast("double"), F.lit(50.0), per_day).alias("days"))


@query("SELECT o_custkey AS project, CASE WHEN avg < 5 AND risky = 0 AND large = 0 THEN 'A' WHEN avg < 8 AND risky < 5 AND large < 5 THEN 'B' WHEN avg < 12 AND risky < 10 AND large < 10 THEN 'C' ELSE 'D' END AS grade FROM (SELECT o_custkey, avg(o_orderkey % 17) AS avg, count(*) FILTER (WHERE o_orderkey % 17 > 10) AS risky, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1) x")
def project_grade(t: Tables):
    p = t.orders.groupBy(F.col("o_custkey").alias("project")).agg(F.avg(F.col("o_orderkey") % 17).alias("avg"), F.count_if(F.col("o_orderkey") % 17 > 10).alias("risky"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    return p.select("project", Q.project_grade("avg", "risky", "large").alias("grade"))


# A source file for every document: a class and two functions in Python, JavaScript, Go, Rust or Java by number.
KINDS = ["py", "js", "go", "rs", "java"]


def _sources(t: Tables):
    body = {
        "py": "import os\nfrom .m{n} import help\n\nclass C{n}(Base):\n    def run(self, x):\n        for i in x:\n            if i and x:\n                help(i)\n        return os.path.join('a')\n\ndef f{n}(a, b):\n    return C{n}(a)\n",
        "js": "import {{ help }} from './m{n}';\n\nclass C{n} extends Base {{\n  run(x) {{\n    if (x && help) {{ help(x); }}\n    console.log(x);\n  }}\n}}\nfunction f{n}(a, b) {{ return a ? make(b) : 0; }}\n",
        "go": "package m\n\nimport \"net/http\"\n\ntype C{n} struct {{}}\nfunc (c C{n}) run(x int) {{\n  if x > 0 && x < 9 {{\n    help(x)\n  }}\n}}\nfunc f{n}(a int, b int) {{\n  http.Get(a)\n}}\n",
        "rs": "use std::io;\n\npub struct C{n} {{}}\npub fn run(x: i32) {{\n  if x > 0 && x < 9 {{\n    help(x);\n  }}\n}}\nfn f{n}(a: i32, b: i32) {{\n  io::read(a);\n}}\n",
        "java": "import java.util.List;\n\npublic class C{n} extends Base implements I, J {{\n  public void run(int x) {{\n    if (x > 0 && x < 9) {{ help(x); }}\n  }}\n  static int f{n}(int a, int b) {{\n    return make(a);\n  }}\n}}\n",
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.lit(None).cast("string")
    for k, template in body.items():
        parts = template.replace("{{", "{").replace("}}", "}").split("{n}")
        text = F.when(kind == k, F.concat_ws("", *[x for i, p in enumerate(parts) for x in ([F.col("doc_id").cast("string")] if i else []) + [F.lit(p)]])).otherwise(text)
    return t.documents.select(F.concat(F.lit("src/m"), "doc_id", F.lit("."), kind).alias("path"), text.alias("text"))


PATHS = "d AS (SELECT doc_id, doc_id % 5 AS k, 'src/m' || doc_id || '.' || ['py', 'js', 'go', 'rs', 'java'][CAST(doc_id % 5 + 1 AS INTEGER)] AS path FROM documents)"


@query(f"""WITH {PATHS}
  SELECT path, 'C' || doc_id AS name, 'class' AS kind, [4, 3, 5, 3, 3][CAST(k + 1 AS INTEGER)] AS start_line, 1 AS complexity FROM d
  UNION ALL SELECT path, 'run', 'function', [5, 4, 6, 4, 4][CAST(k + 1 AS INTEGER)], CASE k WHEN 0 THEN 4 ELSE 3 END FROM d
  UNION ALL SELECT path, 'f' || doc_id, 'function', [11, 9, 11, 9, 7][CAST(k + 1 AS INTEGER)], CASE k WHEN 1 THEN 2 ELSE 1 END FROM d""")
def code_symbols(t: Tables):
    return C.symbols(C.analysed(_sources(t))).select("path", "name", "kind", "start_line", "complexity")


@query(f"""WITH {PATHS} SELECT path, 'run' AS caller, 'help' AS target, [8, 5, 8, 6, 5][CAST(k + 1 AS INTEGER)] AS line FROM d
  UNION ALL SELECT path, 'run', 'os.path.join', 9 FROM d WHERE k = 0 UNION ALL SELECT path, 'f' || doc_id, ['C' || doc_id, 'make', 'http.Get', 'io::read', 'make'][CAST(k + 1 AS INTEGER)], [12, 9, 12, 10, 8][CAST(k + 1 AS INTEGER)] FROM d""")
def code_calls(t: Tables):
    return C.calls(C.analysed(_sources(t)))


@query(f"""WITH {PATHS} SELECT path AS from_path, ['os', './m' || doc_id, 'net/http', 'std::io', 'java.util.List'][CAST(k + 1 AS INTEGER)] AS module, CASE k WHEN 1 THEN 'internal' ELSE 'builtin' END AS kind FROM d
  UNION ALL SELECT path, '.m' || doc_id, 'internal' FROM d WHERE k = 0""")
def code_imports(t: Tables):
    return C.imports(C.analysed(_sources(t)))


@query(f"WITH {PATHS} SELECT path, CASE k WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 2 END AS cyclomatic, CASE k WHEN 0 THEN 4 ELSE 3 END AS max_function_complexity, 2 AS functions FROM d")
def code_complexity(t: Tables):
    return C.rollup(C.analysed(_sources(t))).select("path", "cyclomatic", "max_function_complexity", "functions")


@query(f"""WITH {PATHS} SELECT target, count(*) AS n FROM (SELECT 'help' AS target FROM d UNION ALL SELECT 'os.path.join' FROM d WHERE k = 0 UNION ALL SELECT ['C' || doc_id, 'make', 'http.Get', 'io::read', 'make'][CAST(k + 1 AS INTEGER)] FROM d) x GROUP BY 1""")
def call_counts(t: Tables):
    return C.calls(C.analysed(_sources(t))).groupBy("target").agg(F.count("*").alias("n"))


@query(f"""WITH {PATHS} SELECT path, 'class' AS capture, 'C' || doc_id AS name FROM d UNION ALL SELECT path, 'function', 'run' FROM d WHERE k <> 1 UNION ALL SELECT path, 'function', 'f' || doc_id FROM d
  UNION ALL SELECT path, 'import', ['os', './m' || doc_id, 'net/http', 'std::io', 'java.util.List'][CAST(k + 1 AS INTEGER)] FROM d UNION ALL SELECT path, 'import', '.m' || doc_id FROM d WHERE k = 0""")
def code_captures(t: Tables):
    return C.captured(_sources(t))


@query("SELECT doc_id, 'Reads ' || lang || ' texts.' AS description, 'a' || doc_id || ',b' AS params, 'a ' || source AS returns FROM documents")
def code_docs(t: Tables):
    text = F.format_string("/**\n * Reads %s\n * texts.\n * @param {number} a%d first\n * @param b\n * @returns {number} a %s\n */\nfunction add(a, b) {}", "lang", "doc_id", "source")
    d = t.documents.select("doc_id", C.jsdoc(text).alias("d"))
    return d.select("doc_id", "d.description", F.array_join("d.params", ",").alias("params"), "d.returns")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src 知识 识图 图谱' WHEN 1 THEN lang || ' 错误处理 异步编程' WHEN 2 THEN '' ELSE 'vue x' || (doc_id % 7) || ' 组件化 开发' END AS tokens FROM documents""")
def tokenize_cjk(t: Tables):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN 'src 知识图谱' WHEN 1 THEN concat('异步编程与错误处理 ', lang) WHEN 2 THEN '学' ELSE concat('Vue 组件化开发 x', doc_id % 7) END")
    return t.documents.select("doc_id", F.array_join(S.bm25_tokens(text), " ").alias("tokens"))


@query("SELECT doc_id, CAST(ceil((doc_id % 7) / 4.0 + (doc_id % 5) * 1.5) AS INTEGER) AS by_kind, CAST(ceil((doc_id % 7) / 4.0 + (doc_id % 5) / 2.0) AS INTEGER) AS by_code_point FROM documents")
def estimate_tokens_mixed(t: Tables):
    mixed = F.expr("concat(repeat('界', CAST(doc_id % 5 AS INT)), repeat('a', CAST(doc_id % 7 AS INT)))")
    return t.documents.select("doc_id", S.estimate_tokens(mixed).cast("int").alias("by_kind"), S.estimate_tokens_by_code_point(mixed).cast("int").alias("by_code_point"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'promise Promise async await then catch' WHEN 1 THEN 'git ' || lang WHEN 2 THEN 'one two ' || source ELSE source END AS rewritten FROM documents""")
def query_rewrite(t: Tables):
    q = t.documents.selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN 'promise' WHEN 1 THEN concat('git ', lang) WHEN 2 THEN concat('one two ', source) ELSE source END AS query", "CASE WHEN doc_id % 4 = 1 THEN 'keyword' ELSE 'hybrid' END AS mode")
    return q.select("doc_id", S.rewritten_query("query", "mode").alias("rewritten"))


@query("""SELECT doc_id, round(least(0.6 * least((doc_id % 13) / 10.0, 1) + 0.3 * ((CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)) / 2.0 + 0.1 / (doc_id % 4 + 1), 1), 6) AS relevance FROM documents""")
def atom_relevance(t: Tables):
    a = t.documents.selectExpr("concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'setup' END, CASE WHEN doc_id % 3 = 0 THEN 'function' END, lang) AS name", "doc_id", "CAST(doc_id % 4 + 1 AS INT) AS heading_level", "doc_id % 13 AS bm25")
    return a.select("doc_id", F.round(R.relevance("bm25", "name", "setup function", "heading_level"), 6).alias("relevance"))


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events), x AS (SELECT query_id, rank, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS rel FROM r),
  g AS (SELECT query_id, sum(rel) AS n, sum(rel) FILTER (WHERE rank <= 5) AS hits, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg, min(rank) FILTER (WHERE rel = 1) AS f FROM x GROUP BY 1)
  SELECT query_id, round(hits / 5.0, 6) AS precision, round(CASE WHEN n > 0 THEN hits * 1.0 / n ELSE 0 END, 6) AS recall, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 5)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg, round(coalesce(1.0 / f, 0), 6) AS mrr FROM g""")
def ir_metrics_of_rankings(t: Tables):
    from pyspark.sql import Window

    found = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    out = V.ir_metrics(found, found.where("id % 3 = 0").select("query_id", "id"), 5)
    return rounded(out.drop("f1"), "precision", "recall", "ndcg", "mrr")


# Chains of parts: each points to the part of half its number; some close a cycle, some lead nowhere.


def _chains(t: Tables, cycles: bool):
    up = "CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 100 = 50 THEN p_partkey + 1 ELSE p_partkey - 1 END" if cycles else "CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE p_partkey - 1 END"
    return t.part.selectExpr("p_partkey AS local_id", f"{up} AS parent_id", "concat('n', p_partkey) AS name", "CAST(p_partkey % 7 + 1 AS INT) AS heading_level")


@query("SELECT p_partkey AS local_id FROM part WHERE p_partkey % 100 >= 50")
def cycle_check(t: Tables):
    """Chains of a hundred rows, in which the fiftieth and the next point to each other."""
    return H.cyclic(_chains(t, True))


@query("SELECT p_partkey AS local_id, p_partkey - p_partkey % 100 + 50 AS cycle, CASE p_partkey % 100 WHEN 50 THEN p_partkey + 1 ELSE p_partkey - 1 END AS parent_id FROM part WHERE p_partkey % 100 IN (50, 51)")
def cycle_members(t: Tables):
    return H.on_cycles(_chains(t, True))


@query("SELECT p_partkey AS local_id, p_partkey % 100 + 1 AS depth FROM part")
def deep_paths(t: Tables):
    """Chains of a hundred rows."""
    return H.tree_paths(_chains(t, False)).select("local_id", "depth")


@query("SELECT p_partkey AS local_id FROM part WHERE p_partkey % 100 <= 30 AND CAST(p_partkey % 7 + 1 AS INTEGER) <= 6 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey // 100 = part.p_partkey // 100 AND q.p_partkey < part.p_partkey AND q.p_partkey % 7 + 1 >= 6)")
def tree_level_filter_hides(t: Tables):
    """A row at the level hides all below it."""
    return H.level_filter(_chains(t, False).where("local_id % 100 <= 30"), 6).select("local_id")


@query("""SELECT p_partkey AS local_id, CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 100 = 60 THEN p_partkey - 60 ELSE p_partkey - 1 END AS parent_id, CASE WHEN p_partkey % 10 = 3 THEN 'new' ELSE 'n' || p_partkey END AS name FROM part WHERE p_partkey % 100 < 40 OR p_partkey % 100 >= 60
  UNION ALL SELECT -p_partkey, p_partkey, 'added' FROM part WHERE p_partkey % 100 = 5""")
def batch_operations(t: Tables):
    """Renames, a move, additions and removals in chains of a hundred rows: what hangs below the fortieth row goes, but for what was moved."""
    p = t.part
    ops = (
        p.where("p_partkey % 10 = 3").selectExpr("1 AS seq", "'update' AS op", "p_partkey AS local_id", "CAST(NULL AS BIGINT) AS parent_id", "'old' AS name")
        .union(p.where("p_partkey % 10 = 3").selectExpr("2", "'update'", "p_partkey", "CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE p_partkey - 1 END", "'new'"))
        .union(p.where("p_partkey % 100 = 5").selectExpr("3", "'add'", "-p_partkey", "p_partkey", "'added'"))
        .union(p.where("p_partkey % 100 = 60").selectExpr("4", "'update'", "p_partkey", "p_partkey - 60", "concat('n', p_partkey)"))
        .union(p.where("p_partkey % 100 = 40").selectExpr("5", "'remove'", "p_partkey", "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)"))
    )
    return H.applied_operations(_chains(t, False), ops)


@query("""WITH a AS (SELECT source AS entity_id, doc_id, lang FROM documents) SELECT a.entity_id, 0.5::DOUBLE AS coverage, 1.0::DOUBLE AS consistency, floor(count(b.doc_id) * 1000.0 / count(*) + 0.5) / 1000 AS link_validity FROM a LEFT JOIN a b ON b.doc_id = a.doc_id + 20 AND b.entity_id = a.entity_id GROUP BY 1""")
def faithfulness_of_sources(t: Tables):
    """Each document is an atom: two terms, of which the entity has one; a title in the abstract; a link to the document twenty numbers on."""
    atoms = t.documents.selectExpr("source AS entity_id", "CAST(doc_id AS STRING) AS local_id", "CAST(NULL AS STRING) AS parent_id", "'title' AS name", "concat('common', ' [[', doc_id + 20, ']]') AS content", "1 AS heading_level")
    ent = t.documents.selectExpr("source AS entity_id", "'common words' AS content", "'the title' AS abstract").distinct()
    return H.faithfulness(atoms, ent).select("entity_id", "coverage", "consistency", "link_validity")


@query(f"""WITH e AS ({EDGE}), n AS ({NODE}), a AS (SELECT id, CASE WHEN substr(id, 1, 1) = 'S' THEN '' ELSE 'part ' || (CAST(substr(id, 2) AS BIGINT) % 150) END AS abstract FROM n)
  SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT from_id FROM e UNION SELECT to_id FROM e)) AS isolated, (SELECT count(*) FROM e WHERE weight < 0.5) AS weak, (SELECT count(*) FROM n WHERE id NOT IN (SELECT from_id FROM e)) AS missing""")
def sop_steps(t: Tables):
    n = t.nodes().withColumn("abstract", F.when(F.col("id").startswith("S"), "").otherwise(F.concat(F.lit("part "), F.expr("CAST(substr(id, 2) AS BIGINT) % 150"))))
    one = lambda action, name: sop.ACTIONS[action](n, t.edges()).select(F.col("found").cast("long").alias(name))
    return one("detect_isolated", "isolated").join(one("detect_low_weight", "weak")).join(one("detect_missing_relations", "missing"))
