"""Queries: the log, numbered batches, path patterns, distinct results, procedures, health check, incremental sync, index keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import code as C
from tessera.operators import evaluate as V
from tessera.operators import graph as G
from tessera.operators import numbering as N
from tessera.operators import prefixes as PX
from tessera.operators import project as P
from tessera.operators import quality as Q
from tessera.operators import retrieval as R
from tessera.operators import sop
from tessera.operators import sync as Y
from tessera.plans.registry import EDGE, NODE, Tables, query, rounded
from tessera.plans.text import TRIE
from tessera.plans.trees import _greedy, _items
from tessera.sources import journal as J
from tessera.sources import versions as V_


def _log(t: Tables):
    """All events as rows of a log: two writers, a batch that comes twice, then joined and opened anew."""
    path = V_.folder(G.checkpoint_folder(t.spark), "journal")
    level = F.when(F.col("event_type") == "view", "DEBUG").when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    data = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("Token"), "props", F.lit("value"), F.col("value").cast("string"))
    rows = t.events.select(F.col("ts").alias("at"), level.alias("level"), F.col("event_type").alias("category"), F.concat(F.lit("event "), "event_id").alias("message"), data.alias("data"), "event_id")
    log = J.Journal(t.spark, path)
    log.append(rows.where("event_id % 3 = 0"), "a", 1)
    log.append(rows.where("event_id % 3 = 1"), "b", 1)
    log.append(rows.where("event_id % 3 = 2"), "a", 2)
    log.append(rows.where("event_id % 3 = 2"), "a", 2)
    log.compact()
    return J.Journal(t.spark, path)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id AS VARCHAR) AS key, count(*) AS accesses, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at
  FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1, 2""")
def access_log(t: Tables):
    """Accesses a day and user from the log; debug rows hold no user."""
    a = J.accesses(_log(t).read("2024-01-03", "2024-01-20"), F.try_element_at("data", F.lit("user")), [F.col("day")])
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return a.select(F.col("day").cast("string").alias("day"), "key", "accesses", at("first_at"), at("last_at"))


@query("""SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(microsecond(ts) % 1000000 / 1000) AS INTEGER)::VARCHAR, 3, '0') || 'Z] [' || CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || '] [' || event_type || '] event ' || event_id
  || CASE WHEN event_type = 'view' THEN '' ELSE ' {"user":"' || user_id || '","Token":"[REDACTED]"}' END AS line FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'""")
def log_lines(t: Tables):
    """A day of the log as text, with secrets blanked; the value is left out here, since engines print doubles in ways of their own."""
    rows = _log(t).read("2024-01-05", "2024-01-05")
    return rows.withColumn("data", F.map_filter("data", lambda k, v: k != "value")).select(J.lines().alias("line"))


@query(f"""WITH e AS (SELECT from_id, to_id, type, max(weight) AS weight FROM ({EDGE}) x GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (ORDER BY from_id, to_id, type) - 1 AS n FROM e)
  SELECT n // 100 + 1 AS batch, count(*) AS size, min(from_id) AS first_from, arg_max(to_id, n) AS last_to, round(sum(weight), 4) AS weight FROM n GROUP BY 1""")
def reference_batches(t: Tables):
    """Distinct edges in their order, a hundred in each batch that is written."""
    b = N.batches(G.distinct_edges(t.edges()), ["from_id", "to_id", "type"], 100, "edges")
    total = F.aggregate("edges", F.lit(0.0), lambda s, e: s + e["weight"])
    return b.select("batch", F.size("edges").cast("long").alias("size"), F.array_min(F.transform("edges", lambda e: e["from_id"])).alias("first_from"), F.element_at("edges", -1)["to_id"].alias("last_to"), F.round(total, 4).alias("weight"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def numbered_rows(t: Tables):
    return N.numbered(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", "id").select("id", "n")


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) x),
  i AS (SELECT doc_id, 'app/' || lang || '/m' || doc_id || '.ts' AS from_path, CASE WHEN doc_id % 4 = 3 THEN './near/' || doc_id ELSE '@' || source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '/' || lang || '/m' || n_chars % 50 END END AS module, lang, source, n_chars, doc_id % 4 AS k FROM documents),
  f AS (SELECT DISTINCT 'packages/' || source || '/src/' || lang || '/m' || n_chars % 50 || CASE WHEN n_chars % 2 = 0 THEN '.ts' ELSE '/index.js' END AS path FROM documents WHERE source IS NOT NULL
    UNION SELECT 'app/' || lang || '/near/' || doc_id || '.js' FROM documents WHERE doc_id % 8 = 3 UNION SELECT 'packages/' || source || '/main/index.js' FROM documents)
  SELECT from_path, module, to_path FROM (
    SELECT from_path, module, 'app/' || lang || '/near/' || doc_id || '.js' AS to_path FROM i WHERE k = 3
    UNION ALL SELECT from_path, module, 'packages/' || source || '/src/' || lang || '/m' || n_chars % 50 || CASE WHEN n_chars % 2 = 0 THEN '.ts' ELSE '/index.js' END FROM i WHERE k IN (1, 2)
    UNION ALL SELECT from_path, module, 'packages/' || source || '/main/index.js' FROM i WHERE k = 0) x WHERE to_path IN (SELECT path FROM f)""")
def pattern_imports(t: Tables):
    """Imports by two patterns of each source, made of the table: a package below its name, and the package itself."""
    d = t.documents
    sources = d.select("source").where("source IS NOT NULL").distinct()
    patterns = sources.select(F.hash("source").alias("n"), F.concat(F.lit("@"), "source", F.lit("/*")).alias("alias"), F.concat(F.lit("packages/"), "source", F.lit("/src/*")).alias("target")).unionByName(
        sources.select(F.lit(1 << 31).cast("long").alias("n"), F.concat(F.lit("@"), "source").alias("alias"), F.concat(F.lit("packages/"), "source", F.lit("/main")).alias("target"))
    )
    inner = F.expr("concat(lang, '/m', n_chars % 50)")
    imports = d.select(F.expr("concat('app/', lang, '/m', doc_id, '.ts')").alias("from_path"), F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("./near/"), "doc_id")).when(F.col("doc_id") % 4 == 0, F.concat(F.lit("@"), "source")).otherwise(F.concat(F.lit("@"), "source", F.lit("/"), inner)).alias("module"))
    files = d.where("source IS NOT NULL").select(F.concat(F.lit("packages/"), "source", F.lit("/src/"), inner, F.expr("CASE WHEN n_chars % 2 = 0 THEN '.ts' ELSE '/index.js' END")).alias("path"))
    files = files.unionByName(d.where("doc_id % 8 = 3").select(F.expr("concat('app/', lang, '/near/', doc_id, '.js')").alias("path"))).unionByName(d.select(F.expr("concat('packages/', source, '/main/index.js')").alias("path")))
    return P.resolved_modules(imports, patterns, files).select("from_path", "module", "to_path")


@query("""WITH r AS (SELECT l_orderkey AS query_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_suppkey % 5 AS VARCHAR) END AS local_id, CAST(l_partkey AS VARCHAR) AS id, l_linenumber AS rank FROM lineitem),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(local_id, id) ORDER BY rank, id, local_id NULLS FIRST) AS k FROM r)
  SELECT query_id, id, local_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id, local_id NULLS FIRST) AS rank FROM f WHERE k = 1""")
def distinct_results(t: Tables):
    r = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_returnflag") != "R", (F.col("l_suppkey") % 5).cast("string")).alias("local_id"), F.col("l_partkey").cast("string").alias("id"), F.col("l_linenumber").alias("rank"))
    return R.distinct_results(r, ["query_id"]).select("query_id", "id", "local_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT path, name, start_line, min(event_id) AS first FROM (SELECT 'u' || user_id AS path, event_type AS name, extract(day FROM ts)::BIGINT AS start_line, event_id FROM events) x GROUP BY 1, 2, 3""")
def distinct_definitions(t: Tables):
    found = t.events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("name"), F.dayofmonth("ts").cast("long").alias("start_line"), "event_id")
    return C.distinct_definitions(found, ["event_id"]).select("path", "name", "start_line", F.col("event_id").alias("first"))


@query(f"WITH c AS ({_greedy('relevance DESC, ord, local_id, tokens', 4000)}), i AS (SELECT lang, doc_id FROM documents) SELECT entity_id, local_id, row_number() OVER (PARTITION BY entity_id ORDER BY lpad(local_id, 8, '0'), local_id) AS position FROM c")
def budget_in_order(t: Tables):
    """What the budget holds, as the document has it."""
    items = G.checkpointed(_items(t))
    return R.chosen_in_order(items, R.budget_select(items, 4000)).select("entity_id", "local_id", F.col("position").cast("long").alias("position"))


LISTED = """WITH s AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nk FROM supplier), r AS (SELECT l_suppkey AS k, max(l_shipdate) AS last_run FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"""


@query(f"""{LISTED} SELECT name, CASE WHEN s.k % 3 = 0 THEN NULL ELSE 'Tidies nation ' || nk END AS description, CASE WHEN s.k % 4 = 0 THEN 'general' ELSE 'region ' || n_regionkey END AS category,
  CAST(CAST(last_run AS DATE) AS VARCHAR) AS last_run, row_number() OVER (ORDER BY name) AS position FROM s JOIN nation ON nk = n_nationkey LEFT JOIN r ON r.k = s.k""")
def procedures(t: Tables):
    """A procedure of each supplier, as files, with the time of its last run."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    about = F.when(F.col("s_suppkey") % 3 != 0, F.format_string('description: "Tidies nation %d"  # checked\n', "s_nationkey")).otherwise("")
    kind = F.when(F.col("s_suppkey") % 4 != 0, F.format_string("category: region %d\n", "n_regionkey")).otherwise("category:\n")
    files = s.select(F.concat(F.lit("sops/"), "s_suppkey", F.lit(".yaml")).alias("path"), F.concat(F.lit("# a file\nname: '"), "s_name", F.lit("'\n"), about, kind, F.lit("steps:\n  - action: verify\n    name: inner\n")).alias("text"))
    runs = t.lineitem.where("l_linenumber = 1").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return sop.listed(files, runs).withColumn("last_run", F.to_date("last_run").cast("string"))


STEPS = "SELECT l_orderkey AS run, l_linenumber AS n, 'step ' || l_suppkey AS action, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status, CASE WHEN l_linestatus = 'O' THEN 'continue' ELSE 'stop' END AS on_failure, CAST(l_quantity AS BIGINT) AS duration_ms, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS affected FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) x"


@query(f"""WITH s AS ({STEPS}), x AS (SELECT *, coalesce(max(CASE WHEN status = 'failed' AND on_failure <> 'continue' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s),
  y AS (SELECT *, '### ' || action || chr(10) || '- Status: ' || status || chr(10) || '- Duration: ' || duration_ms || 'ms' || CASE WHEN affected IS NULL THEN '' ELSE chr(10) || '- Affected: ' || affected END || CASE WHEN status = 'failed' THEN chr(10) || '- Error: refused' ELSE '' END AS line FROM x WHERE stopped = 0)
  SELECT run, count(*) AS executed, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  '**Steps**: ' || count(*) || ' executed, ' || count(*) FILTER (WHERE status = 'success') || ' success, ' || count(*) FILTER (WHERE status = 'failed') || ' failed' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY n) AS report FROM y GROUP BY run""")
def procedure_reports(t: Tables):
    """Runs of a procedure, one for each order; its lines are the steps."""
    columns = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*columns)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    failed = F.col("l_returnflag") == "R"
    steps = lines.select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("n"), F.concat(F.lit("step "), "l_suppkey").alias("action"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(F.col("l_linestatus") == "O", "continue").otherwise("stop").alias("on_failure"),
        F.col("l_quantity").cast("long").alias("duration_ms"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).alias("affected"), F.when(failed, "refused").alias("error"),
    )
    return sop.reports(steps, ["run"])


@query("""WITH r AS (SELECT user_id, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events), x AS (SELECT *, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS rel FROM r),
  g AS (SELECT user_id, sum(rel) AS n, sum(rel) FILTER (WHERE rank <= 5) AS hits, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg, min(rank) FILTER (WHERE rel = 1) AS f FROM x GROUP BY 1),
  m AS (SELECT user_id % 4 AS grp, hits / 5.0 AS p, CASE WHEN n > 0 THEN hits * 1.0 / n ELSE 0 END AS rc, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 5)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, coalesce(1.0 / f, 0) AS mrr FROM g)
  SELECT grp, floor(avg(p) * 1000 + 0.5) / 1000 AS precision, floor(avg(rc) * 1000 + 0.5) / 1000 AS recall, floor(avg(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END) * 1000 + 0.5) / 1000 AS f1, floor(avg(ndcg) * 1000 + 0.5) / 1000 AS ndcg, floor(avg(mrr) * 1000 + 0.5) / 1000 AS mrr FROM m GROUP BY 1""")
def ir_averages(t: Tables):
    """Means of the measures over the users of a group."""
    from pyspark.sql import Window

    found = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    m = V.ir_metrics(found, found.where("id % 3 = 0").select("query_id", "id"), 5)
    return V.macro(m.withColumn("grp", F.col("query_id") % 4), ["grp"])


@query(f"""WITH n AS ({NODE}), e AS ({EDGE}), c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS r, (SELECT count(*) FROM n WHERE id NOT IN (SELECT from_id FROM e UNION SELECT to_id FROM e)) AS iso),
  d AS (SELECT *, 2 * r / (n * (n - 1.0)) AS density, round(iso * 1.0 / n, 4) AS orphans FROM c), h AS (SELECT *, floor((least(100, 0.5 * n) + least(100, 2000 * density) + 80) / 3 + 0.5) AS score FROM d)
  SELECT n AS entity_count, r AS relationship_count, round(density, 6) AS network_density, score AS health_score, orphans AS orphan_rate, coalesce(CASE WHEN density < 0.9 THEN 'network_density: Network density ' || printf('%.4f', density) || ' is below threshold 0.9' END, '') || CASE WHEN density < 0.9 AND score < 99 THEN '|' ELSE '' END AS w0,
  CASE WHEN score < 99 THEN 'health_score: Health score ' || CAST(score AS INTEGER) || ' is below threshold 99' ELSE '' END AS w1, orphans > 0.2 AS many_orphans FROM h""")
def health_check(t: Tables):
    """One check of all nodes and edges, with limits that are hard to meet."""
    h = Q.health_check(t.nodes(), t.edges(), F.lit(0.8), least_health=99, least_density=0.9)
    w = lambda kind: F.array_join(F.transform(F.filter("warnings", lambda x: x["type"] == kind), lambda x: F.concat(x["type"], F.lit(": "), x["message"])), "|")
    d, s = w("network_density"), w("health_score")
    cut = F.when((d != "") & (s != ""), "|").otherwise("")
    return h.select("entity_count", "relationship_count", F.round("network_density", 6).alias("network_density"), F.col("health_score").cast("double").alias("health_score"), "orphan_rate", F.concat(d, cut).alias("w0"), s.alias("w1"), F.exists("warnings", lambda x: x["type"] == "orphan_rate").alias("many_orphans"))


RUN = """WITH l AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents WHERE doc_id % 10 <> 9), s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE substr(sha256(coalesce(text, '')), 1, 16) END AS hash FROM documents WHERE doc_id % 10 <> 0),
  j AS (SELECT coalesce(l.doc_id, s.doc_id) AS id, l.hash AS lh, s.hash AS sh FROM l FULL JOIN s ON l.doc_id = s.doc_id),
  r AS (SELECT id, CASE WHEN lh IS NULL THEN 'delete' WHEN id % 11 = 0 THEN 'missing' WHEN lh = sh THEN 'skip' ELSE 'upload' END AS action FROM j),
  x AS (SELECT id AS source_id, action, CASE action WHEN 'delete' THEN 'to_delete' WHEN 'missing' THEN 'skipped' WHEN 'skip' THEN 'unchanged' ELSE CASE WHEN id % 13 = 0 THEN 'failed' ELSE 'uploaded' END END AS status FROM r)"""


def _run(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("source_id"), S.short_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    server = d.where("source_id % 10 <> 0").withColumn("hash", F.when(F.col("source_id") % 7 == 0, "old").otherwise(F.col("hash")))
    return Y.synced_incrementally(d.where("source_id % 10 <> 9"), server, d.where("source_id % 11 <> 0"), d.where("source_id % 13 <> 0"))


@query(f"{RUN} SELECT * FROM x")
def incremental_sync_run(t: Tables):
    """Every document against a server that lacks some, holds old versions of some, has some more, and refuses some."""
    return _run(t)


@query(f"{RUN} SELECT count(*) FILTER (WHERE status = 'uploaded') AS uploaded, count(*) FILTER (WHERE status = 'failed') AS failed, 0::BIGINT AS pending, count(*) FILTER (WHERE status = 'to_delete') AS to_delete, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status IN ('uploaded', 'failed', 'to_delete')) = 0 AS up_to_date FROM x")
def incremental_sync_summary(t: Tables):
    return Y.sync_summary(_run(t))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(list_concat(string_split(lower(p_type), ' '), CASE WHEN p_size % 2 = 0 THEN [lower(regexp_extract(p_brand, '\\w+'))] ELSE []::VARCHAR[] END, CASE WHEN p_size % 3 = 0 THEN list_distinct(string_split(lower(p_name), ' ')) ELSE []::VARCHAR[] END), lambda x: length(x) >= 2)), ',') AS words FROM part""")
def index_keywords(t: Tables):
    """The index words of metadata lines; some parts have no type or no project."""
    text = F.concat(F.lit("**Tags**: "), F.regexp_replace("p_type", " ", " ;"), F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("**type**: "), "p_brand", F.lit("\n"))).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("**Project**: "), "p_name")).otherwise(""))
    return t.part.select("p_partkey", F.array_join(F.array_sort(S.metadata_keywords(text)), ",").alias("words"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ') || ',, ' || p_brand || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part""")
def tag_lists(t: Tables):
    tags = F.concat(F.regexp_replace("p_name", " ", " , "), F.lit(",, "), "p_brand", F.lit(" ,"))
    return t.part.select("p_partkey", F.array_join(S.normalised_tags(tags), "|").alias("tags"))


@query(f"""WITH f AS (SELECT 'd' || doc_id AS id, lower(coalesce(lang, '')) AS l, lower(coalesce(source, '')) AS s, coalesce(text, '') AS body FROM documents WHERE coalesce(n_chars, 0) % 7 < 5),
  ln AS (SELECT *, row_number() OVER () AS i FROM (SELECT id, text, 1 AS k FROM (SELECT id, unnest(string_split(body, chr(10))) AS text FROM f) y WHERE NOT starts_with(text, '**') UNION ALL SELECT id, s || '-' || l, 2 FROM f) z), w AS (SELECT id, i, k, {TRIE} AS ws FROM ln),
  x AS (SELECT id, i, k, unnest(ws) AS word FROM w UNION SELECT id, i, k, unnest(flatten(list_transform(list_filter(ws, lambda y: contains(y, '-')), lambda y: regexp_split_to_array(y, '[_-]+')))) FROM w),
  v AS (SELECT word, id, sum(k) AS weight FROM (SELECT word, id, k FROM x UNION ALL SELECT l, id, 2 FROM f UNION ALL SELECT s, id, 2 FROM f UNION ALL SELECT 'note', id, 2 FROM f) y WHERE length(word) >= 2 GROUP BY 1, 2)
  SELECT word, CAST(sum(weight) AS BIGINT) AS frequency, count(*) AS n_entries FROM v GROUP BY 1""")
def file_index_words(t: Tables):
    """Documents as the files of a base, with metadata lines; files beside its folders aren't indexed. The index is stored and opened anew."""
    kind, name = F.coalesce("n_chars", F.lit(0)) % 7, F.concat(F.lit("d"), "doc_id")
    folder = F.when(kind == 5, "drafts/").when(kind % 2 == 0, "timeline/2024/03/").otherwise(F.concat(F.lit("active/"), F.coalesce("source", F.lit("none")), F.lit("/entries/")))
    part = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("**Tags**: "), part("lang"), F.lit("; "), part("source"), F.lit("\n**Type**: Note\n\n**Project**: "), part("source"), F.lit("-"), part("lang"), F.lit("\n"))
    files = t.documents.select(F.concat(folder, name, F.when(kind == 6, ".txt").otherwise(".md")).alias("path"), F.concat(head, part("text")).alias("text"))
    path = V_.folder(G.checkpoint_folder(t.spark), "file-index")
    PX.PrefixIndex.open(t.spark, path).add(PX.words_of_files(files))
    return PX.PrefixIndex.open(t.spark, path).table("words").select("word", "frequency", "n_entries")
