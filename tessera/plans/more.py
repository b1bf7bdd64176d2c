"""Queries: stored index and scopes, projects, sync flows, recommendations, trees in order, listings by key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import browse as B
from tessera.operators import code as C
from tessera.operators import evaluate as V
from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.operators import index as X
from tessera.operators import prefixes as PX
from tessera.operators import project as P
from tessera.operators import quality as Q
from tessera.operators import recommend as RC
from tessera.operators import retrieval as R
from tessera.operators import segments as SG
from tessera.operators import sync as Y
from tessera.operators import vectors as VL
from tessera.plans.cases import PATHS, _sources
from tessera.plans.registry import ATOM, EDGE, NODE, TOKENS, Tables, query, rounded
from tessera.plans.text import SCORE, VOCAB
from tessera.sources import versions as V_


def _index_sql(docs: str, limit: int = 10) -> str:
    """BM25 of the items' texts over the given documents."""
    return f"""WITH docs AS ({docs}), tok AS (SELECT doc_id, {TOKENS} AS ts FROM docs),
  post AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) x GROUP BY doc_id, term),
  st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
  b AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) x GROUP BY item_id, term), d AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  s AS (SELECT b.query_id, p.doc_id AS id, sum(b.qtf * {SCORE}) AS score FROM post p JOIN b ON p.term = b.term JOIN d ON d.term = p.term CROSS JOIN st GROUP BY 1, 2)
  SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score >= 0.1) y WHERE rank <= {limit}"""


def _asked(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(_index_sql("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN lang || ' ' || text ELSE text END AS text FROM documents"))
def bm25_after_upsert(t: Tables):
    """A tenth of the documents comes again with another text."""
    again = t.documents.where("doc_id % 10 = 3").select("doc_id", F.concat_ws(" ", "lang", "text").alias("text"))
    return rounded(X.TextIndex.of(t.documents).upsert(again).search(_asked(t)), "score", digits=4)


@query(_index_sql("SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3"))
def bm25_after_delete(t: Tables):
    gone = t.documents.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id"))
    return rounded(X.TextIndex.of(t.documents).delete(gone).search(_asked(t)), "score", digits=4)


@query("""WITH w AS (SELECT doc_id % 7 AS id, source AS word, count(*) AS weight FROM documents GROUP BY 1, 2), n AS (SELECT doc_id % 7 AS id, lang AS word, 2 * count(*) AS weight FROM documents GROUP BY 1, 2)
  SELECT word, id, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT * FROM w UNION ALL SELECT * FROM n) x WHERE id <> 5 GROUP BY 1, 2""")
def vocabulary_after_changes(t: Tables):
    """Words and tags of entries are added up; an entry leaves."""
    w = lambda column, n: t.documents.groupBy(F.col(column).alias("word"), (F.col("doc_id") % 7).alias("id")).agg((F.count("*") * n).alias("weight"))
    gone = t.spark.createDataFrame([(5,)], "id long")
    return R.delete_entry(R.upsert_words(w("source", 1), w("lang", 2)), gone).select("word", "id", "weight")


SCOPED = f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'entity' AS scope, source AS type, text FROM documents UNION ALL SELECT lang || '/' || conv_id || '-' || turn, 'atom', role, 'turn ' || text FROM (SELECT *, 'c' AS lang FROM conversations) c),
  tok AS (SELECT id, scope, type, {TOKENS} AS ts FROM docs)"""


def _scoped_sql(where: str) -> str:
    return f"""WITH {SCOPED}, k AS (SELECT id, scope, type, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS a, len(list_filter(ts, lambda x: x = 'of')) AS b FROM tok WHERE {where}),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM k),
  s AS (SELECT id, scope, type, CASE WHEN a > 0 THEN ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END AS score FROM k CROSS JOIN st)
  SELECT id, scope, type, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score >= 0.1) y WHERE rank <= 25"""


def _scopes(t: Tables):
    entities = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("text").alias("content"))
    atoms = t.conversations.select(F.lit("c").alias("entity_id"), F.concat_ws("-", "conv_id", "turn").alias("local_id"), F.col("role").alias("type"), F.lit("turn").alias("name"), F.col("text").alias("content"))
    return entities, atoms


@query(_scoped_sql("true"))
def search_all(t: Tables):
    return rounded(X.routed_search(*_scopes(t), "the of", limit=25), "score", digits=4)


@query(_scoped_sql("scope = 'atom' AND type = 'user'"))
def search_atoms_of_a_type(t: Tables):
    return rounded(X.routed_search(*_scopes(t), "the of", "atom", ["user"], limit=25), "score", digits=4)


@query(_scoped_sql("scope = 'entity'"))
def search_scopes(t: Tables):
    return rounded(X.routed_search(*_scopes(t), "the of", "entity", limit=25), "score", digits=4)


def _modes_sql() -> str:
    """Keyword, vector and hybrid over all and over entities; documents' vectors are those of their numbers."""
    ctes, parts = [SCOPED, "q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0)"], []
    ctes.append("v AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(qv, qv)) AS c FROM embeddings, q)")
    for scope, where in (("all", "true"), ("entity", "scope = 'entity'")):
        x = scope[0]
        ctes += [
            f"k{x} AS (SELECT id, scope, type, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS a, len(list_filter(ts, lambda x: x = 'of')) AS b FROM tok WHERE {where})",
            f"st{x} AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM k{x})",
            f"""s{x} AS (SELECT id, scope, type, a + b > 0 AS hit, CASE WHEN a > 0 THEN ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END
              + CASE WHEN b > 0 THEN ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END AS score FROM k{x} CROSS JOIN st{x})""",
            f"j{x} AS (SELECT s.*, CASE WHEN v.c >= 0.3 THEN v.c END AS c FROM s{x} s LEFT JOIN v ON v.id = s.id)",
        ]
        scores = {"keyword": ("score", "hit AND score >= 0.01"), "vector": ("c", "c >= 0.3"), "hybrid": ("0.7 * coalesce(c, 0) + 0.3 * CASE WHEN hit THEN least(score / 10, 1) ELSE 0 END", "(hit OR c IS NOT NULL) AND 0.7 * coalesce(c, 0) + 0.3 * CASE WHEN hit THEN least(score / 10, 1) ELSE 0 END >= 0.005")}
        parts += [f"SELECT '{mode}' AS mode, '{scope}' AS asked, id, scope, type, {score} AS score FROM j{x} WHERE {least}" for mode, (score, least) in scores.items()]
    return f"""WITH {", ".join(ctes)}, u AS ({" UNION ALL ".join(parts)}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY mode, asked ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM u),
  e AS (SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 100) AS shown FROM documents UNION ALL SELECT 'c/' || conv_id || '-' || turn, substr(text, 1, 100) FROM conversations)
  SELECT mode, asked, r.id, scope, type, round(score, 4) AS score, rank, e.shown FROM r JOIN e ON e.id = r.id WHERE rank <= 10"""


@query(_modes_sql())
def search_modes(t: Tables):
    entities, atoms = _scopes(t)
    entities = entities.withColumns({"abstract": F.substring("content", 1, 100), "overview": F.substring("content", 1, 500)})
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = t.embeddings.where("vec_id = 0").first().embedding
    out = None
    for mode in ("keyword", "vector", "hybrid"):
        for scope in ("all", "entity"):
            found = X.routed(entities, atoms, "the of", mode, scope, limit=10, level=1, vectors=vectors, query_vector=asked).select(F.lit(mode).alias("mode"), F.lit(scope).alias("asked"), "*")
            out = found if out is None else out.unionByName(found)
    return rounded(out, "score", digits=4)


SUMS = f"e AS ({EDGE}), n AS ({NODE})"


@query(f"WITH {SUMS}, x AS (SELECT id FROM n WHERE id IN (SELECT from_id FROM e UNION SELECT to_id FROM e)), c AS (SELECT 'P0' AS component, count(*) AS size FROM x UNION ALL SELECT id, 1 FROM n WHERE id NOT IN (SELECT id FROM x)) SELECT component, size, size = (SELECT max(size) FROM c) AND component = (SELECT min(component) FROM c d WHERE d.size = (SELECT max(size) FROM c)) AS is_largest, size < 3 AS is_small FROM c")
def component_sizes(t: Tables):
    """Line items join all suppliers and the parts they name; the rest are alone."""
    return G.component_summary(G.components(t.edges(), t.nodes()))


@query(f"WITH e AS ({EDGE}) SELECT from_id AS id, type, round(weight, 6) AS weight FROM (SELECT from_id, type, weight, row_number() OVER (ORDER BY weight DESC, from_id, type) AS k FROM e WHERE to_id = 'P7') x WHERE k <= 50")
def call_references(t: Tables):
    return rounded(G.references_of(t.edges(), "P7"), "weight")


@query(f"WITH e AS ({EDGE}) SELECT DISTINCT id, type, round(weight, 6) AS weight FROM (SELECT from_id AS id, type, weight, from_id AS node FROM e) x WHERE node IN ('S1', 'S2', 'S5')")
def batch_references(t: Tables):
    """The distinct out-edges of several nodes in one pass."""
    some = t.nodes().where(F.col("id").isin("S1", "S2", "S5"))
    return rounded(G.references_from(t.edges(), some), "weight").distinct()


@query("""WITH o AS (SELECT 'N' || o_orderkey AS id, o_orderstatus AS hash FROM orders WHERE o_orderkey % 10 <> 0), w AS (SELECT 'N' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 10 <> 1),
  l AS (SELECT DISTINCT 'N' || l_orderkey AS source, 'N' || (l_orderkey + l_linenumber) AS target, l_returnflag AS relation, l_orderkey AS k FROM lineitem)
  SELECT source, target, relation FROM l WHERE k % 5 <> 1 AND source IN (SELECT id FROM w) AND target IN (SELECT id FROM w)""")
def incremental_import(t: Tables):
    """Two states of a graph: some nodes go, come and change, and some links; what is left equals the new graph between its nodes."""
    old = t.orders.where("o_orderkey % 10 <> 0").selectExpr("concat('N', o_orderkey) AS id", "o_orderstatus AS hash")
    new = t.orders.where("o_orderkey % 10 <> 1").selectExpr("concat('N', o_orderkey) AS id", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS hash")
    links = t.lineitem.selectExpr("concat('N', l_orderkey) AS source", "concat('N', l_orderkey + l_linenumber) AS target", "l_returnflag AS relation", "l_orderkey AS k").distinct()
    return P.incremental_import(new, links.where("k % 5 <> 1").drop("k"), old, links.where("k % 5 <> 0").drop("k"))[1]


@query("SELECT source AS type, count(*) AS atoms, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def tokens_by_type(t: Tables):
    return t.documents.groupBy(F.col("source").alias("type")).agg(F.count("*").alias("atoms"), F.sum(S.estimate_tokens("text")).alias("tokens"))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'view') * 1.0 / count(*) FILTER (WHERE event_type IN ('view', 'click')), 6) AS hit_rate FROM events GROUP BY 1")
def hit_rates(t: Tables):
    """The share of hits among hits and misses, as counted by a cache; null where nothing was asked."""
    hits, all_ = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "click"))
    return t.events.groupBy("user_id").agg(F.round(F.try_divide(hits.cast("double"), all_), 6).alias("hit_rate"))


@query(f"""WITH {PATHS}, s AS (SELECT 'C' || doc_id AS name, path, 'class' AS kind FROM d UNION ALL SELECT 'f' || doc_id, path, 'function' FROM d UNION ALL SELECT 'run', path, 'function' FROM d) SELECT name, min(path) AS path, arg_min(kind, path) AS kind FROM s GROUP BY 1""")
def symbol_table(t: Tables):
    return P.symbol_table(C.analysed(_sources(t))).select("name", "path", "kind")


@query(f"""WITH {PATHS}, s AS (SELECT 'C' || doc_id AS name, path, doc_id FROM d UNION ALL SELECT 'run', path, doc_id FROM d), a AS (SELECT name, min(path) AS path FROM s WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT name, min(path) AS path FROM s WHERE doc_id % 2 = 1 GROUP BY 1)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)""")
def symbol_table_merge(t: Tables):
    """Names of the first table stay; the second adds its own."""
    half = lambda k: P.symbol_table(C.analysed(_sources(t).where(F.regexp_extract("path", r"m(\d+)", 1).cast("long") % 2 == k))).where("name = 'run' OR name LIKE 'C%'").select("name", "path")
    return P.merged(half(0), half(1))


@query(f"""WITH {PATHS}, s AS (SELECT 'C' || doc_id AS name, path, doc_id FROM d UNION ALL SELECT 'run', path, doc_id FROM d), m AS (SELECT name, min(path) AS path, arg_min(doc_id, path) AS doc_id FROM s GROUP BY 1) SELECT name, path FROM m WHERE doc_id % 3 <> 0""")
def symbol_table_invalidation(t: Tables):
    sources = _sources(t)
    changed = sources.where(F.regexp_extract("path", r"m(\d+)", 1).cast("long") % 3 == 0)
    return P.invalidated(P.symbol_table(C.analysed(sources)).where("name = 'run' OR name LIKE 'C%'").select("name", "path"), changed)


@query(f"""WITH {PATHS}, r AS (SELECT min(path) AS path FROM d) SELECT 'contains' AS type, 3 * count(*) AS n FROM d UNION ALL SELECT 'calls', count(*) FROM d WHERE k = 0""")
def project_references(t: Tables):
    """Files contain their symbols; the functions of Python files call their class; no imported file exists."""
    e = P.loaded(_sources(t))["references"]
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {PATHS} SELECT path AS id, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE 'java' END AS language, 'C' || doc_id || ', run, f' || doc_id AS overview FROM d""")
def project_entities(t: Tables):
    return P.loaded(_sources(t))["entities"].select("id", "language", "overview")


@query(f"WITH {PATHS} SELECT count(*) AS files, 2 * count(*) AS functions, 'A' AS grade FROM d")
def project_report(t: Tables):
    return P.report(C.analysed(_sources(t))).select("files", "functions", "grade")


@query(f"WITH {PATHS} SELECT path, 'f' || doc_id AS name FROM d WHERE doc_id % 4 = 1")
def batch_slice(t: Tables):
    batch = t.documents.where("doc_id % 4 = 1").select("doc_id").join(_sources(t).withColumn("doc_id", F.regexp_extract("path", r"m(\d+)", 1).cast("long")), "doc_id")
    return P.of_batch(C.symbols(C.analysed(_sources(t))).select("path", "name"), batch).where("name LIKE 'f%'").select("path", "name")


@query("""WITH d AS (SELECT DISTINCT lang, source, doc_id FROM documents) SELECT 'src/' || lang || '/m' || doc_id || '.js' AS from_path, 'src/shared/' || source || '.js' AS to_path FROM d""")
def alias_imports(t: Tables):
    imports = t.documents.selectExpr("concat('src/', lang, '/m', doc_id, '.js') AS from_path", "concat('@/shared/', source) AS module")
    files = t.documents.selectExpr("concat('src/shared/', source, '.js') AS path").distinct()
    return G.resolved_imports(P.aliased(imports), files).select("from_path", "to_path")


@query("""WITH k AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 50) a JOIN embeddings b ON a.vec_id <> b.vec_id),
  p AS (SELECT from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(s, 9) DESC, to_id) AS r FROM k WHERE s >= 0.2) x WHERE r <= 5),
  y AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS n FROM embeddings a JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS m FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.m <= 3)
  SELECT from_id, to_id, 'semantic' AS reason FROM p UNION ALL SELECT from_id, to_id, 'type' FROM y WHERE n <= 2""")
def combined_recommendations(t: Tables):
    """The first fifty vectors' neighbours (the operator's own rule), and two of the same label for each."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("type"))
    none = e.select(F.col("id").alias("from_id"), F.col("id").alias("to_id")).limit(0)
    return RC.combined(RC.similar_to(t.embeddings, 50, 5, 0.2), RC.same_type(e, none, 2)).select("from_id", "to_id", "reason")


@query("SELECT event_id AS queue_id, user_id AS from_id, CASE WHEN event_type = 'click' THEN event_type ELSE 'related' END AS type, value AS weight FROM events WHERE event_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 20 DAYS")
def review_queue(t: Tables):
    """Items are added with defaults; some are approved, some rejected, old ones expire."""
    items = t.events.select(F.col("event_id").alias("queue_id"), F.col("user_id").alias("from_id"), F.col("event_id").alias("to_id"), F.col("value").alias("similarity"), F.when(F.col("event_type") == "click", F.col("event_type")).alias("type"), F.lit(None).cast("double").alias("weight"), "ts")
    queue = RC.queued(None, items, F.col("ts"))
    left, _ = RC.approved(queue, queue.where("queue_id % 2 = 0").select("queue_id"))
    left = RC.rejected(left, queue.where("queue_id % 4 = 3").select("queue_id"))
    return Y.unexpired(left, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 20).select("queue_id", "from_id", "type", "weight")


@query("SELECT event_id AS queue_id, user_id AS from_id, event_id AS to_id, value AS weight FROM events WHERE event_id % 2 = 0")
def approved_edges(t: Tables):
    items = t.events.select(F.col("event_id").alias("queue_id"), F.col("user_id").alias("from_id"), F.col("event_id").alias("to_id"), F.col("value").alias("similarity"), F.lit("related").alias("type"), F.lit(None).cast("double").alias("weight"), "ts")
    queue = RC.queued(None, items, F.col("ts"))
    ids = queue.where("queue_id % 2 = 0").select("queue_id")
    return RC.approved(queue, ids)[1].select(F.col("to_id").alias("queue_id"), "from_id", "to_id", "weight")


@query("SELECT user_id, count(*) AS messages, count(*) > 10 AS preferred FROM events WHERE ts >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAYS AND user_id % 5 <> 0 GROUP BY 1")
def recent_sessions(t: Tables):
    done = t.events.where("user_id % 5 = 0").select("user_id").distinct()
    return RC.recent_sessions(t.events, F.lit("2024-04-10 00:00:00").cast("timestamp_ntz"), done, session="user_id")


@query("SELECT l_suppkey AS from_id, l_partkey AS to_id, 'related_to' AS type, round(0.7 * least(l_quantity / 10, 1) + 0.3 * l_discount * 10, 6) AS weight FROM lineitem WHERE l_linenumber > 1 AND 0.7 * least(l_quantity / 10, 1) + 0.3 * l_discount * 10 >= 0.75")
def cross_type_edges(t: Tables):
    pairs = t.lineitem.selectExpr("l_suppkey AS from_id", "l_partkey AS to_id", "l_quantity AS bm25", "l_discount * 10 AS cosine", "l_linenumber - 1 AS overlap")
    return rounded(RC.cross_type_edges(pairs, 0.75), "weight")


@query("SELECT arg_min(event_id, event_id) AS from_id, user_id AS to_id, 'analyzes' AS type, 0.7::DOUBLE AS weight FROM events WHERE event_type <> 'click' GROUP BY user_id")
def conversation_links(t: Tables):
    """The best hit of each that is not code; hits are the events of a user in order."""
    hits = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("event_id").alias("rank"))
    kinds = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "code").otherwise("conversation").alias("type"))
    return RC.analyses_edges(hits, kinds)


@query("SELECT count(*) AS to_sync, count(*) FILTER (WHERE doc_id % 3 = 0) AS synced, count(*) FILTER (WHERE doc_id % 3 <> 0) AS failed FROM documents WHERE doc_id % 2 = 1")
def index_rebuild(t: Tables):
    e = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("synced"))
    return Y.rebuilt(e, e.where("id % 3 = 0"))


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'delete' WHEN doc_id % 6 = 1 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'upload' WHEN doc_id % 4 = 2 THEN 'upload' ELSE 'skip' END AS action FROM documents")
def incremental_sync(t: Tables):
    """Of four documents one is on the server only, one on this side only, one has changed; some lack their file."""
    d = t.documents.select(F.col("doc_id").alias("source_id"), S.short_hash("text").alias("hash"))
    server = d.where("source_id % 4 <> 1").withColumn("hash", F.when(F.col("source_id") % 4 == 2, F.lit("?")).otherwise(F.col("hash")))
    return Y.incremental(d.where("source_id % 4 <> 0"), server, d.where("source_id % 6 <> 1"))


@query("SELECT doc_id AS source_id, CASE WHEN substr(sha256(text), 1, 16) IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 2 = 0) THEN 'duplicate' ELSE 'upload' END AS action FROM documents WHERE doc_id % 2 = 1")
def full_sync(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("source_id"), S.short_hash("text").alias("hash"))
    return Y.full(d.where("source_id % 2 = 1"), d.where("source_id % 2 = 0"))


@query("SELECT doc_id AS source_id, substr(sha256(text), 1, 12) AS hash, substr(source || '/' || lang || '/' || doc_id, 1, 40) AS path, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 20")
def sync_checkpoints(t: Tables):
    return Y.checkpoints(t.documents.select(F.col("doc_id").alias("source_id"), S.short_hash("text").alias("hash"), F.concat_ws("/", "source", "lang", "doc_id").alias("path")))


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id AS id, true AS rolled_back FROM documents d WHERE doc_id % 3 <> 0 AND sha256(text) IN (SELECT h FROM s)
  UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 3 = 0 OR sha256(text) NOT IN (SELECT h FROM s)""")
def write_then_sync(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    now, lost = Y.written_then_synced(d.where("id % 3 = 0"), d.where("id % 3 <> 0"), d.where("id % 3 = 0"))
    return now.select("id", F.lit(False).alias("rolled_back")).unionByName(lost.select("id", F.lit(True).alias("rolled_back")))


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src1')")
def scoped_delete(t: Tables):
    return Y.scoped_delete(t.documents, lang="en", source="src1").select("doc_id")


@query("""SELECT a.vec_id AS id, min(b.vec_id) AS duplicate_of FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 2 = 0 AND a.embedding = b.embedding WHERE a.vec_id % 2 = 1 GROUP BY 1 UNION ALL SELECT vec_id + 1000000, vec_id FROM embeddings WHERE vec_id % 2 = 0""")
def upload_similar(t: Tables):
    """Scaled copies of stored vectors come again under other ids; all are found."""
    stored = t.embeddings.where("vec_id % 2 = 0").select("vec_id", "embedding")
    again = stored.select((F.col("vec_id") + 1000000).alias("vec_id"), F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"))
    new = t.embeddings.where("vec_id % 2 = 1").select("vec_id", "embedding").unionByName(again)
    return Y.similar_on_upload(new, stored, 0.999999)


@query(f"""WITH a AS ({ATOM}) SELECT local_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY name, local_id) AS position FROM a""")
def siblings_in_order(t: Tables):
    return H.in_order(t.atoms().withColumn("order", F.col("name"))).select("local_id", "parent_id", F.col("position").cast("long").alias("position"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
  SELECT r_regionkey AS entity_id, 0::BIGINT AS position, 'R' || r_regionkey AS local_id, NULL AS parent_id, r_name AS name FROM region
  UNION ALL SELECT n_regionkey, i, 'N' || n.n_nationkey, CASE WHEN n.n_nationkey % 7 = 0 THEN 'own' ELSE 'R' || n_regionkey END, n_name FROM n JOIN nation USING (n_regionkey, n_nationkey)""")
def tree_flatten(t: Tables):
    """Regions as JSON trees with their nations as children; some nations name their own parent."""
    child = F.struct(F.concat(F.lit("N"), "n_nationkey").alias("local_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 7 == 0, "own").alias("parent_id"))
    kids = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", child.alias("c")))), lambda x: x["c"]).alias("children"))
    tree = t.region.join(kids, "r_regionkey").select(F.col("r_regionkey").alias("entity_id"), F.to_json(F.array(F.struct(F.concat(F.lit("R"), "r_regionkey").alias("local_id"), F.col("r_name").alias("name"), "children"))).alias("tree"))
    return H.flattened(tree)


@query("""SELECT 'R' || r_regionkey AS id, r_name || chr(10) || chr(10) || 'nations' || chr(10) || chr(10) || string_agg('  [[N' || n_nationkey || ']] ' || n_name || chr(10) || chr(10) || '  ' || lower(n_name) || chr(10) || chr(10), '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def content_synthesis(t: Tables):
    e = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("abstract"), F.lit("nations").alias("overview"))
    p = t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("entity_id"), F.concat(F.lit("N"), "n_nationkey").alias("local_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("content"), F.lit(1).alias("depth"), F.col("n_nationkey").alias("position"))
    return H.synthesised(e, p)


@query(f"WITH a AS ({ATOM}) SELECT local_id, parent_id, name FROM a WHERE local_id = 'C7'")
def find_node(t: Tables):
    return H.found_node(t.atoms(), "C7").select("local_id", "parent_id", "name")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'entity' AS kind, CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT conv_id || '/t' || turn, 'atom', 't' || turn, text FROM conversations WHERE turn = 1")
def read_by_key(t: Tables):
    entities = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    atoms = t.conversations.select(F.col("conv_id").cast("string").alias("entity_id"), F.concat(F.lit("t"), "turn").alias("local_id"), F.col("text").alias("content"))
    keys = entities.where("CAST(id AS BIGINT) % 9 = 0").select(F.col("id").alias("key")).unionByName(atoms.where("local_id = 't1'").select(F.concat_ws("/", "entity_id", "local_id").alias("key")))
    return B.by_key(entities, atoms, keys)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def unsynced_entries(t: Tables):
    return B.unsynced(t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 == 0).alias("synced"))).select("id")


@query("SELECT doc_id AS id FROM documents WHERE text <> ''")
def complete_entries(t: Tables):
    return B.complete(t.entities()).select("id")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
def date_range(t: Tables):
    return B.between_days(t.events, "2024-01-03", "2024-01-05").select("event_id")


@query("SELECT count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0) AS valid, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 5 = 0) AS invalid FROM documents")
def mapping_check(t: Tables):
    m = t.documents.selectExpr("CAST(doc_id AS STRING) AS path", "CASE WHEN doc_id % 4 <> 0 THEN source END AS source_id", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS memory_id")
    return B.mapping_check(m)


@query("SELECT event_type AS mode, round(avg(value) FILTER (WHERE user_id % 2 = 0), 4) AS even, round(avg(value) FILTER (WHERE user_id % 2 = 1), 4) AS odd FROM events GROUP BY 1")
def mode_report(t: Tables):
    m = t.events.select(F.col("event_type").alias("mode"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("metric"), "value")
    return rounded(V.mode_report(m, ["even", "odd"]), "even", "odd", digits=4)


@query("SELECT p_partkey, substr(sha256(p_name || '|' || 'src/' || p_brand || '|' || '' || '|' || p_type || '|' || p_size || '|' || lower(p_name)), 1, 16) AS hash FROM part")
def node_hashes(t: Tables):
    p = t.part.select("p_partkey", F.col("p_name").alias("label"), F.concat(F.lit("src/"), "p_brand").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.col("p_type").alias("file_type"), F.col("p_size").alias("community"), F.lower("p_name").alias("norm_label"))
    return p.select("p_partkey", S.node_hash("label", "source_file", "source_location", "file_type", "community", "norm_label").alias("hash"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'unknown' WHEN 2 THEN 'rust' WHEN 3 THEN 'unknown' ELSE 'python' END AS sources, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'markdown' WHEN 2 THEN 'rust' WHEN 3 THEN 'unknown' ELSE 'python' END AS nodes FROM documents")
def languages_by_ending(t: Tables):
    path = F.concat(F.lit("a/b"), "doc_id", F.element_at(F.array(*[F.lit(x) for x in (".mts", ".md", ".RS", "", ".py")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return t.documents.select("doc_id", S.language(path, True).alias("sources"), S.language(path).alias("nodes"))


@query("SELECT issue_id AS fix_id FROM (SELECT event_id AS issue_id, ts FROM events WHERE event_type = 'click') x ORDER BY ts DESC, fix_id DESC LIMIT 10")
def fix_history(t: Tables):
    """The last fixes, newest first."""
    return B.recent(t.events.where("event_type = 'click'").select(F.col("event_id").alias("fix_id"), "ts"), 10, "ts", "fix_id").select("fix_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value < 5 THEN 'skipped' ELSE 'applied' END AS status FROM events")
def applied_fixes(t: Tables):
    issues = t.events.select("event_id", F.when((F.col("event_type") == "click") & (F.col("value") < 5), "merge_entities").when(F.col("event_type") == "view", "suggest_relations").otherwise("recalculate_weight").alias("action"))
    return Q.applied_fixes(issues).select("event_id", "status")


@query("SELECT length(id) AS n, count(DISTINCT id) AS ids, bool_and(day = CAST(day AS DATE)) AS in_order FROM (SELECT repeat('0', 26) || event_id AS x, 'x' AS id0, 1 AS k, CAST(ts AS DATE) AS day, lpad(CAST(event_id AS VARCHAR), 26, '0') AS id FROM events) y GROUP BY 1")
def sortable_ids(t: Tables):
    """Ids of 26 characters from time and a hash of the row: all differ, and sort by time."""
    e = t.events.select("event_id", S.sortable_id(F.expr("unix_millis(CAST(ts AS TIMESTAMP))"), "event_id").alias("id"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("ms"))
    # ranges of time are compared within, and each with the greatest id of the ranges before it
    placed = G.checkpointed(e.repartitionByRange("ms").withColumn("range", F.spark_partition_id()))
    earlier = F.max("most").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy("range").agg(F.max("id").alias("most")).select("range", earlier.alias("earlier"))
    before = F.max("id").over(Window.partitionBy("range").orderBy("ms").rangeBetween(Window.unboundedPreceding, -1))
    checked = placed.withColumn("before", before).join(ranges, "range").withColumn("ok", F.coalesce(F.greatest("before", "earlier") < F.col("id"), F.lit(True)))
    return checked.groupBy(F.length("id").cast("long").alias("n")).agg(F.count_distinct("id").alias("ids"), F.bool_and("ok").alias("in_order"))


@query("SELECT e1 AS representative, n AS size, n * (n - 1) // 2 AS pairs, id AS member FROM (SELECT id, min(id) OVER (PARTITION BY abstract) AS e1, count(*) OVER (PARTITION BY abstract) AS n FROM (SELECT doc_id AS id, substr(text, 1, 100) AS abstract FROM documents) x WHERE abstract <> '') y WHERE n > 1")
def duplicate_classes(t: Tables):
    return Q.duplicate_classes(t.entities().select("id", "abstract"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'cfg-' || lang WHEN 1 THEN '@' || source || '/' || lang WHEN 2 THEN 'pkg' || doc_id WHEN 3 THEN source || '-' || substr(md5('/w/' || source), 1, 8) ELSE 'm' || doc_id END AS project FROM documents""")
def project_ids(t: Tables):
    one = lambda k, x: F.when(F.col("doc_id") % 5 == k, x)
    return t.documents.select("doc_id", S.project_id(
        one(0, F.concat(F.lit("cfg-"), "lang")), one(1, F.concat(F.lit("https://host/"), "source", F.lit("/"), "lang", F.lit(".git"))), one(2, F.concat(F.lit("pkg"), "doc_id")), one(3, F.concat(F.lit("/w/"), "source")), F.concat(F.lit("m"), "doc_id"),
    ).alias("project"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'About ' || lang || ' | Of ' || source WHEN 1 THEN 'Of ' || source ELSE lang || ' plain ' || source END AS line FROM documents")
def one_line_abstracts(t: Tables):
    fence = lambda title, text: F.concat(F.lit(f"# ≡≡≡ {title} ≡≡≡\n```\n"), *text, F.lit("\n```\n"))
    head, about, of = F.lit("---\nid: 1\n---\n"), fence("Abstract", [F.lit("About\n"), "lang"]), fence("Overview", [F.lit("Of "), "source"])
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(head, about, of)).when(F.col("doc_id") % 3 == 1, F.concat(head, of)).otherwise(F.concat(head, "lang", F.lit("\nplain\n"), "source"))
    return t.documents.select("doc_id", S.one_line(text).alias("line"))


@query("SELECT doc_id, strlen(text)::BIGINT AS current, strlen(text) + 2 * (length(lang) + length(CAST(doc_id AS VARCHAR)) + 19) AS projected, strlen(text) + 2 * (length(lang) + length(CAST(doc_id AS VARCHAR)) + 19) <= 5000 AS ok FROM documents")
def projected_sizes(t: Tables):
    atoms = F.array(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("name")))
    return t.documents.select("doc_id", B.projected_size("text", atoms, 5000).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, 'x' || doc_id AS source, CASE WHEN doc_id % 2 = 0 THEN 'a,' || lang ELSE '' END AS names, CASE WHEN doc_id % 2 = 1 THEN 'n' || doc_id END AS namespace, doc_id % 3 = 0 AND doc_id % 2 = 0 AS is_default FROM documents")
def import_names(t: Tables):
    text = F.expr("CASE WHEN doc_id % 2 = 1 THEN concat('import * as n', doc_id, ' from \"x', doc_id, '\";') ELSE concat('import ', CASE WHEN doc_id % 3 = 0 THEN 'def, ' ELSE '' END, '{ a as b, ', lang, ' } from \"x', doc_id, '\";') END")
    d = t.documents.select("doc_id", F.explode(C.import_names(text)).alias("i"))
    return d.select("doc_id", "i.source", F.array_join("i.names", ",").alias("names"), "i.namespace", "i.is_default")


@query("SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.event_id <= e.event_id)")
def replay_until_failure(t: Tables):
    return Y.replayed(t.events, "user_id", ["event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query(f"""WITH RECURSIVE a AS ({ATOM}), t AS (SELECT local_id, heading_level, name AS path FROM a WHERE parent_id IS NULL OR parent_id NOT IN (SELECT local_id FROM a) UNION ALL SELECT a.local_id, a.heading_level, t.path || ' > ' || a.name FROM a JOIN t ON a.parent_id = t.local_id)
  SELECT local_id, path AS breadcrumb, (SELECT count(*) FROM t WHERE heading_level <= 3) AS shown, (SELECT count(*) FROM a) AS total FROM t WHERE heading_level <= 3""")
def level_load(t: Tables):
    return H.level_load(t.atoms(), 3, 4).select("local_id", "breadcrumb", "shown", "total")


@query(f"WITH {PATHS} SELECT path, 2 AS functions, 1 AS classes, CASE k WHEN 0 THEN 2 ELSE 1 END AS imports FROM d")
def upload_rows(t: Tables):
    return P.upload_rows(C.analysed(_sources(t))).select("path", "functions", "classes", "imports")


@query("SELECT event_id AS fix_id FROM events WHERE event_type = 'view' OR user_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 10")
def fix_batch_history(t: Tables):
    """A history and a batch; some are in one only, and the newest ten stay."""
    e = t.events.select(F.col("event_id").alias("fix_id"), "ts", "event_type", "user_id")
    return Q.fix_history(e.where("event_type = 'view'").select("fix_id", "ts"), e.where("event_type <> 'view' AND user_id % 2 = 0").select("fix_id", "ts")).select("fix_id")


@query("WITH e AS (SELECT l_suppkey AS from_id, l_partkey AS to_id, l_returnflag AS type FROM lineitem) SELECT from_id, to_id, type, count(*) AS n FROM e WHERE NOT (type = 'A' AND from_id % 3 = 0) GROUP BY 1, 2, 3")
def deleted_edges(t: Tables):
    e = t.lineitem.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("type"))
    left = G.delete_edges(e, e.where("type = 'A' AND from_id % 3 = 0").distinct())
    return left.groupBy("from_id", "to_id", "type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'note' || doc_id AS id, lang AS type, '[' || source || ']' AS tags FROM documents")
def frontmatter_fields(t: Tables):
    text = F.format_string("---\nid: note%d\ntype: %s\ntags: [%s]\nno colon here\n---\nbody: x", "doc_id", "lang", "source")
    m = t.documents.select("doc_id", S.frontmatter(text).alias("m"))
    return m.select("doc_id", F.try_element_at("m", F.lit("id")).alias("id"), F.try_element_at("m", F.lit("type")).alias("type"), F.try_element_at("m", F.lit("tags")).alias("tags"))


CHANGED = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN lang || ' ' || source || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7 OR doc_id % 20 = 7"""


def _segmented(t: Tables):
    """All documents; a tenth again with another text; a tenth deleted, and half of it added again. Then the index is opened anew."""
    path = V_.folder(G.checkpoint_folder(t.spark), "segment-index")
    index = SG.SegmentIndex.open(t.spark, path).add(t.documents)
    index = index.add(t.documents.where("doc_id % 10 = 3").select("doc_id", F.concat_ws(" ", "lang", "source", "text").alias("text")))
    index = index.delete(t.documents.where("doc_id % 10 = 7").select(F.col("doc_id").alias("id")))
    index.add(t.documents.where("doc_id % 20 = 7"))
    return SG.SegmentIndex.open(t.spark, path)


@query(_index_sql(CHANGED))
def segment_search(t: Tables):
    return rounded(_segmented(t).search(_asked(t)), "score", digits=4)


@query(f"WITH c AS ({CHANGED}) SELECT doc_id AS id, CAST(len({TOKENS}) AS INTEGER) AS dl FROM c")
def segment_lengths(t: Tables):
    return _segmented(t).lengths()


def _prefixes(t: Tables, gone: str):
    """The words of all documents, stored; then some documents leave, and the dictionary is opened anew."""
    path = V_.folder(G.checkpoint_folder(t.spark), "prefix-index")
    PX.PrefixIndex.open(t.spark, path).add(R.vocabulary(t.documents)).delete(t.documents.where(gone).select(F.col("doc_id").alias("id")))
    return PX.PrefixIndex.open(t.spark, path)


KEPT = VOCAB.replace("FROM documents", "FROM documents WHERE lang IS DISTINCT FROM 'de'")


@query(f"WITH {KEPT} SELECT word, CAST(sum(weight) AS BIGINT) AS frequency, count(*) AS n_entries FROM v WHERE word LIKE 'th%' GROUP BY word ORDER BY frequency DESC, word LIMIT 10")
def stored_autocomplete(t: Tables):
    return _prefixes(t, "lang = 'de'").autocomplete("th")


@query(f"WITH {KEPT} SELECT word, CAST(sum(weight) AS BIGINT) AS frequency, count(*) AS n_entries FROM v WHERE word LIKE 'licen%' GROUP BY word ORDER BY frequency DESC, word LIMIT 25")
def stored_autocomplete_long(t: Tables):
    return _prefixes(t, "lang = 'de'").autocomplete("licen", 25)


@query(f"WITH {KEPT} SELECT DISTINCT id FROM v WHERE word LIKE 'lic%'")
def stored_prefix_search(t: Tables):
    return _prefixes(t, "lang = 'de'").search("lic")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT q.vec_id AS from_id, e.vec_id AS to_id, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS similarity FROM q JOIN e ON q.vec_id <> e.vec_id)
  SELECT from_id, to_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(similarity, 9) DESC, to_id) AS rank FROM s WHERE similarity >= 0.3) x WHERE rank <= 10""")
def near_by_lists(t: Tables):
    """The ten nearest of every hundredth vector by the lists of all, with the reach that loses nothing."""
    lists = VL.VectorLists.of(t.embeddings)
    return rounded(lists.near(t.embeddings.where("vec_id % 100 = 0"), 10, 0.3, reach=2), "similarity")
