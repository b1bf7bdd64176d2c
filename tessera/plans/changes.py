"""Queries: diffs, fingerprints, sync, queues, streams' batch twins, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import browse as B
from tessera.operators import recommend as C
from tessera.operators import sync as Y
from tessera.operators.graph import checkpointed
from tessera.plans.registry import Tables, query
from tessera.streaming import feeds as M

OLD = "o AS (SELECT o_orderkey AS id, substr(sha256(o_orderstatus || '|' || o_orderpriority), 1, 16) AS hash FROM orders WHERE o_orderkey % 10 <> 0)"
NEW = "w AS (SELECT o_orderkey AS id, substr(sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority), 1, 16) AS hash FROM orders WHERE o_orderkey % 10 <> 1)"
CHANGE = "CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' WHEN o.hash <> w.hash THEN 'changed' ELSE 'unchanged' END"


def _snapshots(t: Tables):
    h = lambda s: S.short_hash(F.concat_ws("|", s, "o_orderpriority")).alias("hash")
    old = t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), h(F.col("o_orderstatus")))
    new = t.orders.where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("id"), h(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return old, new


@query(f"WITH {OLD}, {NEW} SELECT coalesce(o.id, w.id) AS id, {CHANGE} AS change FROM o FULL JOIN w ON o.id = w.id")
def graph_diff(t: Tables):
    return Y.node_diff(*_snapshots(t))


LINK = "SELECT DISTINCT l_orderkey AS source, l_partkey AS target, l_returnflag AS relation FROM lineitem"


def _links(t: Tables):
    x = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"))
    return x.where("source % 5 <> 0"), x.where("source % 5 <> 1")


@query(f"WITH l AS ({LINK}) SELECT source, target, relation, CASE WHEN source % 5 = 0 THEN 'added' ELSE 'removed' END AS change FROM l WHERE source % 5 IN (0, 1)")
def link_diff(t: Tables):
    return Y.link_diff(*_links(t))


@query(f"WITH l AS ({LINK}), {OLD}, {NEW}, c AS (SELECT o.id FROM o JOIN w ON o.id = w.id WHERE o.hash <> w.hash) SELECT source, target, relation FROM l WHERE source % 5 <> 1 AND (source IN (SELECT id FROM c) OR target IN (SELECT id FROM c))")
def remappable(t: Tables):
    changed = Y.node_diff(*_snapshots(t)).where("change = 'changed'").select("id")
    return Y.remappable(_links(t)[1], changed)


@query(f"WITH {OLD}, {NEW}, x AS (SELECT CASE WHEN w.id IS NULL THEN 'upload' WHEN o.id IS NULL THEN 'delete' WHEN o.hash <> w.hash THEN 'conflict' ELSE 'same' END AS action FROM o FULL JOIN w ON o.id = w.id) SELECT action, count(*) AS n FROM x GROUP BY action")
def sync_preview(t: Tables):
    old, new = (x.withColumnRenamed("id", "source_id") for x in _snapshots(t))
    return Y.sync_preview(old, new).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'new_file' WHEN doc_id % 4 = 1 THEN 'content_changed' WHEN doc_id % 4 = 2 THEN 'symbols_changed' ELSE 'unchanged' END AS status FROM documents")
def fingerprint_status(t: Tables):
    now = checkpointed(Y.fingerprints(t.documents.select("doc_id", "text")))
    old = now.where("path % 4 <> 0").withColumns({"content_hash": F.when(F.col("path") % 4 == 1, "?").otherwise(F.col("content_hash")), "symbols_hash": F.when(F.col("path") % 4 == 2, "?").otherwise(F.col("symbols_hash"))})
    return Y.fingerprint_status(now, old)


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, md5(text) AS md5 FROM documents")
def content_hashes(t: Tables):
    return t.documents.select("doc_id", S.short_hash("text").alias("content_hash"), F.md5("text").alias("md5"))


@query("SELECT a.doc_id FROM documents a WHERE a.doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def upload_duplicates(t: Tables):
    d = t.documents
    return Y.duplicates_on_upload(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert(t: Tables):
    c = t.customer.select("c_custkey", "c_mktsegment")
    return Y.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1")
def newest_per_key(t: Tables):
    return Y.newest(t.events.select("user_id", "event_id", "ts"), "user_id", "ts")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 5 < 3) AS pending, count(*) FILTER (WHERE event_id % 5 >= 3) AS exhausted FROM events")
def queue_stats(t: Tables):
    return Y.queue_stats(t.events.withColumn("retry_count", F.col("event_id") % 5))


@query("SELECT event_id AS id, event_id % 5 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS retry_count FROM events WHERE event_id % 7 <> 0")
def retry_round(t: Tables):
    q = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("retry_count"))
    return Y.after_attempt(q, q.where("id % 2 = 0"), q.where("id % 7 = 0"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS")
def ttl_expiry(t: Tables):
    return Y.unexpired(t.events, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 7, "ts").select("event_id")


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3600 SECONDS AS "end", count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM g GROUP BY user_id, s""")
def debounce_sessions(t: Tables):
    return M.debounced(t.events, gap="3600 seconds")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def microbatch_counts(t: Tables):
    return M.windowed_counts(t.events)


@query("SELECT user_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1 AND event_type <> 'error'")
def feed_apply(t: Tables):
    action = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "CREATE").otherwise("UPDATE")
    return M.latest_state(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"), "value"))


SIGNAL = "(CASE WHEN regexp_matches(text, '(?i)\\b(decided|decision|we will|let''s use|chose)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(fixed|solved|solution|the fix|resolved)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(pattern|always|best practice|convention)\\b') THEN 1 ELSE 0 END)"


@query(f"SELECT conv_id, turn, {SIGNAL} AS signals, CASE WHEN {SIGNAL} >= 2 THEN 'high' WHEN {SIGNAL} = 1 THEN 'medium' ELSE 'reject' END AS confidence FROM conversations")
def signal_phrases(t: Tables):
    return C.signals(t.conversations).select("conv_id", "turn", F.size("kinds").alias("signals"), "confidence")


@query("SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id HAVING count(*) >= 3")
def session_selection(t: Tables):
    done = t.conversations.where("conv_id % 10 = 0").select("conv_id").distinct()
    return C.sessions(t.conversations, done, 3)


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY role")
def role_distribution(t: Tables):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("SELECT page_id, length(html) AS n, CAST(len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS INTEGER) AS links FROM pages")
def page_links(t: Tables):
    return t.pages.select("page_id", F.length("html").cast("long").alias("n"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("links"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(t: Tables):
    from tessera.sources.readers import json_field

    return t.events.select("event_id", json_field("props", "$.k", "bigint").alias("k"))


PATH = "'/project/' || source || CASE doc_id % 5 WHEN 0 THEN '/.env' WHEN 1 THEN '/.ssh/id_rsa' WHEN 2 THEN '/config.json' WHEN 3 THEN '/src/index.js' ELSE '/node_modules/x.js' END"


@query(f"SELECT doc_id, {PATH} AS path, doc_id % 5 <> 3 AS excluded FROM documents")
def excluded_paths(t: Tables):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/.env", "/.ssh/id_rsa", "/config.json", "/src/index.js", "/node_modules/x.js")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(F.lit("/project/"), "source", tail).alias("path")).withColumn("excluded", B.excluded("path"))


def _kinds(text: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({text}, '{quoted(p)}') THEN '{k}' END" for k, p in B.SENSITIVE.items()) + ")"


LEAKS = """CASE doc_id % 9 WHEN 0 THEN 'password: "hunter22"' WHEN 1 THEN 'api-key = "abcd1234"' WHEN 2 THEN 'aws_access_key_id="AKIA1234"' WHEN 3 THEN 'Bearer abcdef.ghijkl' WHEN 4 THEN 'use MONGO_URI' WHEN 5 THEN 'connection_string: "Server=x"' WHEN 6 THEN 'database-url="x://y"' WHEN 7 THEN 'private_key: ' ELSE 'eyJhbGciOiJIUzI1NiIsInR5cCI6Ik' END"""


@query(f"SELECT doc_id, {_kinds('text')} AS types, {_kinds('leak')} AS planted FROM (SELECT *, {LEAKS} AS leak FROM documents) d")
def sensitive_scan(t: Tables):
    d = t.documents.withColumn("leak", F.expr(LEAKS))
    return d.select("doc_id", F.array_join(B.sensitive_types("text"), ",").alias("types"), F.array_join(B.sensitive_types("leak"), ",").alias("planted"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 'error' WHEN strlen(text) >= 18000 THEN 'warn' ELSE 'ok' END AS status FROM documents")
def size_check(t: Tables):
    return t.documents.select("doc_id", B.size_status("text", 20_000).alias("status"))
