"""Queries: hierarchies, links, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import hierarchy as H
from tessera.operators import retrieval as R
from tessera.plans.registry import ATOM, Tables, query, rounded

REC = f"""WITH RECURSIVE a AS ({ATOM}), t AS (SELECT local_id, parent_id, 1 AS depth, name AS path FROM a WHERE parent_id IS NULL OR parent_id NOT IN (SELECT local_id FROM a)
  UNION ALL SELECT a.local_id, a.parent_id, t.depth + 1, t.path || ' > ' || a.name FROM a JOIN t ON a.parent_id = t.local_id)"""


@query(f"{REC} SELECT local_id, parent_id, depth, path FROM t")
def tree_paths(t: Tables):
    return H.tree_paths(t.atoms(), 4)


@query(f"{REC} SELECT local_id, path AS breadcrumb FROM t WHERE depth = 4")
def breadcrumbs(t: Tables):
    return H.tree_paths(t.atoms(), 4).where("depth = 4").select("local_id", F.col("path").alias("breadcrumb"))


@query(f"""WITH RECURSIVE a AS ({ATOM}), t AS (SELECT local_id, parent_id, 1 AS depth FROM a WHERE parent_id = 'R1' UNION ALL SELECT a.local_id, a.parent_id, t.depth + 1 FROM a JOIN t ON a.parent_id = t.local_id)
  SELECT local_id, parent_id, depth FROM t""")
def tree_descendants(t: Tables):
    return H.descendants(t.atoms(), "R1", 4)


@query(f"SELECT local_id, parent_id, name, heading_level FROM ({ATOM}) x WHERE heading_level <= 3")
def tree_level_filter(t: Tables):
    return H.level_filter(t.atoms(), 3, 4)


@query(f"{REC} SELECT depth, count(*) AS n FROM t GROUP BY depth")
def tree_depth_counts(t: Tables):
    return H.tree_paths(t.atoms(), 4).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH a AS ({ATOM}) SELECT a.local_id, coalesce(p.heading_level + 1, 1) AS derived_level FROM a LEFT JOIN a p ON a.parent_id = p.local_id")
def heading_levels(t: Tables):
    return H.heading_levels(t.atoms()).select("local_id", "derived_level")


LINKED = "SELECT CAST(doc_id AS VARCHAR) AS local_id, 'see [[' || (doc_id + 1) || '|next]] and ![[' || (doc_id * 2) || ']] in [[' || source || '/' || lang || ']]' AS content FROM documents"


def _linked(t: Tables):
    c = F.format_string("see [[%d|next]] and ![[%d]] in [[%s/%s]]", F.col("doc_id") + 1, F.col("doc_id") * 2, "source", "lang")
    return t.documents.select(F.col("doc_id").cast("string").alias("local_id"), F.lit(None).cast("string").alias("parent_id"), c.alias("content"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS source, CAST(doc_id + 1 AS VARCHAR) AS target, NULL AS entity_id, 'next' AS label, false AS is_embed FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id * 2 AS VARCHAR), NULL, NULL, true FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, source, NULL, false FROM documents""")
def wiki_links(t: Tables):
    return H.with_links(_linked(t))


@query("SELECT CAST(doc_id AS VARCHAR) AS source, x AS target FROM (SELECT doc_id, unnest([CAST(doc_id + 1 AS VARCHAR), CAST(doc_id * 2 AS VARCHAR)]) AS x FROM documents) y WHERE x NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)")
def dangling_links(t: Tables):
    return H.dangling_links(_linked(t))


@query("SELECT CAST(doc_id AS VARCHAR) AS source, source AS entity_id, lang AS target FROM documents")
def cross_entity_links(t: Tables):
    return H.cross_entity_links(_linked(t))


@query("SELECT * FROM (VALUES ('9', 'next'), ('5', NULL)) AS t(source, label)")
def backlinks(t: Tables):
    return H.backlinks(_linked(t), "10")


@query(f"WITH a AS ({LINKED}), x AS (SELECT CAST(doc_id AS VARCHAR) AS local_id, unnest([CAST(doc_id + 1 AS VARCHAR), CAST(doc_id * 2 AS VARCHAR)]) AS l FROM documents) SELECT a.local_id, (SELECT string_agg(DISTINCT l, ',' ORDER BY l) FROM x WHERE x.local_id = a.local_id AND l NOT IN (SELECT local_id FROM a)) AS dead FROM a")
def mark_dead_links(t: Tables):
    return H.mark_dead_links(_linked(t)).select("local_id", F.array_join("dead_links", ",").alias("dead"))


@query(f"""{REC}, c AS (SELECT local_id, parent_id, name || CASE WHEN parent_id IS NULL THEN '' ELSE ' [[' || parent_id || ']]' END AS content FROM a)
  SELECT (SELECT round(avg(depth), 6) FROM t) AS avg_depth, round(stddev_pop(length(content)), 6) AS content_std, round(count(parent_id) * 1.0 / count(*), 6) AS link_density,
  round(count(*) FILTER (WHERE parent_id IS NULL AND local_id NOT IN (SELECT parent_id FROM a WHERE parent_id IS NOT NULL)) * 1.0 / count(*), 6) AS orphan_rate FROM c""")
def link_density(t: Tables):
    """Every row links to its parent."""
    a = t.atoms().withColumn("content", F.concat("name", F.when(F.col("parent_id").isNull(), "").otherwise(F.concat(F.lit(" [["), "parent_id", F.lit("]]")))))
    return rounded(H.tree_metrics(a, 4), "avg_depth", "content_std", "link_density", "orphan_rate")


@query(f"WITH a AS ({ATOM}) SELECT local_id, parent_id FROM a WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT local_id FROM a)")
def dangling_parents(t: Tables):
    return H.dangling_parents(t.atoms())


@query(f"{REC} SELECT local_id, repeat('#', CAST(depth AS INTEGER)) || ' ' || string_split(path, ' > ')[-1] || chr(10) || chr(10) || path AS markdown FROM t")
def rendered_markdown(t: Tables):
    p = H.tree_paths(t.atoms(), 4)
    named = p.select("local_id", "depth", F.element_at(F.split("path", " > "), -1).alias("name"))
    return H.rendered(named, p.select("local_id", F.col("path").alias("content")))


ITEMS = """SELECT source AS entity_id, CAST(doc_id AS VARCHAR) AS local_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, round(((doc_id * 37) % 101) / 101.0, 6)::DOUBLE AS relevance, CAST(doc_id % 3 + 1 AS INTEGER) AS heading_level, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ord FROM documents"""


def _items(t: Tables):
    return t.documents.select(
        F.col("source").alias("entity_id"), F.col("doc_id").cast("string").alias("local_id"), S.estimate_tokens("text").alias("tokens"), F.round(((F.col("doc_id") * 37) % 101) / 101.0, 6).alias("relevance"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("heading_level"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("order"),
    )


def _greedy(order: str, budget: int) -> str:
    return f"""WITH RECURSIVE i AS ({ITEMS}), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS n FROM i),
  g AS (SELECT entity_id, 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS local_id, false AS hit FROM (SELECT DISTINCT entity_id FROM o) x
  UNION ALL SELECT g.entity_id, o.n, CASE WHEN g.used + o.tokens <= {budget} THEN g.used + o.tokens ELSE g.used END, o.local_id, g.used + o.tokens <= {budget} FROM g JOIN o ON o.entity_id = g.entity_id AND o.n = g.n + 1)
  SELECT g.entity_id, m.used, round(m.used * 100.0 / {budget}, 6) AS utilisation, g.local_id FROM g JOIN (SELECT entity_id, max(used) AS used FROM g GROUP BY 1) m USING (entity_id) WHERE hit"""


@query(_greedy("relevance DESC, ord, local_id, tokens", 4000))
def budget_relevance(t: Tables):
    return rounded(R.budget_select(_items(t), 4000), "utilisation")


@query(_greedy("heading_level, relevance DESC, local_id, tokens", 4000))
def budget_hierarchy(t: Tables):
    return rounded(R.budget_select(_items(t), 4000, "hierarchy"), "utilisation")


@query("SELECT source AS entity_id, round(0::DOUBLE + sum(CASE WHEN doc_id % 2 = 0 THEN ceil(length(text) / 4.0) END) * 100.0 / sum(ceil(length(text) / 4.0)), 6) AS share FROM documents GROUP BY source")
def context_savings(t: Tables):
    tok = S.estimate_tokens("text")
    return rounded(t.documents.groupBy(F.col("source").alias("entity_id")).agg((F.sum(F.when(F.col("doc_id") % 2 == 0, tok)) * 100.0 / F.sum(tok)).alias("share")), "share")
