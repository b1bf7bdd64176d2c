"""Queries: edges, neighbours, traversal, components, import, recommendation, network quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import quality as Q
from tessera.operators import recommend as C
from tessera.plans.registry import EDGE, NODE, Tables, query, rounded, values

E, N = f"e AS ({EDGE})", f"n AS ({NODE})"


@query(f"WITH {E} SELECT to_id AS id, type, round(weight, 6) AS weight, 'out' AS direction FROM e WHERE from_id = 'S1' UNION ALL SELECT from_id, type, round(weight, 6), 'in' FROM e WHERE to_id = 'S1'")
def neighbors_both(t: Tables):
    return rounded(G.neighbours(t.edges(), "S1"), "weight")


@query(f"WITH {E} SELECT from_id AS id, type, round(weight, 6) AS weight FROM e WHERE to_id = 'P7'")
def in_refs(t: Tables):
    return rounded(G.neighbours(t.edges(), "P7", "in").drop("direction"), "weight")


@query(f"WITH {E} SELECT to_id AS id, type, round(weight, 6) AS weight FROM e WHERE from_id = 'S3' AND type = 'calls'")
def out_deps(t: Tables):
    return rounded(G.neighbours(t.edges(), "S3", "out", "calls").drop("direction"), "weight")


@query(f"""WITH {E}, u AS (SELECT DISTINCT from_id, to_id FROM e), b AS (SELECT from_id, to_id FROM u UNION SELECT to_id, from_id FROM u),
  d1 AS (SELECT DISTINCT to_id AS id FROM b WHERE from_id = 'S1'), d2 AS (SELECT DISTINCT b.to_id AS id FROM b JOIN d1 ON b.from_id = d1.id), d3 AS (SELECT DISTINCT b.to_id AS id FROM b JOIN d2 ON b.from_id = d2.id)
  SELECT id, min(depth) AS depth FROM (SELECT 'S1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3) x GROUP BY id""")
def khop_traverse(t: Tables):
    return G.traverse(t.edges(), values(t.spark, [("S1",)], "id string"), 3, directed=False)


@query(f"WITH {E}, x AS (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) SELECT id, count(*) AS degree FROM x GROUP BY id")
def degrees(t: Tables):
    return G.degrees(t.edges())


@query(f"WITH {E}, x AS (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e), d AS (SELECT id, count(*) AS degree FROM x GROUP BY id) SELECT id, degree FROM d WHERE degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM d)")
def degree_hubs(t: Tables):
    return G.hubs(t.edges())


@query(f"WITH {E}, {N}, x AS (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e), d AS (SELECT id, count(*) AS c FROM x GROUP BY id) SELECT n.id, coalesce(c, 0) AS degree, CASE WHEN coalesce(c, 0) < 2 THEN 'under' WHEN c > 20 THEN 'over' ELSE 'ok' END AS flag FROM n LEFT JOIN d ON n.id = d.id")
def linkage_flags(t: Tables):
    return G.linkage_flags(t.edges(), t.nodes())


# Label propagation written out: eight rounds reach every node of this bipartite graph.
ROUNDS = ", ".join(f"l{k} AS (SELECT l.id, least(l.c, coalesce(min(m.c), l.c)) AS c FROM l{k - 1} l LEFT JOIN b ON b.x = l.id LEFT JOIN l{k - 1} m ON m.id = b.y GROUP BY l.id, l.c)" for k in range(1, 9))


@query(f"WITH {E}, {N}, b AS (SELECT from_id AS x, to_id AS y FROM e UNION SELECT to_id, from_id FROM e), l0 AS (SELECT id, id AS c FROM n), {ROUNDS} SELECT id, c AS component FROM l8")
def components(t: Tables):
    return G.components(t.edges(), t.nodes())


@query(f"WITH {E}, {N} SELECT id FROM n WHERE id NOT IN (SELECT from_id FROM e UNION SELECT to_id FROM e)")
def isolated_entities(t: Tables):
    return G.isolated(t.nodes(), t.edges())


@query(f"WITH {E}, {N} SELECT id FROM n WHERE id NOT IN (SELECT to_id FROM e)")
def unreferenced(t: Tables):
    return G.unreferenced(t.nodes(), t.edges())


@query(f"WITH {E}, {N} SELECT id FROM n WHERE id NOT IN (SELECT from_id FROM e)")
def missing_relations(t: Tables):
    return G.without_out_edges(t.nodes(), t.edges())


METRICS = f"""{E}, {N}, k AS (SELECT (SELECT count(*) FROM n) AS entity_count, (SELECT count(*) FROM e) AS relationship_count,
  (SELECT count(*) FROM n WHERE id NOT IN (SELECT from_id FROM e UNION SELECT to_id FROM e)) AS isolated_entities),
  m AS (SELECT *, CASE WHEN entity_count < 2 THEN 0 ELSE relationship_count / (entity_count * (entity_count - 1) / 2.0) END AS network_density, relationship_count * 1.0 / entity_count AS avg_relations FROM k)"""


@query(f"WITH {METRICS} SELECT entity_count, relationship_count, isolated_entities, round(network_density, 6) AS network_density, round(avg_relations, 6) AS avg_relations FROM m")
def network_density(t: Tables):
    return rounded(Q.network_metrics(t.nodes(), t.edges()), "network_density", "avg_relations")


@query(f"""WITH {METRICS}, s AS (SELECT least(100, 0.5 * entity_count) AS c, least(100, 2000 * network_density) AS r, 40.0 AS a FROM m)
  SELECT round(c, 6)::DOUBLE AS coverage_score, round(r, 6)::DOUBLE AS relation_score, round(a, 6)::DOUBLE AS search_score, floor((c + r + a) / 3 + 0.5)::DOUBLE AS health_score,
  CASE WHEN floor((c + r + a) / 3 + 0.5) >= 90 THEN 'A' WHEN floor((c + r + a) / 3 + 0.5) >= 80 THEN 'B' WHEN floor((c + r + a) / 3 + 0.5) >= 70 THEN 'C' WHEN floor((c + r + a) / 3 + 0.5) >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score(t: Tables):
    m = Q.health_scores(Q.network_metrics(t.nodes(), t.edges()), F.lit(0.4))
    return rounded(m.select("coverage_score", "relation_score", "search_score", "health_score", "grade"), "coverage_score", "relation_score", "search_score")


@query(f"WITH {METRICS} SELECT greatest(floor((least(100, 0.5 * entity_count) + least(100, 2000 * network_density)) / 2 - least(30, 2.0 * isolated_entities) + 0.5), 0)::DOUBLE AS health FROM m")
def light_health(t: Tables):
    return Q.network_metrics(t.nodes(), t.edges()).select(Q.light_health(None).alias("health"))


@query(f"WITH {E} SELECT type, count(*) AS n FROM e GROUP BY type")
def relation_type_distribution(t: Tables):
    return t.edges().groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {E}, b AS (SELECT CASE WHEN weight >= 0.8 THEN 'strong' WHEN weight >= 0.5 THEN 'medium' WHEN weight >= 0.3 THEN 'weak' ELSE 'none' END AS band, weight FROM e) SELECT band, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM b GROUP BY band")
def weight_bands(t: Tables):
    e = t.edges().withColumn("band", G.weight_band("weight"))
    return rounded(e.groupBy("band").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight")), "avg_weight")


@query(f"""WITH {E}, c AS (SELECT *, count(*) OVER (PARTITION BY from_id, to_id, type) AS k FROM e), i AS (SELECT concat_ws(',', CASE WHEN NOT (weight BETWEEN 0.3 AND 1.0) THEN 'weight' END, CASE WHEN type = 'extends' THEN 'type' END, CASE WHEN k > 1 THEN 'duplicate' END) AS issues FROM c)
  SELECT issues, count(*) AS n FROM i GROUP BY issues""")
def edge_validation(t: Tables):
    return G.validated(t.edges()).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT from_id, to_id, type, round(max(weight), 6) AS weight FROM e GROUP BY 1, 2, 3")
def dedup_edges(t: Tables):
    return rounded(G.distinct_edges(t.edges()), "weight")


@query(f"WITH {E}, x AS (SELECT from_id AS id FROM e UNION SELECT to_id FROM e) SELECT id FROM x")
def edge_endpoints(t: Tables):
    return G.endpoints(t.edges())


DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
KNN = f"p AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, {DOT} AS similarity FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 50) a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(similarity, 9) DESC, to_id) AS rank FROM p WHERE similarity >= 0.2) y WHERE rank <= 5)"


@query(f"WITH {KNN} SELECT from_id, to_id, round(similarity, 6) AS similarity, rank FROM k")
def knn_recommend(t: Tables):
    """The rule recommends for the first fifty vectors only."""
    return rounded(C.similar_to(t.embeddings, 50, 5, 0.2), "similarity")


@query(f"""WITH p AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, {DOT} AS similarity FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT from_id, to_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(similarity, 9) DESC, to_id) AS rank FROM p WHERE similarity >= 0.1) y WHERE rank <= 10""")
def knn_every_hundredth(t: Tables):
    """All vectors whose id is divisible by 100 against all vectors."""
    return rounded(C.similar_in_blocks(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 10, 0.1, block=2), "similarity")


@query(f"WITH {KNN} SELECT k.from_id, k.to_id FROM k WHERE NOT (k.to_id % 2 = 0 AND k.from_id % 2 = 0)")
def knn_without_existing(t: Tables):
    e = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").cast("long").alias("id"))
    known = C.similar_to(t.embeddings, 50, 5, 0.2)
    linked = known.where("from_id % 2 = 0").join(e, known.to_id == e.id, "left_semi").select("from_id", "to_id")
    return C.without_existing(known, linked).select("from_id", "to_id")


@query(f"WITH {KNN}, u AS (SELECT *, row_number() OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id) ORDER BY round(similarity, 9) DESC, from_id) AS n FROM k) SELECT CASE WHEN similarity >= 0.4 THEN 'auto' WHEN similarity >= 0.3 THEN 'review' ELSE 'ignored' END AS route, count(*) AS n FROM u WHERE n = 1 GROUP BY 1")
def dual_threshold(t: Tables):
    return C.routed(C.similar_to(t.embeddings, 50, 5, 0.2), 0.4, 0.3).groupBy("route").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id AS a, doc_id + 20 AS b FROM documents WHERE doc_id % 3 = 0), x AS (SELECT a.doc_id AS from_id, b.doc_id AS to_id, a.source AS type, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS n FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.a = a.doc_id AND l.b = b.doc_id)) SELECT from_id, to_id, type, 0.76::DOUBLE AS weight FROM x WHERE n <= 3")
def same_type_recommend(t: Tables):
    d = t.documents
    return C.same_type(d.select(F.col("doc_id").alias("id"), F.col("source").alias("type")), d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("from_id"), (F.col("doc_id") + 20).alias("to_id")))


@query(f"""WITH {E}, {N}, g AS (SELECT * FROM e), w AS (SELECT * FROM g WHERE weight < 0.5),
  ent AS (SELECT id, CASE WHEN substr(id, 1, 1) = 'S' THEN '' ELSE 'part ' || (CAST(substr(id, 2) AS BIGINT) % 150) END AS abstract FROM n)
  SELECT issue, severity, action, count(*) AS n FROM (
  SELECT 'isolated' AS issue, 'high' AS severity, 'suggest_relations' AS action FROM n WHERE id NOT IN (SELECT from_id FROM g UNION SELECT to_id FROM g)
  UNION ALL SELECT 'missing_relations', 'medium', 'suggest_relations' FROM n WHERE id NOT IN (SELECT from_id FROM g)
  UNION ALL SELECT 'missing_fields', 'low', 'fill_missing_fields' FROM ent WHERE abstract = '' UNION ALL SELECT 'low_weight', 'medium', 'recalculate_weight' FROM w
  UNION ALL SELECT 'duplicate', 'high', 'merge_entities' FROM ent WHERE abstract <> '' AND abstract IN (SELECT abstract FROM ent GROUP BY abstract HAVING count(*) > 1)) x GROUP BY 1, 2, 3""")
def diagnose_issues(t: Tables):
    ent = t.nodes().withColumn("abstract", F.when(F.col("id").startswith("S"), "").otherwise(F.concat(F.lit("part "), F.expr("CAST(substr(id, 2) AS BIGINT) % 150"))))
    return Q.diagnosed(ent, t.edges()).groupBy("issue", "severity", "action").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT CAST(l AS BIGINT) AS n, round(greatest(0.5, weight + 0.2), 6) AS new_weight FROM (SELECT weight, count(*) AS l FROM e WHERE weight < 0.5 GROUP BY weight) x")
def apply_fix(t: Tables):
    weak = t.edges().where("weight < 0.5").groupBy("weight").agg(F.count("*").alias("n"))
    return weak.select("n", F.round(Q.fixed_weight("weight"), 6).alias("new_weight"))


@query(f"WITH {E}, {N} SELECT count(*) AS unreferenced, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'INCOMPLETE' END AS status FROM n WHERE substr(id, 1, 1) = 'P' AND id NOT IN (SELECT to_id FROM e)")
def upload_completeness(t: Tables):
    return Q.completeness(t.nodes().where(F.col("id").startswith("P")), t.edges())
