"""Queries: tokenizers, BM25, prefixes, substring search, vectors, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import evaluate as V
from tessera.operators import retrieval as R
from tessera.operators.graph import checkpointed
from tessera.plans.registry import ENTITY, TOKENS, Tables, query, rounded

BM25_CTE = f"""tok AS (SELECT doc_id, {TOKENS} AS ts FROM documents),
  post AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) x GROUP BY doc_id, term),
  st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok)"""
SCORE = "ln((st.n - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.avgdl))"


def one_query(terms: list[str], limit: int, extra: str = "") -> str:
    q = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    return f"""WITH {BM25_CTE}, q(term, n) AS (VALUES {q}), d AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  s AS (SELECT p.doc_id AS id, sum(q.n * {SCORE}) AS score FROM post p JOIN q ON p.term = q.term JOIN d ON d.term = p.term CROSS JOIN st GROUP BY p.doc_id)
  {extra or f'SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY score DESC, id LIMIT {limit}'}"""


@query(one_query(["the", "data", "license"], 10))
def bm25_search_top10(t: Tables):
    return rounded(R.bm25_search(t.documents, ["the", "data", "license"]), "score")


@query(one_query(["license", "license", "token"], 20))
def bm25_repeated_term(t: Tables):
    return rounded(R.bm25_search(t.documents, ["license", "license", "token"], 20), "score")


@query(f"SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS total_length, round(avg(len(ts)), 6) AS avgdl FROM (SELECT {TOKENS} AS ts FROM documents) x")
def bm25_stats(t: Tables):
    return rounded(R.corpus_stats(t.documents), "avgdl")


@query(f"WITH {BM25_CTE} SELECT doc_id AS id, term, tf, dl FROM post")
def bm25_term_freq(t: Tables):
    return R.postings(t.documents)


@query(f"WITH {BM25_CTE} SELECT term, count(*) AS df, round(ln((max(st.n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM post CROSS JOIN st GROUP BY term")
def bm25_idf(t: Tables):
    df = R.postings(t.documents).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(R.corpus_stats(t.documents).select("n"))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {BM25_CTE}, b AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) x GROUP BY item_id, term),
  d AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  s AS (SELECT b.query_id, p.doc_id AS id, sum(b.qtf * {SCORE}) AS score FROM post p JOIN b ON p.term = b.term JOIN d ON d.term = p.term CROSS JOIN st GROUP BY 1, 2)
  SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score >= 0.1) y WHERE rank <= 10""")
def bm25_multi_query(t: Tables):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return rounded(R.bm25_batch(t.documents, q), "score", digits=4)


@query(f"""WITH tok AS (SELECT source, doc_id, {TOKENS} AS ts FROM documents),
  c AS (SELECT source, doc_id, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'license')) AS tf FROM tok),
  st AS (SELECT source, count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY source)
  SELECT source AS entity_id, doc_id AS id, round(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END, 6) AS score FROM c JOIN st USING (source)""")
def bm25_within_entity(t: Tables):
    atoms = t.documents.select(F.col("source").alias("entity_id"), F.col("doc_id").alias("local_id"), F.lit("").alias("name"), F.col("text").alias("content"))
    return rounded(R.bm25_within(atoms, ["license"]), "score")


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, list_aggregate({TOKENS}, 'string_agg', ' ') AS tokens FROM documents")
def tokenize_bm25(t: Tables):
    return t.documents.select("doc_id", F.size(S.bm25_tokens("text")).alias("n"), F.nullif(F.array_join(S.bm25_tokens("text"), " "), F.lit("")).alias("tokens"))


TRIE = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[#*_`\[\](){}]', ' ', 'g'), '[^A-Za-z0-9_一-龥\s-]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2)"""


@query(f"""WITH w AS (SELECT doc_id, {TRIE} AS ws FROM documents),
  x AS (SELECT doc_id, unnest(ws) AS word FROM w UNION SELECT doc_id, unnest(flatten(list_transform(list_filter(ws, lambda y: contains(y, '-')), lambda y: regexp_split_to_array(y, '[_-]+')))) FROM w)
  SELECT doc_id, word FROM x WHERE length(word) >= 2""")
def tokenize_trie(t: Tables):
    return t.documents.select("doc_id", F.explode(S.trie_tokens("text")).alias("word"))


@query(r"SELECT DISTINCT doc_id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '[^一-鿿㐀-䶿a-zA-Z0-9_\-\s]', ' ', 'g'), '\s+')) AS term FROM documents) x WHERE length(term) >= 2 AND term NOT IN ('the', 'of', 'and')")
def eval_terms(t: Tables):
    return t.documents.select("doc_id", F.explode(S.eval_terms("text", ("the", "of", "and"))).alias("term"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(t: Tables):
    return t.documents.select("doc_id", S.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, CAST(ceil(length(text) * 0.25) AS BIGINT) AS tokens FROM documents")
def estimate_tokens_v2(t: Tables):
    return t.documents.select("doc_id", S.estimate_tokens_by_code_point("text").alias("tokens"))


VOCAB = rf"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), ln AS (SELECT doc_id, row_number() OVER () AS i, text FROM lines),
  w AS (SELECT doc_id, i, {TRIE} AS ws FROM ln),
  x AS (SELECT doc_id, i, unnest(ws) AS word FROM w UNION SELECT doc_id, i, unnest(flatten(list_transform(list_filter(ws, lambda y: contains(y, '-')), lambda y: regexp_split_to_array(y, '[_-]+')))) FROM w),
  v AS (SELECT word, doc_id AS id, count(*) AS weight FROM x WHERE length(word) >= 2 GROUP BY word, doc_id)"""


@query(f"WITH {VOCAB} SELECT word, CAST(sum(weight) AS BIGINT) AS frequency, count(*) AS n_entries FROM v GROUP BY word")
def vocab_frequency(t: Tables):
    return R.vocabulary(t.documents).groupBy("word").agg(F.sum("weight").alias("frequency"), F.count("*").alias("n_entries"))


@query(f"WITH {VOCAB} SELECT DISTINCT id FROM v WHERE word LIKE 'lic%'")
def prefix_search(t: Tables):
    return R.prefix_search(R.vocabulary(t.documents, prefix="lic"), "lic")


@query(f"WITH {VOCAB} SELECT word, CAST(sum(weight) AS BIGINT) AS frequency, count(*) AS n_entries FROM v WHERE word LIKE 'th%' GROUP BY word ORDER BY frequency DESC, word LIMIT 10")
def autocomplete(t: Tables):
    return R.autocomplete(R.vocabulary(t.documents, prefix="th"), "th")


@query(f"""WITH e AS ({ENTITY}), s AS (SELECT id, type, CASE WHEN contains(lower(abstract), 'the of') THEN 10 ELSE 0 END + CASE WHEN contains(lower(overview), 'the of') THEN 5 ELSE 0 END
  + CASE WHEN contains(lower(project || ' ' || type), 'the of') THEN 3 ELSE 0 END + CASE WHEN contains(lower(abstract), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(overview), 'the') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(abstract), 'of') THEN 2 ELSE 0 END + CASE WHEN contains(lower(overview), 'of') THEN 1 ELSE 0 END AS score FROM e)
  SELECT id, type, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def local_weighted_search(t: Tables):
    return R.weighted_search(t.entities(), "the of", 25)


COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"
NEAR = f"near AS (SELECT e.vec_id AS id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _vector(t: Tables):
    return t.embeddings.where("vec_id = 0").first()["embedding"]


@query(f"WITH {NEAR} SELECT id, round(score, 5) AS score FROM near WHERE score >= 0.3 ORDER BY round(score, 6) DESC, id LIMIT 10")
def vector_topk(t: Tables):
    return rounded(R.vector_search(t.embeddings, _vector(t)), "score", digits=5)


HYBRID_TERMS = ["license", "token"]
LISTS = one_query(HYBRID_TERMS, 0, extra=f""", {NEAR}, v AS (SELECT id, score AS v FROM near WHERE score >= 0.1), b AS (SELECT id, score AS b FROM s WHERE score >= 0.1)
  SELECT coalesce(v.id, b.id) AS id, round(0.7 * coalesce(v, 0) + 0.3 * least(coalesce(b, 0) / 10, 1), 5) AS score FROM v FULL JOIN b ON v.id = b.id ORDER BY round(0.7 * coalesce(v, 0) + 0.3 * least(coalesce(b, 0) / 10, 1), 6) DESC, id LIMIT 15""")


@query(LISTS)
def hybrid_weighted(t: Tables):
    return rounded(R.hybrid(R.vector_search(t.embeddings, _vector(t), None, 0.1), R.bm25_search(t.documents, HYBRID_TERMS, None), limit=15), "score", digits=5)


@query(one_query(HYBRID_TERMS, 0, extra=f""", {NEAR},
  v AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT id, score FROM near WHERE score >= 0.1 ORDER BY round(score, 6) DESC, id LIMIT 50) x),
  b AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT id, score FROM s WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 50) x)
  SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM b) y GROUP BY id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, id LIMIT 10"""))
def hybrid_rrf(t: Tables):
    lists = [R.ranked(R.vector_search(t.embeddings, _vector(t), 50, 0.1)), R.ranked(R.bm25_search(t.documents, HYBRID_TERMS, 50))]
    return rounded(R.rank_fusion(lists), "score", digits=9)


@query(f"WITH e AS ({ENTITY}) SELECT DISTINCT substr(abstract, 1, 50) AS suggestion FROM e WHERE contains(lower(abstract), 'token') OR contains(lower(abstract), 'the ') ORDER BY suggestion LIMIT 10", name="suggestions_contains")
def suggestions(t: Tables):
    e = t.entities()
    return e.where(F.lower("abstract").contains("token") | F.lower("abstract").contains("the ")).select(F.substring("abstract", 1, 50).alias("suggestion")).distinct().orderBy("suggestion").limit(10)


@query(f"WITH e AS ({ENTITY}) SELECT id, substr(abstract, 1, 50) AS l0, substr(overview, 1, 100) AS l1, substr(overview, 1, 300) AS l2, substr(overview, 1, 500) AS l2_remote FROM e")
def display_levels(t: Tables):
    d = lambda *a: R.display_text("abstract", "overview", *a)
    return t.entities().select("id", d(0).alias("l0"), d(1).alias("l1"), d(2).alias("l2"), d(2, True).alias("l2_remote"))


@query(f"""WITH {BM25_CTE}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) x GROUP BY 1, 2),
  d AS (SELECT term, count(*) AS df FROM post GROUP BY term), s AS (SELECT q.query_id, p.doc_id AS id, sum(q.qtf * {SCORE}) AS score FROM post p JOIN q ON p.term = q.term JOIN d ON d.term = p.term CROSS JOIN st GROUP BY 1, 2),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score >= 0.1) y WHERE rank <= 10),
  rel AS (SELECT b.item_id AS query_id, l.doc_id AS id FROM benchmark b JOIN labels l ON l.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE l.quality = 1),
  nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
  m AS (SELECT r.query_id, count(*) FILTER (WHERE rel.id IS NOT NULL AND rank <= 5) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel.id IS NOT NULL AND rank <= 5), 0) AS dcg, min(rank) FILTER (WHERE rel.id IS NOT NULL) AS f FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.id = rel.id GROUP BY 1),
  j AS (SELECT coalesce(m.query_id, nr.query_id) AS query_id, coalesce(hits, 0) AS hits, coalesce(dcg, 0) AS dcg, f, coalesce(n, 0) AS n FROM m FULL JOIN nr ON m.query_id = nr.query_id),
  z AS (SELECT query_id, hits / 5.0 AS p, CASE WHEN n > 0 THEN hits * 1.0 / n ELSE 0 END AS rc, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, coalesce(1.0 / f, 0) AS mrr FROM j)
  SELECT query_id, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM z""")
def ir_metrics(t: Tables):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    found = checkpointed(R.bm25_batch(t.documents, q))
    rel = t.labels.where("quality = 1").select((F.col("doc_id") % t.benchmark.count()).alias("query_id"), F.col("doc_id").alias("id"))
    rel = rel.join(q.select("query_id"), "query_id", "left_semi")
    return rounded(V.ir_metrics(found, rel), "precision", "recall", "f1", "ndcg", "mrr")
