"""Retrieval: BM25, prefix search, weighted substring search, vectors, fusion, suggestions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.graph import checkpointed, stored
from tessera.operators.numbering import numbered

K1, B = 1.2, 0.75
#: Rows of a group that one task may stream.
LARGE_GROUP = 200_000
#: Rows of a checked broadcast at most, and postings that a task meets queries with.
FEW_ROWS, POSTINGS = 200_000, 100_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens=S.bm25_tokens) -> DataFrame:
    """(id, term, tf, dl): the inverted index. Map-side combine folds a document's repeats before the shuffle."""
    t = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("tokens"))
    return t.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    n = docs.select(S.bm25_length(text_col).alias("dl"))
    return n.agg(F.count("*").alias("n"), F.sum("dl").alias("total_length"), F.avg("dl").alias("avgdl"))


def idf(n, df) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf, dl, avgdl) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.when(avgdl == 0, 1.0).otherwise(avgdl)))


def bm25_search(docs: DataFrame, query_terms: list[str], limit: int | None = 10, min_score: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One query: a scan counts the query's terms in each document, and one row of statistics is joined back. Nothing else is shuffled.

    The counts, a few numbers a document, are checkpointed, so that the texts are read once for statistics and scores.
    """
    terms = sorted(set(query_terms))
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    tfs = [S.bm25_count(text_col, t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counts = docs.select(F.col(id_col).alias("id"), S.bm25_length(text_col).alias("dl"), *tfs)
    counts = checkpointed(counts)
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = counts.where(S.any_of(F.col(f"tf{i}") > 0 for i in range(len(terms)))).join(F.broadcast(stats))
    score = sum(
        (F.when(F.col(f"tf{i}") > 0, query_terms.count(t) * idf(F.col("n"), F.col(f"df{i}")) * bm25_weight(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i, t in enumerate(terms)),
        F.lit(0.0),
    )
    out = rows.select("id", score.alias("score")).where(F.col("score") >= min_score)
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def bm25_batch(docs: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Many queries (query_id, text) at once: (query_id, id, score, rank). Only occurrences of the queries' terms leave the scan."""
    wanted = query_terms(queries)
    rows = docs.select(F.col(id_col).alias("id"), S.bm25_tokens(text_col).alias("tokens"))
    # Terms meet the words before anything is shuffled.
    found = rows.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(few(wanted.select("term").distinct()), "term", "left_semi")
    return scored_terms(found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), corpus_stats(docs, text_col), wanted, limit, min_score)


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The terms of one query, as the tokenizer has them."""
    return [r.term for r in spark.createDataFrame([(query,)], "text string").select(F.explode(S.bm25_tokens("text")).alias("term")).collect()]


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """rows, to be broadcast if they are counted to be few."""
    kept = checkpointed(rows)
    return F.broadcast(kept) if kept.count() <= most else kept


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    return checkpointed(queries.select("query_id", F.explode(S.bm25_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))


def scored_batch(post: DataFrame, stats: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = 0.1) -> DataFrame:
    """Queries against postings (id, term, tf, dl) and one row of statistics (n, avgdl): (query_id, id, score, rank)."""
    wanted = query_terms(queries)
    return scored_terms(post.join(few(wanted.select("term").distinct()), "term", "left_semi"), stats, wanted, limit, min_score)


def scored_terms(some: DataFrame, stats: DataFrame, wanted: DataFrame, limit: int, min_score: float) -> DataFrame:
    """some: the postings of the queries' terms; wanted: as query_terms gives them.

    Postings are dealt by document, about POSTINGS a task, and meet the queries there, so a document's scores are summed where they are made:
    no hit of a query's term is shuffled, only the best of each task.
    """
    some = stored(some.select("id", "term", "tf", "dl"))
    df = some.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = stats.select("n", "avgdl").first()
    terms = few(wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("share")))
    dealt = some.repartition(some.count() // POSTINGS + 1, "id").select("id", "term", bm25_weight(F.col("tf"), F.col("dl"), F.lit(avgdl or 0.0)).alias("weight"))
    hits = dealt.join(terms, "term").select("query_id", "id", (F.col("share") * F.col("weight")).alias("s"))
    scored = hits.groupBy("query_id", "id").agg(F.sum("s").alias("score")).where(F.col("score") >= min_score)
    # Rounded before ranking, so that the order of summation can't change ranks. Spark keeps the best of each partition before it deals them by query.
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def bm25_within(atoms: DataFrame, query_terms: list[str], group: str = "entity_id") -> DataFrame:
    """BM25 of each group's rows against that group's own statistics (group, id, score); text is name and content."""
    terms = sorted(set(query_terms))
    text = F.concat_ws(" ", "name", "content")
    c = atoms.select(group, F.col("local_id").alias("id"), S.bm25_length(text).alias("dl"), *[S.bm25_count(text, q).alias(f"tf{i}") for i, q in enumerate(terms)])
    stats = c.groupBy(group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = sum((F.when(F.col(f"tf{i}") > 0, query_terms.count(q) * idf(F.col("n"), F.col(f"df{i}")) * bm25_weight(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i, q in enumerate(terms)), F.lit(0.0))
    return c.join(stats, group).select(group, "id", score.alias("score"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None, prefix: str = "") -> DataFrame:
    """(word, id, weight): 1 for each line that holds the word, 2 for each metadata keyword. prefix: only words that begin with it."""
    begins = prefix.lower()
    lines = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if begins:
        lines = lines.where(F.lower("text").contains(begins))
    lines = lines.select("id", F.explode(F.split("text", "\n")).alias("line"))
    words = S.trie_tokens("line")
    if begins:
        lines = lines.where(F.lower("line").contains(begins))
        words = F.filter(words, lambda w: w.startswith(begins))
    body = lines.select("id", F.explode(words).alias("word"), F.lit(1).alias("w"))
    if extra is not None:
        body = body.unionByName(docs.select(F.col(id_col).alias("id"), F.explode(extra).alias("word"), F.lit(2).alias("w")).where(F.col("word").startswith(begins)))
    return body.groupBy("word", "id").agg(F.sum("w").alias("weight"))


def prefix_search(vocab: DataFrame, prefix: str) -> DataFrame:
    """Distinct ids of words that begin with prefix; the empty prefix means all."""
    return vocab.where(F.col("word").startswith(prefix.lower())).select("id").distinct()


def autocomplete(vocab: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    w = vocab.where(F.col("word").startswith(prefix.lower())).groupBy("word").agg(F.sum("weight").alias("frequency"), F.count("*").alias("n_entries"))
    return w.orderBy(F.desc("frequency"), "word").limit(limit)


def upsert_words(vocab: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (word, id, weight) rows; weights of a word and id that are there already add up."""
    return vocab.unionByName(new).groupBy("word", "id").agg(F.sum("weight").alias("weight"))


def delete_entry(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    return vocab.join(ids, "id", "left_anti")


def weighted_search(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Substring scores: the query in abstract 10, overview 5, tags 3; each word in abstract 2, overview 1."""
    q = query.lower()
    a, o = F.lower(F.coalesce("abstract", F.lit(""))), F.lower(F.coalesce("overview", F.lit("")))
    tags = F.lower(F.array_join(F.coalesce("tags", S.lits([])), " "))
    hit = lambda text, part, n: F.when(text.contains(part), n).otherwise(0)
    score = hit(a, q, 10) + hit(o, q, 5) + hit(tags, q, 3)
    for w in re.split(r"\s+", q):
        score = score + hit(a, w, 2) + hit(o, w, 1)
    return entities.select("id", "type", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int | None = 10, threshold: float = 0.3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(F.col(id_col).alias("id"), S.cosine(vec_col, q).alias("score")).where(F.col("score") >= threshold)
    return out if limit is None else out.orderBy(F.desc(F.round("score", 6)), "id").limit(limit)


def hybrid(vector_hits: DataFrame, bm25_hits: DataFrame, vector_share: float = 0.7, limit: int = 10) -> DataFrame:
    """Weighted sum of cosine and min(bm25 / 10, 1) over both lists (id, score)."""
    v, b = vector_hits.select("id", F.col("score").alias("v")), bm25_hits.select("id", F.col("score").alias("b"))
    score = vector_share * F.coalesce("v", F.lit(0.0)) + (1 - vector_share) * F.least(F.coalesce("b", F.lit(0.0)) / 10, F.lit(1.0))
    return v.join(b, "id", "full").select("id", score.alias("score")).orderBy(F.desc(F.round("score", 6)), "id").limit(limit)


def rank_fusion(lists: list[DataFrame], k: int = 60, limit: int = 10) -> DataFrame:
    """Sum of 1 / (k + rank) over lists (id, rank)."""
    both = lists[0].select("id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def ranked(hits: DataFrame, digits: int = 6) -> DataFrame:
    """rank by score and id; for short lists (a top-k)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", digits).desc(), "id")))


def suggestions(entities: DataFrame, word: str, limit: int = 10, width: int = 50) -> DataFrame:
    s = entities.where(F.lower("abstract").contains(word.lower())).select(F.substring("abstract", 1, width).alias("suggestion")).distinct()
    return s.orderBy("suggestion").limit(limit)


def display_text(abstract, overview, level: int, remote: bool = False) -> Column:
    width = {0: 50, 1: 100}.get(level, 500 if remote else 300)
    a = F.coalesce(F.col(abstract), F.lit(""))
    return F.substring(a if level == 0 else F.coalesce(F.nullif(F.col(overview), F.lit("")), a), 1, width)


#: Default thresholds by mode; half for atoms.
THRESHOLDS = {"hybrid": 0.005, "vector": 0.3, "keyword": 0.01, "bm25": 0.01}


def default_threshold(mode: str, scope: str = "all") -> float:
    return THRESHOLDS.get(mode, 0.005) * (0.5 if scope == "atom" else 1)


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def distinct_results(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """results: id, local_id, rank. Of those with one local id (their id where there is none) the best ranked stays, and ranks are closed up. by: the columns of a query."""
    keys = by or []
    first = keep_first(results.withColumn("__key", F.coalesce("local_id", "id")), [*keys, "__key"], [F.col("rank"), F.col("id"), F.col("local_id")]).drop("__key")
    if not keys:
        return numbered(first.withColumnRenamed("rank", "__rank"), "__rank", "id", "local_id", name="rank").drop("__rank").select(*results.columns)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "id", "local_id")))


def search(docs: DataFrame, query: str, mode: str = "keyword", vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = 10) -> DataFrame:
    """Router over keyword, vector and hybrid search; without a vector, hybrid falls back to keyword search. Terms are the tokenizer's. See index.routed_search for scopes."""
    if mode == "hybrid":  # all hits, which no single task should rank
        words = bm25_search(docs, terms_of(docs.sparkSession, query), None)
    else:
        words = bm25_batch(docs, docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string"), limit).select("id", "score")
    if mode in ("vector", "hybrid") and vectors is not None and query_vector is not None:
        near = vector_search(vectors, query_vector, limit if mode == "vector" else None, default_threshold("vector"))
        return near if mode == "vector" else hybrid(near, words, limit=limit)
    return words


def relevance(bm25, name, query: str, level) -> Column:
    """min(0.6 min(bm25 / 10, 1) + 0.3 overlap of the title + 0.1 / level, 1); 0 for a blank query."""
    if not query.strip():
        return F.lit(0.0)
    depth = F.when(F.col(level).isNotNull() & (F.col(level) > 0), 0.1 / F.col(level)).otherwise(0.0)
    return F.least(0.6 * F.least(F.col(bm25) / 10, F.lit(1.0)) + 0.3 * S.word_overlap(F.lit(query), F.coalesce(F.col(name), F.lit(""))) + depth, F.lit(1.0))


def fitting(group: str, budget: int):
    """mapInArrow: (group, local_id, tokens), sorted by group and then by rank, to the rows taken. One sum is all that is kept."""

    def work(batches):
        now, used = None, 0
        for batch in batches:
            taken = []
            for i, (g, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if g != now:
                    now, used = g, 0
                if used + t <= budget:
                    used += t
                    taken.append(i)
            yield batch.take(pa.array(taken, type=pa.int64()))

    return work


def budget_select(atoms: DataFrame, budget: int, strategy: str = "relevance", group: str = "entity_id", large: int = LARGE_GROUP) -> DataFrame:
    """Greedy choice under a token budget, for every group at once: in order, a row is taken if it still fits, and skipped if not.

    atoms: group, local_id, tokens, relevance, heading_level, order. Returns (group, used, utilisation, local_id).

    Groups of up to `large` rows are sorted and streamed, one task each at most, and one sum is kept. Larger ones are scanned in parallel
    (see parallel_greedy). Both take the same rows. Rows that no budget holds never leave the scan.
    """
    order = [-F.col("relevance"), F.col("order")] if strategy == "relevance" else [F.coalesce("heading_level", F.lit(99)), -F.col("relevance")]
    ranks = [c.alias(f"__{i}") for i, c in enumerate(order)]
    rows = atoms.where(F.col("tokens") <= budget).select(F.col(group), "local_id", F.col("tokens").cast("long").alias("tokens"), *ranks)
    sizes = checkpointed(rows.groupBy(F.col(group).alias("__g")).count().where(F.col("count") > large).select("__g"))
    same = F.col(group).eqNullSafe(F.col("__g"))
    some, chosen = not sizes.isEmpty(), None
    if some:
        chosen = parallel_greedy(rows.join(sizes, same, "left_semi"), budget, group)
        rows = rows.join(sizes, same, "left_anti")
    rows = rows.repartition(group).sortWithinPartitions(group, "__0", "__1", "local_id", "tokens").select(group, "local_id", "tokens")
    streamed = rows.mapInArrow(fitting(group, budget), rows.schema)
    used = F.sum("tokens").over(Window.partitionBy(group))
    streamed = streamed.select(group, used.alias("used"), "local_id")
    every = streamed if chosen is None else streamed.unionByName(chosen)
    return every.select(group, "used", (F.col("used") * 100.0 / budget).alias("utilisation"), "local_id")


def chosen_in_order(atoms: DataFrame, chosen: DataFrame, group: str = "entity_id") -> DataFrame:
    """What budget_select chose, in the order of the document: chosen's columns and `position`, from 1, by `order` as a reader's alphabet has it.

    A context is no longer than its budget, so the rows of a group that meet in one task are few.
    """
    place = atoms.select(F.col(group).alias("__g"), F.col("local_id").alias("__id"), F.coalesce("order", F.lit("")).alias("__order"))
    rows = chosen.join(place, F.col(group).eqNullSafe(F.col("__g")) & (F.col("local_id") == F.col("__id")))
    by = Window.partitionBy(group).orderBy(F.collate("__order", "UNICODE"), "local_id")
    return rows.withColumn("position", F.row_number().over(by)).select(*chosen.columns, "position")


def parallel_greedy(rows: DataFrame, budget: int, group: str) -> DataFrame:
    """(group, used, local_id): the greedy choice in rounds. rows: group, __0, __1, local_id, tokens.

    Each round takes the longest beginning of what is left that fits, by prefix sums over ranges of the order, and drops what is larger than
    the budget that remains then; the sequential scan would take and skip the same rows. Sums over a range's share of a group add up to
    those of the group, so no group is in one task. Rows without tokens always fit. At least one row of a group is taken in each round,
    and what is left to spend soon excludes nearly all rows.
    """
    key = [group, "__0", "__1", "local_id", "tokens"]
    # a number for each row in the order of its group, from ranges that are sorted by themselves
    placed = checkpointed(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id()))
    every = placed.where("tokens <= 0").select(group, "local_id", "tokens")
    left = placed.where("tokens > 0").select(group, "local_id", "tokens", "place", F.lit(budget).cast("long").alias("room"))
    while True:
        taken, left = _round(left, group)
        every = every.unionByName(taken)
        if left.isEmpty():
            break
    used = every.groupBy(F.col(group).alias("__g")).agg(F.sum("tokens").alias("used"))
    return every.join(used, F.col(group).eqNullSafe(F.col("__g"))).select(group, "used", "local_id")


def _round(left: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows taken, rows that still may fit). left: group, local_id, tokens, place, room; both results are checkpointed."""
    part = F.shiftright("place", 33)
    local = Window.partitionBy(group, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = checkpointed(left.withColumn("part", part).withColumn("sum", F.sum("tokens").over(local)))
    parts = summed.groupBy(group, "part").agg(F.max("sum").alias("all"), F.first("room").alias("room"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("all").over(ahead), F.lit(0)))
    parts = parts.select(F.col(group).alias("__g"), F.col("part").alias("__part"), "before")
    met = summed.join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("part") == F.col("__part")))
    marked = checkpointed(met.withColumn("fits", F.col("before") + F.col("sum") <= F.col("room")).select(group, "local_id", "tokens", "place", "room", "fits"))
    taken = marked.where("fits").select(group, "local_id", "tokens")
    spent = taken.groupBy(F.col(group).alias("__g")).agg(F.sum("tokens").alias("spent"))
    rest = marked.where("NOT fits").join(spent, F.col(group).eqNullSafe(F.col("__g"))).withColumn("room", F.col("room") - F.col("spent"))
    return taken, checkpointed(rest.where("tokens <= room").select(group, "local_id", "tokens", "place", "room"))
