"""Relation recommendation and knowledge extraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shipping import ship

ship(__name__)

AUTO, REVIEW = 0.85, 0.75
#: Vectors of a share, of which two meet in a task.
CELL = 16_384

# Phrases that mark knowledge in conversations.
SIGNALS = {"decision": r"(?i)\b(decided|decision|we will|let's use|chose)\b", "solution": r"(?i)\b(fixed|solved|solution|the fix|resolved)\b", "pattern": r"(?i)\b(pattern|always|best practice|convention)\b"}


def recommendation_class(similarity, auto: float = AUTO, review: float = REVIEW) -> Column:
    s = F.col(similarity)
    return F.when(s >= auto, "auto").when(s >= review, "review").otherwise("ignored")


def similar_to(vectors: DataFrame, n_queries: int = 50, k: int = 5, threshold: float = 0.75, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(from_id, to_id, similarity, rank): the k nearest of each of the first n_queries rows by id, itself left out.

    The query set is n_queries vectors (a parameter); they meet all rows in blocks, as one matrix product a batch.
    """
    q = vectors.orderBy(id_col).limit(n_queries).select(id_col, vec_col).collect()
    return _ranked(_near(vectors, q, k, threshold, id_col, vec_col), k)


def similar_in_blocks(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.75, block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As similar_to, for all rows of queries, none of which reach the driver.

    Both sides are dealt to shares of about CELL rows, and each share of queries meets each share of vectors in one cell, which multiplies
    `block` queries at a time. Rows that are sent grow with queries times shares, and a cell's memory doesn't grow.
    """
    rows = lambda side: side.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("vec IS NOT NULL")
    parts, chunks = vectors.count() // CELL + 1, queries.count() // CELL + 1
    share = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["part", "chunk"]
    left = rows(queries).withColumn("chunk", share(chunks)).withColumn("part", every(parts)).repartition(parts * chunks, *key)
    right = rows(vectors).withColumn("part", share(parts)).withColumn("chunk", every(chunks)).repartition(parts * chunks, *key)
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meeting(k, threshold, block), "from_id long, to_id long, similarity double")
    return _ranked(near, k)


def _meeting(k: int, threshold: float, block: int):
    def normed(vectors) -> np.ndarray:
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"from_id": np.zeros(0, np.int64), "to_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})]
        if len(left) and len(right):
            names, ids, m, x = left["id"].to_numpy(), right["id"].to_numpy(), normed(left["vec"]), normed(right["vec"]).T
            for at in range(0, len(names), block):
                some = names[at : at + block]
                s = m[at : at + block] @ x
                keep = (s >= threshold) & (some[:, None] != ids[None])
                order = np.where(keep, np.round(s, 9), -2.0)
                if len(ids) > k:
                    keep &= order >= np.partition(order, -k, axis=1)[:, -k, None]
                i, j = np.nonzero(keep)
                # The k best of a cell are enough; ties go by rounded similarity and id, as in the final order.
                best = np.lexsort((ids[j], -order[i, j], i))
                i, j = i[best], j[best]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                out.append(pd.DataFrame({"from_id": some[i], "to_id": ids[j], "similarity": s[i, j]}))
        return pd.concat(out)

    return work


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("from_id").orderBy(F.round("similarity", 9).desc(), "to_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _near(vectors: DataFrame, q: list, k: int, threshold: float, id_col: str, vec_col: str) -> DataFrame:
    """(from_id, to_id, similarity): for each query (id, vector) the k best of every batch of vectors."""
    import pyarrow as pa

    names = np.array([r[0] for r in q], dtype=np.int64)
    m = np.array([r[1] for r in q], dtype=np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(q) else m

    def block(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if not len(ids) or not len(names):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            s = m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
            s = np.where((s >= threshold) & (names[:, None] != ids[None]), s, -2.0)
            # The k best of a batch are enough; ties go by rounded similarity and id, as in the final order.
            best = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(names)), best.shape[1]), best.ravel()
            i, j = i[s[i, j] > -2], j[s[i, j] > -2]
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["from_id", "to_id", "similarity"])

    return vectors.select(F.col(id_col).cast("long"), vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(block, "from_id long, to_id long, similarity double")


def without_existing(recommended: DataFrame, edges: DataFrame) -> DataFrame:
    """After the top k are taken, targets that are linked already go."""
    return recommended.join(edges.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")


def same_type(entities: DataFrame, edges: DataFrame, k: int = 3, weight: float = 0.76) -> DataFrame:
    """For every entity the first k others of its type by id that it isn't linked to.

    Only the first k + 1 + (its links) ids of a type can be among them, so each entity meets that many numbers of its type: the
    candidates are as many as entities and edges, whatever the sizes of the types.
    """
    by = Window.partitionBy("type").orderBy("id")
    linked = edges.select("from_id", "to_id").distinct()
    links = linked.groupBy("from_id").agg(F.count("*").alias("links"))
    most = links.agg(F.coalesce(F.max("links"), F.lit(0)).alias("m")).first()["m"]
    first = entities.select("type", F.col("id").alias("to_id"), F.row_number().over(by).alias("n")).where(F.col("n") <= k + 1 + most)
    wide = entities.select(F.col("id").alias("from_id"), "type").join(links, "from_id", "left")
    wide = wide.select("from_id", "type", F.explode(F.sequence(F.lit(1), (F.coalesce("links", F.lit(0)) + k + 1).cast("int"))).alias("n"))
    pairs = wide.join(first, ["type", "n"]).drop("n").where("from_id <> to_id").join(linked, ["from_id", "to_id"], "left_anti")
    w = Window.partitionBy("from_id").orderBy("to_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("from_id", "to_id", "type", F.lit(weight).alias("weight"))


def unordered_pairs(recommended: DataFrame) -> DataFrame:
    """Of (a, b) and (b, a) the more similar, then the smaller from_id."""
    w = Window.partitionBy(F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).orderBy(F.desc("similarity"), "from_id")
    return recommended.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def routed(recommended: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    return unordered_pairs(recommended).withColumn("route", recommendation_class("similarity", auto, review))


def approved(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue without the approved items, the edges they become)."""
    edges = queue.join(ids, "queue_id", "left_semi").select("from_id", "to_id", "type", "weight")
    return queue.join(ids, "queue_id", "left_anti"), edges


def combined(semantic: DataFrame, by_type: DataFrame) -> DataFrame:
    """Recommendations by similarity and by type in one list: from_id, to_id, score, reason."""
    s = semantic.select("from_id", "to_id", F.col("similarity").alias("score"), F.lit("semantic").alias("reason"))
    return s.unionByName(by_type.select("from_id", "to_id", F.col("weight").alias("score"), F.lit("type").alias("reason")))


def queued(queue: DataFrame, items: DataFrame, at: Column) -> DataFrame:
    """A review queue (queue_id, from_id, to_id, similarity, type, weight, added_at) with new items; type and weight have defaults."""
    item = items.select("queue_id", "from_id", "to_id", "similarity", F.coalesce("type", F.lit("related")).alias("type"), F.coalesce("weight", "similarity").alias("weight"), at.alias("added_at"))
    return queue.unionByName(item) if queue is not None else item


def rejected(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids, "queue_id", "left_anti").select(*queue.columns)


def listed_queue(queue: DataFrame) -> DataFrame:
    """In the order in which items came."""
    return queue.orderBy("added_at", "queue_id")


def recent_sessions(turns: DataFrame, as_of: Column, processed: DataFrame, days: int = 90, many: int = 10, session: str = "conv_id", at: str = "ts") -> DataFrame:
    """(session, messages, preferred): sessions with a message of the last days that weren't processed yet; those of more than `many` messages come first."""
    s = turns.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy(session).agg(F.count("*").alias("messages"))
    return s.join(processed.select(session), session, "left_anti").withColumn("preferred", F.col("messages") > many)


def cross_type_edges(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """pairs: from_id, to_id, bm25, cosine, overlap (shared keywords). Edges of pairs that share keywords and whose blended similarity is high enough."""
    scored = pairs.where("overlap > 0").withColumn("similarity", cross_type_score("bm25", "cosine"))
    return scored.where(F.col("similarity") >= least).select("from_id", "to_id", F.lit("related_to").alias("type"), F.col("similarity").alias("weight"))


def analyses_edges(hits: DataFrame, kinds: DataFrame) -> DataFrame:
    """hits: query_id (a code entity), id, rank; kinds: id, type. From the best hit that is not code to the entity, as type analyzes."""
    other = hits.join(kinds.where("type <> 'code'"), "id")
    best = other.groupBy("query_id").agg(F.min_by("id", "rank").alias("from_id"))
    return best.select("from_id", F.col("query_id").alias("to_id"), F.lit("analyzes").alias("type"), F.lit(0.7).alias("weight"))


def signals(turns: DataFrame, text: str = "text") -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in SIGNALS.items()]))
    t = turns.withColumn("kinds", kinds)
    return t.withColumn("confidence", F.when(F.size("kinds") >= 2, "high").when(F.size("kinds") == 1, "medium").otherwise("reject"))


def sessions(turns: DataFrame, processed: DataFrame | None = None, least: int = 1, session: str = "conv_id") -> DataFrame:
    s = turns.groupBy(session).agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("characters"))
    s = s.where(F.col("messages") >= least)
    return s if processed is None else s.join(processed, session, "left_anti")


def cross_type_score(bm25, cosine, bm25_share: float = 0.7) -> Column:
    return bm25_share * F.least(F.col(bm25) / 10, F.lit(1.0)) + (1 - bm25_share) * F.col(cosine)
