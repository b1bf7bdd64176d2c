"""Retrieval evaluation (V1-V6, J23, A20, W11). Results are made distinct by id first, so recall and NDCG never exceed 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def ir_metrics(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """results: query_id, id, rank; relevant: query_id, id. One row a query with relevant ids or results."""
    first = results.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    truth = relevant.select("query_id", "id").distinct().withColumn("rel", F.lit(1))
    size = truth.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    judged = first.join(truth, ["query_id", "id"], "left")
    top = (F.col("rank") <= k) & F.col("rel").isNotNull()
    m = judged.groupBy("query_id").agg(
        F.count_if(top).alias("hits"), F.coalesce(F.sum(F.when(top, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"), F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("first")
    )
    m = m.join(size, "query_id", "full").fillna(0, ["hits", "dcg", "n_rel"])
    ideal = F.aggregate(F.when(F.col("n_rel") > 0, F.sequence(F.lit(1), F.least("n_rel", F.lit(k)))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log(F.lit(2.0)) / F.log(i + 1))
    p, r = F.col("hits") / k, F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(0.0)
    m = m.withColumns({"precision": p, "recall": r})
    return m.select(
        "query_id", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"),
        F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics.groupBy(*(by or [])).agg(*[S.js_round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1", "ndcg", "mrr")])


def mode_report(measured: DataFrame, metrics: list[str]) -> DataFrame:
    """measured: mode, metric, value. A row a mode with the mean of each metric."""
    return measured.groupBy("mode").pivot("metric", metrics).agg(F.avg("value"))
