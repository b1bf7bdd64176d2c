"""Numbers for rows in an order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import checkpointed


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Adds each row's place, from 1. Ranges of the order are sorted by themselves; the rows of those before are added to the place in a range.

    The last columns of the order should tell rows apart: equal rows come in any order, and lie in one range.
    """
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__id", 33))
    ahead = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("__range").count().select("__range", F.coalesce(ahead, F.lit(0)).alias("__start"))  # a row for each range
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "__range").withColumn(name, F.col("__start") + inside + 1).drop("__id", "__range", "__start")


def batches(rows: DataFrame, order: list[str], size: int = 100, column: str = "items") -> DataFrame:
    """(batch, items): the rows in their order, `size` in each batch and the rest in the last; batches count from 1."""
    n = numbered(rows, *order, name="__n")
    item = F.struct("__n", F.struct(*rows.columns).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    return n.groupBy(F.ceil(F.col("__n") / size).alias("batch")).agg(listed.alias(column))
