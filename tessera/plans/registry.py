"""Registration of queries with their SQL twins, and the views of the driver's tables that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, and the views that stand for the knowledge base."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entities(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("lang").alias("project"), F.array("lang", "source").alias("tags"),
            F.substring("text", 1, 100).alias("abstract"), F.substring("text", 1, 500).alias("overview"), F.col("text").alias("content"),
        )

    def edges(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "contains").otherwise("extends")
        return self.lineitem.select(F.concat(F.lit("S"), "l_suppkey").alias("from_id"), F.concat(F.lit("P"), "l_partkey").alias("to_id"), kind.alias("type"), (F.col("l_quantity") / 50.0).alias("weight"))

    def nodes(self) -> DataFrame:
        return self.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id")).union(self.part.select(F.concat(F.lit("P"), "p_partkey")))

    def atoms(self) -> DataFrame:
        """region, nation, customer and orders as a tree of four levels."""
        one = lambda df, p, k, up, q, name, n: df.select(
            F.concat(F.lit(p), F.col(k)).alias("local_id"), (F.concat(F.lit(q), F.col(up)) if up else F.lit(None).cast("string")).alias("parent_id"), F.col(name).cast("string").alias("name"), F.lit(n).alias("heading_level")
        )
        return (
            one(self.region, "R", "r_regionkey", None, "", "r_name", 1).unionByName(one(self.nation, "N", "n_nationkey", "n_regionkey", "R", "n_name", 2))
            .unionByName(one(self.customer, "C", "c_custkey", "c_nationkey", "N", "c_name", 3)).unionByName(one(self.orders, "O", "o_orderkey", "o_custkey", "C", "o_orderkey", 4))
        )


# The same views for the twins.
ENTITY = "SELECT doc_id AS id, source AS type, lang AS project, lang, substr(text, 1, 100) AS abstract, substr(text, 1, 500) AS overview, text AS content FROM documents"
EDGE = "SELECT 'S' || l_suppkey AS from_id, 'P' || l_partkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'contains' ELSE 'extends' END AS type, l_quantity / 50.0 AS weight FROM lineitem"
NODE = "SELECT 'S' || s_suppkey AS id FROM supplier UNION ALL SELECT 'P' || p_partkey FROM part"
ATOM = """SELECT 'R' || r_regionkey AS local_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 1 AS heading_level FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 2 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, 3 FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, CAST(o_orderkey AS VARCHAR), 4 FROM orders"""
TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables; sql is its twin."""

    def keep(f):
        n = name or f.__name__
        QUERIES[n] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[n] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


__all__ = ["ATOM", "EDGE", "ENTITY", "NODE", "QUERIES", "SQL", "S", "TOKENS", "Tables", "query", "rounded", "values"]
