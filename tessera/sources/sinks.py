"""Sinks (K1-K19). Spark's commit protocol makes each write all or nothing; tables without MERGE get a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def by_day(entries: DataFrame, path: str, at: str = "date", mode: str = "append") -> None:
    """Partitioned by year, month and day, so that date filters prune folders."""
    d = F.to_date(F.col(at))
    entries.withColumns({"yyyy": F.date_format(d, "yyyy"), "mm": F.date_format(d, "MM"), "dd": F.date_format(d, "dd")}).write.mode(mode).partitionBy("yyyy", "mm", "dd").parquet(path)


def entry_files(entries: DataFrame, path: str) -> None:
    """Entries as text rows in the entry format."""
    entries.select(S.markdown_entry({c: F.col(c) for c in entries.columns}).alias("value")).write.mode("overwrite").text(path, lineSep="\x1e")


def csv_line(columns: list[str]) -> Column:
    """A line in which only strings with a comma are quoted."""
    return F.concat_ws(",", *[F.when(F.col(c).cast("string").contains(","), F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def csv_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_export(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (rows.select(*columns) if columns else rows).write.mode("overwrite").json(path)


def health_report(report: DataFrame, path: str, day: str) -> None:
    report.withColumn("day", F.lit(day)).write.mode("overwrite").partitionBy("day").json(path)


def vocabulary(vocab: DataFrame, path: str) -> None:
    """Sorted by word, so that prefixes prune row groups."""
    vocab.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def graph_cache(nodes: DataFrame, path: str) -> None:
    h = S.node_hash("label", "source_file", "source_location", "file_type", "community", "norm_label")
    nodes.select("id", h.alias("hash")).write.mode("overwrite").parquet(path)


def upload_rows(rows: DataFrame) -> DataFrame:
    """Defaults of an upload: type general, project global, source plugin."""
    d = {"type": "general", "project": "global", "source": "plugin"}
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in d.items()})


def published(df: DataFrame, staging: str, final: str, check) -> None:
    """Stages the rows, checks them as written, and only then publishes; a failed check leaves the published table alone. df may read the table that it replaces."""
    df.write.mode("overwrite").parquet(staging)
    staged = df.sparkSession.read.schema(df.schema).parquet(staging)
    if not check(staged):
        raise ValueError("check of staged rows failed")
    staged.write.mode("overwrite").parquet(final)
