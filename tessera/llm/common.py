"""Helpers shared by the corpus operators: shared scratch tables, native text rules, shipping of worker code."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LONG = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_RE = r"[^\x20\x09-\x0D]+"


def ship(module_name: str) -> None:
    """Worker functions of this module travel inside the task, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)  # what the other modules' worker functions use of this one


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one only where the setting is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Paths given out so far.
made_paths: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    made_paths.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return made_paths[-1]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, readable after any executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_key(column: str | Column = "doc_id") -> Column:
    """Document ids as a key without nulls: a null id counts as the smallest id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(MIN_LONG))


def real_id(column: str | Column) -> Column:
    """The id behind a key of id_key."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != MIN_LONG, column)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same, faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_batches(spark: SparkSession, rows: int = 1024, megabytes: int = 8) -> None:
    """Small Arrow batches, as document texts may be long and a worker holds one batch at a time; shuffle files of a finished query go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def partitions(df: DataFrame, megabytes: int = 16) -> int:
    """Partitions for data that grow with df: by the size of the tables that it reads, as far as the planner knows it, and the session's setting at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 56)  # an unknown size counts as the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (megabytes << 20)))


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """((id, text) with ids that don't repeat, None), or, where rows repeat an id, ((number, text), (id, number) for each row).

    Rows that repeat both id and text are one document; rows that repeat an id alone are ordered by a hash of the text. Numbers
    follow the ids; they have gaps, as each range of ids is numbered by itself.
    """
    base = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))
    if base.groupBy("id").count().where("count > 1").isEmpty():
        return base, None
    keyed = base.withColumn("t", F.xxhash64("text"))
    ranges = keyed.select("id", "t").distinct().repartitionByRange(partitions(docs), "id", "t").sortWithinPartitions("id", "t")
    numbers = written(ranges.withColumn("n", F.monotonically_increasing_id()), "numbers")
    joined = keyed.join(numbers, ["id", "t"])
    return joined.select(F.col("n").alias("id"), "text").dropDuplicates(["id"]), joined.select(F.col("id").alias("real"), F.col("n").alias("id"))


def restored(out: DataFrame, back: DataFrame | None) -> DataFrame:
    """The results of unique_rows' documents for the rows they stand for."""
    return out if back is None else back.join(out, "id").drop("id").withColumnRenamed("real", "id")


def cleared(spark: SparkSession, since: int, keep: str) -> None:
    """Deletes what was written to paths given out since, but for keep: the tables that a finished step worked with."""
    for path in made_paths[since:]:
        if path != keep:
            removed_path(spark, path)
    made_paths[since:] = [keep]


def removed_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, by Hadoop's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
