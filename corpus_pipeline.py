"""The training-data pipeline: quality classifier, line dedup, near-dedup, decontamination, source mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. run(spark, sf_dir) applies them all.

Quality scores come from a classifier learned on the labels of documents outside the held-out fifth. Line dedup rewrites text
and n_chars. Of near-duplicates the document with the smallest doc_id stays. Contaminated documents go (hit words, and hits of a
twentieth of the words or more). The mix gives each document that is left the number of its words that are taken.

Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules say. A row whose doc_id is null is
treated as one with the smallest id. Rows that repeat an id are documents of their own; of rows that repeat id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cleared, made_paths, new_path, real_id, row_batches
from tessera.llm.decontamination import uncontaminated
from tessera.llm.line_dedup import apply_bitmaps, line_dedup
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import representatives
from tessera.llm.quality import quality_score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model) >= LEAST_SCORE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = apply_bitmaps(docs, line_dedup(docs))
    changed = F.col("line_counts.n_dropped") > 0
    return out.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, _, _ = mix(docs)
    return out.select(real_id("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("source mixing", mixing)]
#: Signatures, boosted trees and the automaton have no SQL; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage worked with is deleted from the shared store when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = len(made_paths)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            cleared(spark, before, path)
            docs = spark.read.parquet(path)
    return docs
