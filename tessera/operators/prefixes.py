"""A stored prefix dictionary (X4, X5, T3, X6): completions and prefix search that read no text.

Three tables, published as one version (see sources/versions.py):
* `words`: word, frequency, n_entries, sorted by word and front-coded (Parquet's DELTA_BYTE_ARRAY keeps what a word shares with the one before);
* `tops`: for every prefix of up to SHORT characters its BEST completions, so a short prefix, which most words may share, is a look-up;
* `entries`: word, id, weight, sorted by word, for prefix search and for changes.
A longer prefix is a range of words; the scan skips the row groups outside it. Changes work on entries: no text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph
from tessera.sources import versions as V

# Files at the root of a base that are indexed beside its entries.
CORE_FILES = ["MEMORY.md", "SOUL.md", "AGENTS.md", "USER.md", "IDENTITY.md", "TOOLS.md"]
SHORT, BEST = 4, 10
ROW_GROUP_BYTES = 8 << 20


def in_prefix(column: str, prefix: str) -> Column:
    """A range that scans can prune: what sorts from the prefix up, and begins with it."""
    return (F.col(column) >= prefix) & F.col(column).startswith(prefix)


def indexed_files(files: DataFrame) -> DataFrame:
    """(id, text) of the files (path from the root of a base, text) that its index holds.

    Entries are the .md files anywhere below timeline/ and active/<topic>/entries/, by their name without ending; core files are `core-` and their name.
    """
    core = F.col("path").isin(CORE_FILES)
    entry = F.col("path").rlike(r"^(timeline|active/[^/]+/entries)/(.*/)?[^/]*\.md$")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.where(core | entry).select(F.when(core, F.concat(F.lit("core-"), "path")).otherwise(name).alias("id"), "text")


def words_of_files(files: DataFrame) -> DataFrame:
    """(word, id, weight) of a base's files: 1 for each line that holds the word; lines that begin with ** count for their metadata only, 2 a keyword."""
    lines = indexed_files(files).select("id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    weighted = lambda words, n: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(n).cast("long").alias("weight")))
    words = F.when(F.col("line").startswith("**"), weighted(S.metadata_keywords("line"), 2)).otherwise(weighted(S.trie_tokens("line"), 1))
    return lines.select("id", F.inline(words)).groupBy("word", "id").agg(F.sum("weight").alias("weight"))


@dataclass(frozen=True)
class PrefixIndex:
    spark: SparkSession
    path: str
    version: int = 0
    tables: tuple[tuple[str, str], ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> PrefixIndex:
        number, tables = V.read(spark, path, version)
        return cls(spark, path, number, tuple(sorted(tables.items())))

    def table(self, name: str) -> DataFrame:
        folders = dict(self.tables)
        if name not in folders:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{folders[name]}")

    def publish(self, entries: DataFrame) -> PrefixIndex:
        """entries: word, id, weight, as retrieval.vocabulary has them; the index that follows holds these alone."""
        new = {name: V.folder(self.path, name).removeprefix(f"{self.path}/") for name in ("entries", "words", "tops")}
        coded = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#word": "false", "parquet.block.size": ROW_GROUP_BYTES}

        def stored(rows: DataFrame, name: str) -> DataFrame:
            rows.write.options(**coded).parquet(f"{self.path}/{new[name]}")
            return self.spark.read.parquet(f"{self.path}/{new[name]}")

        # ranges are sampled by a run of their own, so the entries are worked out before
        kept = graph.stored(entries.select("word", "id", "weight").where("word <> ''"))
        some = stored(kept.repartitionByRange("word", "id").sortWithinPartitions("word", "id"), "entries")
        words = some.groupBy("word").agg(F.sum("weight").alias("frequency"), F.count("*").alias("n_entries"))
        words = stored(graph.stored(words).repartitionByRange("word").sortWithinPartitions("word"), "words")
        prefixes = F.transform(F.sequence(F.lit(1), F.least(F.char_length("word"), F.lit(SHORT))), lambda n: F.substring("word", F.lit(1), n))
        best = Window.partitionBy("prefix").orderBy(F.desc("frequency"), "word")
        tops = words.select(F.explode(prefixes).alias("prefix"), "*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= BEST)
        stored(tops.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank"), "tops")
        number = V.publish(self.spark, self.path, new, self.version)
        return PrefixIndex(self.spark, self.path, number, tuple(sorted(new.items())))

    def add(self, entries: DataFrame) -> PrefixIndex:
        """Weights of a word and an id that are there already add up."""
        every = self.table("entries").unionByName(entries.select("word", "id", "weight")) if self.tables else entries
        return self.publish(every.groupBy("word", "id").agg(F.sum("weight").alias("weight")))

    def delete(self, ids: DataFrame) -> PrefixIndex:
        """Without the entries of ids: frequencies fall by their weights, and words without entries go."""
        return self.publish(self.table("entries").join(ids.select("id"), "id", "left_anti"))

    def autocomplete(self, prefix: str, limit: int = 10) -> DataFrame:
        """(word, frequency, n_entries), most frequent first; nothing for a blank prefix."""
        p = prefix.lower().strip()
        if p and len(p) <= SHORT and limit <= BEST:
            found = self.table("tops").where(F.col("prefix") == p)
        else:
            found = self.table("words").where(in_prefix("word", p) if p else F.lit(False))
        return found.select("word", "frequency", "n_entries").orderBy(F.desc("frequency"), "word").limit(limit)

    def search(self, prefix: str) -> DataFrame:
        """Distinct ids of the words that begin with prefix; a blank one means all."""
        p = prefix.lower().strip()
        return self.table("entries").where(in_prefix("word", p) if p else F.lit(True)).select("id").distinct()
