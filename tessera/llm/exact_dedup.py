"""Exact dedup with a log-structured merge index of digests (native: DataFrame operations only).

The digests of the documents are written once. They reach the index in batches, the memtables: Spark's map-side combine folds a
batch to one entry a digest, and the entries are flushed as an immutable run, sorted by digest, with a filter. Runs stand in levels;
`fan_in` runs of a level are merged into one of the next level, which keeps, for every digest, the identifier that stays (the
smallest or the largest) and the number of rows. A filter is a bitmap of at most FILTER_WORDS words of 64 bits, so it can be
broadcast; a digest whose bit is off is in no run and goes no further.

At the end the runs are compacted, and a filter of the digests with several rows sends only likely copies to the look-up. Every hit
is then verified by its bytes against the document that stays. A group so large that it would stay in one task is dealt to
several by a salt, at most HOT of them, known from the index. Should two texts share a digest, their rows are grouped by bytes.

Defined results. Null text counts as the empty text, so null and empty texts are copies of each other. A null id is smaller than
any other. Rows that repeat an id are rows of their own; if their texts are equal too, all of them carry the same `kept`. An empty
table gives an empty result. Extra columns are ignored, whatever their names. Copies of a document of an earlier batch are verified
where `history` holds its text; without that they rest on the digest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import versions

from .common import ascii_lower, id_key, new_path, partitions, real_id, text_of

FILTER_WORDS = 1 << 17
#: Most groups that are salted; rows of a memtable, and memtables of a table at least.
HOT, MEMTABLE_ROWS, MEMTABLES = 1000, 1 << 28, 4


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, norm, digest): the digest of the normalised text in UTF-8."""
    rows = docs.select(id_key(id_col).alias("id"), ascii_lower(text_of(text_col)).alias("norm"))
    return rows.withColumn("digest", digest(F.col("norm")))


def _bit(digest: str = "digest") -> tuple[Column, Column]:
    at = F.xxhash64(digest)
    return F.pmod(F.shiftright(at, 6), F.lit(FILTER_WORDS)).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")


def filter_of(digests: DataFrame) -> DataFrame:
    """(word, bits): the words of the bitmap that are not zero."""
    return digests.select(*_bit()).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def maybe_in(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows whose digest may be among those of the bitmap; the bitmap has at most FILTER_WORDS rows."""
    word, bit = _bit()
    found = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(bitmap.select(F.col("word").alias("__word"), "bits")), "__word")
    return found.where(F.getbit("bits", F.col("__bit")) == 1).select(*rows.columns)


class DigestIndex:
    """Levels of sorted runs of (digest, id that stays, rows) in a shared folder. keep is 'largest' or 'smallest'.

    Each flush and compaction publishes a version that names the runs, so an index at a path opens again as it was after the last one that was
    finished; a flush that breaks off leaves nothing to be read. Of two writers at one path the later one raises versions.Conflict.
    """

    ENTRY, BITMAP = "digest string, keep_id long, rows long", "word long, bits long"

    def __init__(self, spark: SparkSession, keep: str = "smallest", path: str | None = None, fan_in: int = 4):
        if keep not in ("largest", "smallest"):
            raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
        self.spark, self.keep, self.fan_in = spark, keep, fan_in
        self.path = path or new_path(spark, "digest-index")
        self.version, known = versions.read(spark, self.path)
        if known.get("keep", keep) != keep:
            raise ValueError(f"the index at {self.path} keeps the {known['keep']} id")
        self.levels = [[f"{self.path}/{run}" for run in level] for level in known.get("levels", [])]

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _best(self, column: str) -> Column:
        return (F.max if self.keep == "largest" else F.min)(column).alias("keep_id")

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.ENTRY).parquet(*[f"{r}/entries" for r in runs])

    def _add(self, entries: DataFrame, level: int) -> None:
        to = f"{self.path}/run-{uuid.uuid4().hex}"
        entries.sortWithinPartitions("digest").write.parquet(f"{to}/entries")
        filter_of(self._read([to])).coalesce(1).write.parquet(f"{to}/filter")  # at most FILTER_WORDS rows
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(to)

    def flush(self, batch: DataFrame) -> None:
        """batch: (id, digest). Adds a run to the first level; full levels are merged into the next."""
        self._add(batch.groupBy("digest").agg(self._best("id"), F.count("*").alias("rows")), 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged, self.levels[level] = self.levels[level], []
            self._add(self._merged(merged), level + 1)
            level += 1
        self._publish()

    def compact(self) -> None:
        if len(runs := self.runs) > 1:
            self.levels = [[] for _ in self.levels]
            self._add(self._merged(runs), len(self.levels))
            self._publish()

    def _publish(self) -> None:
        names = [[run.removeprefix(f"{self.path}/") for run in level] for level in self.levels]
        self.version = versions.publish(self.spark, self.path, {"keep": self.keep, "levels": names}, self.version)

    def removed(self) -> None:
        """Deletes the runs that were merged into others. Results that are still to be read from them must have been written before."""
        if self.version:
            versions.removed_before(self.spark, self.path, self.version)

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._read(runs).groupBy("digest").agg(self._best("keep_id"), F.sum("rows").alias("rows"))

    def lookup(self, batch: DataFrame) -> DataFrame:
        """(digest, keep_id, rows) of those digests of batch that the runs hold: each run is asked only for what its filter lets through."""
        digests = batch.select("digest").distinct()
        found = self.spark.createDataFrame([], self.ENTRY)
        for run in self.runs:
            bitmap = self.spark.read.schema(self.BITMAP).parquet(f"{run}/filter")
            found = found.unionByName(self._read([run]).join(maybe_in(digests, bitmap), "digest", "left_semi"))
        return found.groupBy("digest").agg(self._best("keep_id"), F.sum("rows").alias("rows"))

    def entries(self) -> DataFrame:
        """The compacted view: one row a digest."""
        runs = self.runs
        if not runs:
            return self.spark.createDataFrame([], self.ENTRY)
        return self._merged(runs) if len(runs) > 1 else self._read(runs)


def differing(texts: DataFrame, repeats: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is not that of the row that stays, all rows with the digests of repeats). texts: id, norm, digest; repeats: digest, keep_id, rows."""
    limit = F.greatest(F.lit(1024), F.sum("rows") / (4 * n)).cast("long")
    dealt = repeats.join(F.broadcast(repeats.agg(limit.alias("limit")))).withColumn("salts", F.ceil(F.col("rows") / F.col("limit")).cast("int"))
    hot = dealt.where("salts > 1").orderBy(F.desc("rows"), "digest").limit(HOT).select("digest", F.col("salts").alias("hot"))
    salted = texts.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id", "norm"), F.coalesce("hot", F.lit(1))).cast("int")).drop("hot")
    shares = F.explode(F.sequence(F.lit(0), F.coalesce("hot", F.lit(1)) - 1)).alias("salt")
    rows = salted.join(repeats.join(F.broadcast(hot), "digest", "left").select("digest", "keep_id", "hot", shares).hint("merge"), ["digest", "salt"])
    stays = rows.where("id = keep_id").groupBy("digest").agg(F.min("norm").alias("keeper"), F.first("hot").alias("hot")).select("digest", "keeper", shares)
    return rows.join(stays.hint("merge"), ["digest", "salt"]).where("norm <> keeper"), rows


def exact_dedup(
    docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None,
    history: DataFrame | None = None, memtables: int = MEMTABLES, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Returns id, keep_id, group_size, kept, digest for each row of docs.

    index: what earlier batches left, if anything; history: the documents of those batches (same columns as docs).
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, keep)
    if index.keep != keep:
        raise ValueError(f"the index keeps the {index.keep} id")
    path = new_path(spark, "digests")
    rows = normalised(docs, id_col, text_col, digest).select("id", F.xxhash64("norm").alias("t"), "digest")
    rows.write.parquet(path)
    own = spark.read.schema("id long, t long, digest string").parquet(path)
    memtables = max(memtables, -(-own.count() // MEMTABLE_ROWS))
    for i in range(memtables):
        index.flush(own.where(F.pmod(F.xxhash64("id"), F.lit(memtables)) == i).select("id", "digest"))
    index.compact()
    repeats = index.entries().where("rows > 1")
    likely = filter_of(repeats)
    texts = normalised(docs, id_col, text_col, digest)
    if history is not None:
        texts = texts.unionByName(normalised(history, id_col, text_col, digest))
    odd, members = differing(maybe_in(texts, likely), repeats, partitions(docs))
    found = own.join(repeats, "digest", "left").select("id", "t", "digest", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"))
    bad = odd.select("digest").distinct()
    if not bad.isEmpty():
        best = (F.max if keep == "largest" else F.min)("id").alias("best")
        again = members.join(bad, "digest", "left_semi").groupBy("digest", "norm").agg(best, F.count("*").alias("n")).select("digest", F.xxhash64("norm").alias("t"), "best", "n")
        found = found.join(again, ["digest", "t"], "left").withColumns({"keep_id": F.coalesce("best", "keep_id"), "group_size": F.coalesce("n", "group_size")})
    return found.select("id", "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "digest")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs, keep="largest")
    return out.select(real_id("id").alias("doc_id"), real_id("keep_id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
