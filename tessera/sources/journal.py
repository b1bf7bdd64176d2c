"""An append-only log as a table (K19, S21): rows are redacted when they are written, kept by day, and never changed.

Every append is a folder of its own that a version names (see versions.py), so readers see a batch as a whole or not at all, and a crashed append
leaves nothing to be read. Writers number their batches: a batch that comes again, because its writer was restarted, is left out. Appends of
several writers may meet; the one that loses publishes again after the other, its rows are not written twice. `compact` joins the folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.sources import versions as V

SCHEMA = "at timestamp, level string, category string, message string, data map<string,string>, day date"


def _utc(at: Column) -> Column:
    """The clock time in UTC, whatever the session's zone: days and lines don't depend on who writes or reads."""
    return F.to_utc_timestamp(at, F.current_timezone())


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _now(self) -> tuple[int, dict]:
        number, content = V.read(self.spark, self.path)
        return number, content or {"folders": [], "writers": {}}

    def append(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """rows: at, level, category, message, data (map of strings). False, and nothing is written, where the writer's batch is in the log.

        Fields with secret names are blanked before anything is stored; rows of level DEBUG keep no data; rows without a time are put under the day null.
        """
        if self._now()[1]["writers"].get(writer, -1) >= batch:
            return False
        kept = F.when(~F.col("level").eqNullSafe("DEBUG"), S.redacted("data"))
        folder = self._folder()
        at = F.col("at").cast("timestamp")
        safe = rows.select(at.alias("at"), "level", "category", "message", kept.alias("data"), F.to_date(_utc(at)).alias("day"))
        safe.write.partitionBy("day").parquet(f"{self.path}/{folder}")
        while True:
            number, content = self._now()
            if content["writers"].get(writer, -1) >= batch:
                return False
            content = {"folders": [*content["folders"], folder], "writers": content["writers"] | {writer: batch}}
            try:
                V.publish(self.spark, self.path, content, number)
                return True
            except V.Conflict:
                continue

    def compact(self) -> None:
        """Joins the folders into one, a file or a few for each day. Not while another writer is at work: it raises Conflict, and the log stays as it was."""
        number, content = self._now()
        if len(content["folders"]) > 1:
            folder = self._folder()
            self._read(content).repartitionByRange("day", "at").sortWithinPartitions("day", "at").write.partitionBy("day").parquet(f"{self.path}/{folder}")
            number = V.publish(self.spark, self.path, content | {"folders": [folder]}, number)
        V.removed_before(self.spark, self.path, number)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The rows of the days from first to last; other days' files aren't read."""
        rows = self._read(self._now()[1])
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
        return rows if last is None else rows.where(F.col("day") <= F.lit(last).cast("date"))

    def _folder(self) -> str:
        return f"part=p{uuid.uuid4().hex}"

    def _read(self, content: dict) -> DataFrame:
        if not content["folders"]:
            return self.spark.createDataFrame([], SCHEMA)
        schema = SCHEMA.replace("day date", "part string, day date")
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in content["folders"]]).drop("part")


def lines() -> Column:
    """A row as a line of text: time, level, category, message, and its data as JSON where there are any."""
    at = F.date_format(_utc(F.col("at")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    data = F.when(F.size("data") > 0, F.concat(F.lit(" "), F.to_json("data"))).otherwise("")
    return F.concat(F.lit("["), at, F.lit("] ["), "level", F.lit("] ["), "category", F.lit("] "), F.coalesce("message", F.lit("")), data)


def accesses(rows: DataFrame, key: Column, by: list[Column] | None = None) -> DataFrame:
    """(by, key, accesses, first_at, last_at): how often and when each key occurs. Rows without a key don't count."""
    return rows.withColumn("key", key).where("key IS NOT NULL").groupBy(*(by or []), "key").agg(F.count("*").alias("accesses"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
