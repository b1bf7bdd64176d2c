"""A change feed as a stream source (S23, M1, M2, M10, Z32): `spark.readStream.format("tessera_feed")`.

The feed is a server that keeps numbered frames in partitions and answers requests of one JSON line over TCP:
    {"op": "latest"}                                             -> {"<partition>": last seq, ...}
    {"op": "read", "partition": p, "after": a, "upto": b}        -> one frame a line, seq a + 1 to b, then {"type": "end"}
    {"op": "ack", "seqs": {"<partition>": seq, ...}}             -> {"type": "ack"}
An offset is the last seq of each partition, and a batch is a range of seqs a partition, read by as many tasks as there are partitions. Spark keeps
the offsets in the query's checkpoint and repeats a range whose batch didn't end, so a restart neither loses nor repeats a seq; frames
are acknowledged when Spark goes on to the next batch, so the server may forget them then. With the trigger availableNow a
restart first ends the batch that was left, and what came since comes with the next start. A connection that breaks is tried again `retries` times.

Options: endpoint (host:port), per_batch (frames a partition and batch, 10,000), after (seq to begin behind, 0), timeout (seconds, 10), retries (3).
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.shipping import ship

ship(__name__)

SCHEMA = "partition string, seq long, type string, action string, id string, tenant string, body string"
# The kinds of frames, and the actions of changes.
CHANGE, ERROR = "change", "error"
ACTIONS = ["CREATE", "UPDATE", "DELETE"]


class FeedError(RuntimeError):
    """The server can't be reached, or broke off, more often than is allowed."""


class Client:
    def __init__(self, endpoint: str, timeout: float = 10, retries: int = 3):
        host, _, port = endpoint.rpartition(":")
        self.address, self.timeout, self.retries = (host, int(port)), timeout, retries

    def _lines(self, request: dict) -> Iterator[dict]:
        with socket.create_connection(self.address, self.timeout) as s, s.makefile("rwb") as f:
            f.write(json.dumps(request).encode() + b"\n")
            f.flush()
            for line in f:
                yield json.loads(line)

    def _tried(self, work):
        for n in range(self.retries + 1):
            try:
                return work()
            except (OSError, ValueError, StopIteration) as e:
                if n == self.retries:
                    raise FeedError(f"{self.address[0]}:{self.address[1]}: {e!r}") from e
                time.sleep(0.1 * 2**n)

    def ask(self, request: dict) -> dict:
        return self._tried(lambda: next(self._lines(request)))

    def frames(self, partition: str, after: int, upto: int) -> Iterator[dict]:
        """Frames in the order of their numbers. After a break it goes on behind the last one that came."""
        at, failures = after, 0
        while at < upto:
            try:
                for frame in self._lines({"op": "read", "partition": partition, "after": at, "upto": upto}):
                    if frame.get("type") == "end":
                        break
                    if frame["seq"] != at + 1:
                        raise FeedError(f"partition {partition}: seq {at + 1} is missing")
                    at, failures = frame["seq"], 0
                    yield frame
                if at < upto:
                    raise OSError(f"partition {partition}: the answer ended at {at}, before {upto}")
            except (OSError, ValueError) as e:
                failures += 1
                if failures > self.retries:
                    raise FeedError(f"{self.address[0]}:{self.address[1]}: {e!r}") from e
                time.sleep(0.1 * 2**failures)


class Range(InputPartition):
    def __init__(self, partition: str, after: int, upto: int):
        self.partition, self.after, self.upto = partition, after, upto


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.client = Client(options["endpoint"], float(options.get("timeout", 10)), int(options.get("retries", 3)))
        self.per_batch, self.first = int(options.get("per_batch", 10_000)), int(options.get("after", 0))
        self.given: dict | None = None

    def initialOffset(self) -> dict:
        return {p: self.first for p in self.client.ask({"op": "latest"})}

    def latestOffset(self) -> dict:
        """At most per_batch frames further than what was given out before; that is unknown after a restart, until Spark asks for a range."""
        last = {p: int(n) for p, n in self.client.ask({"op": "latest"}).items()}
        if self.given is not None:
            last = {p: min(n, max(self.given.get(p, self.first), 0) + self.per_batch) for p, n in last.items()}
            last |= {p: n for p, n in self.given.items() if p not in last}
            self.given = last
        return last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.given = dict(end)
        return [Range(p, int(start.get(p, self.first)), int(n)) for p, n in sorted(end.items()) if int(n) > int(start.get(p, self.first))]

    def read(self, partition: Range) -> Iterator[tuple]:
        for f in self.client.frames(partition.partition, partition.after, partition.upto):
            result = f.get("result") or {}
            yield (partition.partition, f["seq"], f.get("type"), f.get("action"), None if result.get("id") is None else str(result["id"]), result.get("tenant"), json.dumps(f, sort_keys=True))

    def commit(self, end: dict) -> None:
        self.client.ask({"op": "ack", "seqs": end})


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def feed(spark: SparkSession, endpoint: str, **options) -> DataFrame:
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("tessera_feed").options(endpoint=endpoint, **options).load()


def dispatched(frames: DataFrame, ids: list[str] | None = None, tenant: str | None = None) -> dict[str, DataFrame]:
    """The frames by what they are: `changes` (partition, seq, action in lower case, id, data), of some ids or a tenant alone if asked, `errors`
    (partition, seq, message), and `other` frames as they came."""
    known = (F.col("type") == CHANGE) & F.col("action").isin(ACTIONS)
    changes = frames.where(known)
    if ids is not None:
        changes = changes.where(F.col("id").isin(ids))
    if tenant is not None:
        changes = changes.where(F.col("tenant") == tenant)
    return {
        "changes": changes.select("partition", "seq", F.lower("action").alias("action"), "id", F.get_json_object("body", "$.result").alias("data")),
        "errors": frames.where(F.col("type") == ERROR).select("partition", "seq", F.get_json_object("body", "$.message").alias("message")),
        "other": frames.where(~F.coalesce(known, F.lit(False)) & ~F.coalesce(F.col("type") == ERROR, F.lit(False))),
    }
