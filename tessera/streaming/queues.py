"""A bounded queue for each key with timers (C13, M4, M12, Q11): one item a path, drop-oldest, flush by count or time, expiry, no overlap.

The queue runs on event time. Rows wait in state until the watermark has passed them and are then taken in order, so late or restarted input and
other batch sizes give the same result. A key's state is what waits, the items of its queue, at most `bound`, and a row of clocks.

For a row at time t, in this order:
* what was due before t happens first;
* a queue with `bound` items drops its oldest, then the row takes the place of an item with its path, at the end of the queue;
* with `batch` items, or `wait` after the oldest item came, the queue is flushed: what is older than `expiry` goes as expired, the rest as one batch;
* a flush takes `busy` to be worked off; the key's next one waits until then.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.shipping import ship

ship(__name__)

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue:
    """The items of a key as (at, seq, path), in the order they came, and its clocks, all in milliseconds."""

    def __init__(self, items, busy_until: int, batches: int, bound: int, batch: int, wait: int, expiry: int, busy: int):
        self.items, self.busy_until, self.batches = sorted(items), busy_until, batches
        self.bound, self.batch, self.wait, self.expiry, self.busy = bound, batch, wait, expiry, busy
        self.out: list[tuple] = []

    def due(self) -> int | None:
        """When the next flush is due, if anything is queued."""
        if not self.items:
            return None
        full = self.items[self.batch - 1][0] if len(self.items) >= self.batch else None
        at = self.items[0][0] + self.wait if full is None else min(full, self.items[0][0] + self.wait)
        return max(at, self.busy_until)

    def _flush(self, now: int) -> None:
        old = [i for i in self.items if now - i[0] >= self.expiry]
        live = [i for i in self.items if now - i[0] < self.expiry]
        self.out += [(i, "expired", None, now) for i in old]
        self.items = live[self.batch :]
        if live:
            self.batches += 1
            self.busy_until = now + self.busy
            self.out += [(i, "flushed", self.batches, now) for i in live[: self.batch]]

    def until(self, now: int) -> None:
        """Everything that is due by now."""
        while (at := self.due()) is not None and at <= now:
            self._flush(at)

    def push(self, at: int, seq: int, path: str) -> None:
        self.until(at - 1)
        if len(self.items) >= self.bound:
            self.out.append((self.items.pop(0), "dropped", None, at))
        self.items = [i for i in self.items if i[2] != path] + [(at, seq, path)]
        self.until(at)


class Processor(StatefulProcessor):
    def __init__(self, **limits: int):
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", "path string")
        self.items = handle.getMapState("items", "at long, seq long", "path string")
        self.clock = handle.getValueState("clock", "busy_until long, batches long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.at_ms, r.seq), (r.path,))
            self.handle.registerTimer(r.at_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        clock = self.clock.get() if self.clock.exists() else (0, 0)
        items = [(k[0], k[1], v[0]) for k, v in self.items.iterator()] if self.items.exists() else []
        queue = Queue(items, clock[0], clock[1], **self.limits)
        ready = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= now) if self.waiting.exists() else []
        for at, seq, path in ready:
            queue.push(at, seq, path)
            self.waiting.removeKey((at, seq))
        queue.until(now)
        before, after = set(items), set(queue.items)
        for at, seq, _ in before - after:
            self.items.removeKey((at, seq))
        for at, seq, path in after - before:
            self.items.updateValue((at, seq), (path,))
        self.clock.update((queue.busy_until, queue.batches))
        if (due := queue.due()) is not None:
            self.handle.registerTimer(due)
        for (at, _, path), action, batch, when in queue.out:
            yield Row(key=key[0], path=path, at_ms=at, action=action, batch=batch, due_ms=when)

    def close(self) -> None:
        pass


def ready(spark: SparkSession) -> None:
    """The state store that transformWithState asks for; set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def queued(
    feed: DataFrame, key: str = "project", path: str = "path", at: str = "at", seq: str = "seq", bound: int = 10, batch: int = 10, wait_ms: int = 2000, expiry_ms: int = 5000, busy_ms: int = 0, late: str = "10 seconds",
) -> DataFrame:
    """(key, path, at, action, batch, due): what becomes of each row that isn't replaced: flushed (with the number of its batch), dropped or expired.

    feed: a stream with key, path, at (timestamp) and seq; at and seq tell a key's rows apart. Rows later than `late` are left out.
    """
    rows = feed.select(F.col(key).cast("string").alias("key"), F.col(path).cast("string").alias("path"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(seq).cast("long").alias("seq")).where("at IS NOT NULL AND path IS NOT NULL")
    processor = Processor(bound=bound, batch=batch, wait=wait_ms, expiry=expiry_ms, busy=busy_ms)
    out = rows.withWatermark("at", late).groupBy("key").transformWithState(processor, "key string, path string, at_ms long, action string, batch long, due_ms long", "append", "EventTime")
    return out.select("key", "path", F.timestamp_millis("at_ms").alias("at"), "action", "batch", F.timestamp_millis("due_ms").alias("due"))
