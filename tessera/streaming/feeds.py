"""Structured Streaming (M1-M12): change feeds, debounce, micro-batches, keyed documents under JSON Patch, state machines.

Offsets and checkpoints take the place of acknowledgements, retries and offline buffers. The watermark (10 minutes on the event's
time) is this library's choice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States of a connection and where they may go.
TRANSITIONS = {"disconnected": ["connecting"], "connecting": ["connected", "disconnected"], "connected": ["disconnected", "reconnecting"], "reconnecting": ["connecting", "connected", "disconnected"]}


def file_feed(spark: SparkSession, path: str, schema, per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def subscribed(feed: DataFrame, **equal) -> DataFrame:
    for k, v in equal.items():
        feed = feed.where(F.col(k) == v)
    return feed


def deduplicated(feed: DataFrame, key: str = "event_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def debounced(feed: DataFrame, key: str = "user_id", path: str = "event_type", at: str = "ts", gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """One row a burst: events of a key with less than gap between them, with their distinct paths."""
    s = feed.withWatermark(at, late) if feed.isStreaming else feed
    g = s.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(path)), ",").alias("paths"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "paths")


def windowed_counts(feed: DataFrame, key: str = "event_type", at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    s = feed.withWatermark(at, late) if feed.isStreaming else feed
    return s.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def latest_state(changes: DataFrame) -> DataFrame:
    """CREATE, UPDATE, DELETE by seq: each id's last change, unless that is a DELETE."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("action", "value"), "seq").alias("x"))
    return last.where("x.action <> 'DELETE'").select("id", F.col("x.value").alias("value"))


def patched(doc, ops: list[dict]):
    """RFC 6902: add, remove, replace, move, copy, test. A failed test leaves the document as it was."""
    def parts(p):
        return [x.replace("~1", "/").replace("~0", "~") for x in p.split("/")[1:]]

    def get(root, path):
        for k in path:
            root = root[int(k)] if isinstance(root, list) else root[k]
        return root

    def put(root, path, value, insert):
        if not path:
            return value
        at = get(root, path[:-1])
        if isinstance(at, list):
            i = len(at) if path[-1] == "-" else int(path[-1])
            at.insert(i, value) if insert else at.__setitem__(i, value)
        else:
            at[path[-1]] = value
        return root

    def drop(root, path):
        at = get(root, path[:-1])
        return at.pop(int(path[-1]) if isinstance(at, list) else path[-1])

    new = json.loads(json.dumps(doc))
    for o in ops:
        kind, path = o["op"], parts(o["path"])
        if kind in ("add", "replace"):
            new = put(new, path, o["value"], kind == "add")
        elif kind == "remove":
            drop(new, path)
        elif kind in ("move", "copy"):
            src = parts(o["from"])
            value = drop(new, src) if kind == "move" else json.loads(json.dumps(get(new, src)))
            new = put(new, path, value, True)
        elif kind == "test":
            if get(new, path) != o["value"]:
                return doc
        else:
            raise ValueError(kind)
    return new


def documents_under_patch(feed: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """feed: id, seq, patch (a JSON array of operations). State is one document an id; out comes each id's document after a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc, seq = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -1)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        for s, patch in zip(rows["seq"], rows["patch"]):
            if s > seq:  # a repeated delivery changes nothing
                doc, seq = patched(doc, json.loads(patch)), int(s)
        state.update((json.dumps(doc, sort_keys=True), seq))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"id": [key[0]], "seq": [seq], "document": [json.dumps(doc, sort_keys=True)]})

    return feed.groupBy("id").applyInPandasWithState(step, "id string, seq long, document string", "document string, seq long", "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def state_machine(feed: DataFrame) -> DataFrame:
    """feed: id, seq, state. Transitions that aren't allowed are passed over; out comes each id's state and the number of refused ones."""

    def step(key, frames, state):
        now, refused = state.get if state.exists else ("disconnected", 0)
        for to in pd.concat(list(frames)).sort_values("seq")["state"]:
            if to in TRANSITIONS.get(now, []):
                now = to
            else:
                refused += 1
        state.update((now, refused))
        yield pd.DataFrame({"id": [key[0]], "state": [now], "refused": [refused]})

    return feed.groupBy("id").applyInPandasWithState(step, "id string, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def in_batches(feed: DataFrame, write, checkpoint: str, seconds: int | None = None):
    """foreachBatch: every 'seconds', or all there is (availableNow)."""
    w = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
