"""The bounded queue as a stream: against a plain walk of the ordered rows, out of order and restarted."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tessera.streaming import queues as K

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "project string, path string, at timestamp, seq long"


def walked(rows, bound, batch, wait, expiry, busy):
    """Millisecond by millisecond, by the words of the module."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r[2], r[3], r[1]) for r in rows if r[0] == key)
        queue, busy_until, batches = [], 0, 0
        for now in range(0, mine[-1][0] + 20_000):
            arrivals = [m for m in mine if m[0] == now]
            while True:
                if arrivals:
                    a = arrivals.pop(0)
                    if len(queue) >= bound:
                        out.append((key, queue.pop(0)[2], "dropped", None, now))
                    queue = [q for q in queue if q[2] != a[2]] + [a]
                while queue and now >= busy_until and (len(queue) >= batch or now >= queue[0][0] + wait):
                    old, live = [q for q in queue if now - q[0] >= expiry], [q for q in queue if now - q[0] < expiry]
                    out += [(key, q[2], "expired", None, now) for q in old]
                    queue = live[batch:]
                    if live:
                        batches, busy_until = batches + 1, now + busy
                        out += [(key, q[2], "flushed", batches, now) for q in live[:batch]]
                if not arrivals:
                    break
    return sorted(out, key=str)


def sample(seed, n=120):
    r = random.Random(seed)
    rows, now = [], {k: 1000 for k in "ab"}
    for i in range(n):
        k = r.choice("aab")
        now[k] += r.choice([0, 5, 40, 120, 700, 2600])
        rows.append((k, f"f{r.randrange(9)}.ts", now[k], i))
    return rows


def streamed(spark, tmp_path, rows, cuts, name, **limits):
    """The rows as files in the given pieces; the stream stops and starts again after each."""
    K.ready(spark)
    (tmp_path / name).mkdir()
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = K.queued(feed, late="1 hour", **limits)
    end = max(r[2] for r in rows)
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[("end", "e", end + 2 * 3_600_000, 10**6)], [("end", "e", end + 4 * 3_600_000, 10**6 + 1)]]
    for piece in pieces:
        stamped = [(k, p, START + timedelta(milliseconds=t), s) for k, p, t, s in piece]
        spark.createDataFrame(stamped, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    ms = lambda t: round((t.replace(tzinfo=timezone.utc) - START).total_seconds() * 1000)
    found = spark.read.parquet(str(tmp_path / f"{name}-out")).where("key <> 'end'").collect()
    return sorted(((r.key, r.path, r.action, r.batch, ms(r.due)) for r in found), key=str)


@pytest.mark.parametrize("limits", [dict(bound=10, batch=10, wait_ms=2000, expiry_ms=5000, busy_ms=0), dict(bound=4, batch=3, wait_ms=2000, expiry_ms=2500, busy_ms=3000)])
def test_plain_queue(limits):
    """The helper by itself, row by row."""
    plain = {"bound": limits["bound"], "batch": limits["batch"], "wait": limits["wait_ms"], "expiry": limits["expiry_ms"], "busy": limits["busy_ms"]}
    for seed in range(6):
        rows, out = sample(seed), []
        for key in "ab":
            queue = K.Queue([], 0, 0, **plain)
            for at, seq, path in sorted((r[2], r[3], r[1]) for r in rows if r[0] == key):
                queue.push(at, seq, path)
            queue.until(10**9)
            out += [(key, i[2], action, batch, when) for i, action, batch, when in queue.out]
        want = walked(rows, **plain)
        assert sorted(out, key=str) == want
        assert {x[2] for x in want} == ({"flushed", "dropped", "expired"} if limits["bound"] == 4 else {"flushed"})


def test_out_of_order_and_restarted(spark, tmp_path):
    limits = dict(bound=4, batch=3, wait_ms=2000, expiry_ms=2500, busy_ms=3000)
    rows = sample(3, 80)
    want = walked(rows, 4, 3, 2000, 2500, 3000)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert streamed(spark, tmp_path, rows, [], "whole", **limits) == want
    assert streamed(spark, tmp_path, mixed, [25, 50], "mixed", **limits) == want
