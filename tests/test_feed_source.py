"""The change feed over a local server: restarts, breaks, commits, frames by kind."""

import json
import socketserver
import threading

import pytest

from tessera.streaming import source as S


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self):
        self.log, self.acks, self.breaks, self.reads = {"p0": [], "p1": []}, [], 0, []
        super().__init__(("127.0.0.1", 0), Handler)

    def add(self, partition, frame):
        self.log[partition].append(frame | {"seq": len(self.log[partition]) + 1})


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        request, say = json.loads(self.rfile.readline()), lambda x: self.wfile.write(json.dumps(x).encode() + b"\n")
        if request["op"] == "latest":
            say({p: len(x) for p, x in self.server.log.items()})
        elif request["op"] == "ack":
            self.server.acks.append(request["seqs"])
            say({"type": "ack"})
        else:
            self.server.reads.append((request["partition"], request["after"], request["upto"]))
            for i, frame in enumerate(self.server.log[request["partition"]][request["after"] : request["upto"]]):
                if i == 2 and self.server.breaks > 0:
                    self.server.breaks -= 1
                    return  # the connection breaks off
                say(frame)
            say({"type": "end"})


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def fill(server, n, start=0):
    for i in range(start, start + n):
        server.add(f"p{i % 3 % 2}", {"type": "change", "action": S.ACTIONS[i % 3], "result": {"id": i % 7, "tenant": f"t{i % 2}", "value": i}})


def run(spark, frames, tmp_path, name, fail_at=None):
    """Drains the feed into a table; a batch may fail once, before it is done."""
    def write(df, number):
        if fail_at == number:
            df.collect()
            raise RuntimeError("the batch fails")
        df.write.mode("append").parquet(str(tmp_path / name))

    q = frames.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    except Exception:
        if fail_at is None:
            raise


def seqs(spark, tmp_path, name):
    return sorted((r.partition, r.seq) for r in spark.read.parquet(str(tmp_path / name)).collect())


def test_restarts_neither_lose_nor_repeat(spark, server, tmp_path):
    endpoint = f"127.0.0.1:{server.server_address[1]}"
    fill(server, 40)
    server.breaks = 3
    run(spark, S.feed(spark, endpoint), tmp_path, "all")
    whole = [(p, i) for p, n in ((p, len(x)) for p, x in server.log.items()) for i in range(1, n + 1)]
    assert seqs(spark, tmp_path, "all") == sorted(whole) and server.breaks == 0
    fill(server, 30, 40)
    run(spark, S.feed(spark, endpoint), tmp_path, "all", fail_at=1)
    assert seqs(spark, tmp_path, "all") == sorted(whole)  # the failed batch left nothing
    fill(server, 5, 70)
    run(spark, S.feed(spark, endpoint), tmp_path, "all")  # the range that failed, as it was planned
    run(spark, S.feed(spark, endpoint), tmp_path, "all")
    whole = [(p, i) for p, n in ((p, len(x)) for p, x in server.log.items()) for i in range(1, n + 1)]
    assert seqs(spark, tmp_path, "all") == sorted(whole)
    assert all(a <= len(server.log[p]) for x in server.acks for p, a in x.items())


def test_frames_by_kind(spark, server, tmp_path):
    fill(server, 12)
    server.add("p0", {"type": "error", "message": "no such tenant"})
    server.add("p1", {"type": "notice", "text": "hello"})
    server.add("p1", {"type": "change", "action": "MOVED", "result": {"id": 1}})
    run(spark, S.feed(spark, f"127.0.0.1:{server.server_address[1]}"), tmp_path, "kinds")
    frames = spark.read.parquet(str(tmp_path / "kinds"))
    by = S.dispatched(frames)
    assert {(r.action, r.id, json.loads(r.data)["value"]) for r in by["changes"].collect()} == {(S.ACTIONS[i % 3].lower(), str(i % 7), i) for i in range(12)}
    assert [r.message for r in by["errors"].collect()] == ["no such tenant"] and by["other"].count() == 2
    some = S.dispatched(frames, ids=["1", "2"], tenant="t1")["changes"]
    assert {json.loads(r.data)["value"] for r in some.collect()} == {i for i in range(12) if i % 7 in (1, 2) and i % 2}


def test_a_server_that_is_gone(server):
    client = S.Client(f"127.0.0.1:{server.server_address[1]}", timeout=1, retries=1)
    fill(server, 9)
    server.breaks = 100
    with pytest.raises(S.FeedError):
        list(S.Client(f"127.0.0.1:{server.server_address[1] + 0}", 1, 0).frames("p0", 0, 5))
    server.log["p1"][1]["seq"] = 7
    with pytest.raises(S.FeedError):
        list(client.frames("p1", 0, 3))
    with pytest.raises(S.FeedError):
        S.Client("127.0.0.1:1", 1, 0).ask({"op": "latest"})
