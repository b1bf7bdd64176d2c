"""Substring dedup with a log-structured fingerprint index: words of windows that an earlier document has go.

The fingerprints are those of segments: in each window of `width` words the k-gram with the least hash is its anchor, and the windows
with one anchor form a segment. Equal windows have equal anchors at equal places, so no repeat is lost.

The index is a set of immutable runs in the shared folder, sorted within buckets of fingerprints. A new batch of documents makes
a run of its own; within a few megabytes equal segments are folded to the earliest document's, by comparing their words. Each bucket
merge-joins the batch with the runs of earlier batches by a multikey sort, asks for the words of all segments whose anchor another
document has too, and writes what the index doesn't hold yet as the batch's run. Runs stand in levels; `fan_in` runs of a level are
merged into one of the next, so a record is rewritten once a level and not once a batch. What was asked for meets by anchor:
equal segments are told by their words, and the windows of the others by their hashes, each of which is then verified word by
word against the first. Nothing is removed by a hash alone. Batches come in order: a document of an earlier batch is an earlier document.

Defined results. Null text has no words. A null id is smaller than any other. Rows that repeat id and text are one document and
have the same result; rows that repeat an id alone are documents ordered by a hash of their texts. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import new_path, partitions, real_id, removed_path, restored, row_batches, ship, unique_rows, written
from .repeats import RUN_RECORDS, RUNS, Plan, anchored, even_splitters, merged_marks, multikey_order, packed, run_batch, unpacked
from .suffix_dedup import same_bytes, spans_of

ship(__name__)

MERGED = "id long, s long, e long, place int, bucket int, payload binary"
SCHEMA = "id long, n_words long, n_removed long, kept binary"
RUN_BYTES = 8 << 20


def _batch(ids=(), s=(), e=(), place=None, bucket=(), payload=()) -> pa.RecordBatch:
    n = max(len(ids), len(bucket))
    col = lambda x, t: pa.array(x, type=t) if x is not None and len(x) else pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [col(ids, pa.int64()), col(s, pa.int64()), col(e, pa.int64()), col(place, pa.int32()), col(bucket, pa.int32()), col(payload, pa.binary())],
        names=["id", "s", "e", "place", "bucket", "payload"],
    )


def batches_of(ids, s, e, place=None):
    for lo in range(0, len(ids), 1 << 17):
        x = slice(lo, lo + (1 << 17))
        yield _batch(ids[x], s[x], e[x], None if place is None else place[x])


def normal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they start and end there."""
    size = ends - starts + 1
    out = buf[np.minimum(A.ranges(starts, size), max(0, len(buf) - 1))] if len(starts) else buf[:0].copy()
    begin = np.cumsum(size) - size
    out[begin + size - 1] = 0x20
    return out, begin, begin + size - 1


class Piece:
    """The segments of a few megabytes of texts."""

    def __init__(self, plan: Plan, buf: np.ndarray, off: np.ndarray):
        starts, ends, self.off = A.words(buf, off, A.UNSPACED)
        codes = A.word_codes(buf, starts, ends)
        self.text, self.starts, self.ends = normal(buf, starts, ends)
        self.hasher, anchor, self.row, self.lo, hi = anchored(plan, codes, self.off)
        self.n, self.place, self.s = hi - self.lo + 1, anchor - self.lo, self.lo - self.off[self.row]
        if not len(anchor):
            self.key = self.segment = np.zeros(0, dtype=np.uint64)
            self.tail, self.size = np.zeros(0, dtype=np.uint32), anchor
            return
        self.key = self.hasher.spans(anchor, anchor + plan.k)
        single = A.mix(codes[anchor] * np.uint64(3) + codes[anchor + plan.k // 2] * np.uint64(5) + codes[anchor + plan.k - 1] * np.uint64(7))
        self.tail = (single >> np.uint64(32)).astype(np.uint32)
        self.segment = A.mix(self.hasher.spans(self.lo, hi + plan.width) + self.place.astype(np.uint64))
        self.size = self.ends[hi + plan.width - 1] - self.starts[self.lo]

    def folded(self, ids: np.ndarray) -> np.ndarray:
        """Which segments equal one of an earlier document here, by their words."""
        own = ids[self.row]
        order = np.lexsort((self.s, own, self.segment))
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.segment[order][1:] != self.segment[order][:-1]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        good = (own[order] != own[head]) & (self.size[order] == self.size[head]) & (self.place[order] == self.place[head])
        x, y = order[good], head[good]
        same = same_bytes(self.text, self.starts[self.lo[x]], self.starts[self.lo[y]], self.size[x])
        out = np.zeros(len(order), dtype=bool)
        out[x[same]] = True
        return out


def cut(keys: np.ndarray, splitters: np.ndarray):
    """(bucket, first, end) of the stretches of sorted keys."""
    cuts = np.searchsorted(keys, splitters, side="left")
    for b, (lo, hi) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist())):
        if lo < hi:
            yield b, lo, hi


def records(plan: Plan, splitters: np.ndarray):
    """mapInArrow: (id, text) to runs of fingerprints (key, tail, segment, id, s, n, place), and marks that are known already."""

    def flushed(have, marks, salt):
        known = [np.concatenate(c) for c in zip(*marks)]
        if len(known[0]):  # in pieces, so that no bucket gets them all
            known = merged_marks(*known)
            first = int(A.mix(np.array([salt % (1 << 64)], dtype=np.uint64))[0] >> np.uint64(8))
            for j, lo in enumerate(range(0, len(known[0]), 1 << 13)):
                yield run_batch([((first + j) % (len(splitters) + 1), pickle.dumps(tuple(c[lo : lo + (1 << 13)] for c in known), protocol=5))])
        columns = [np.concatenate(c) for c in zip(*have)]
        order = multikey_order(columns[:5])
        for b, lo, hi in cut(columns[0][order], splitters):
            yield run_batch([(b, packed([c[order[lo:hi]] for c in columns]))])

    def rows(batches):
        have, marks, count, flushes, first = [], [], 0, 0, None
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), A.text_bytes(batch.column(1))
            first = int(ids[0]) if first is None and len(ids) else first
            for lo, hi in A.chunks(offsets):
                p, own = Piece(plan, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), ids[lo:hi]
                later = p.folded(own)
                own = own[p.row]
                marks.append((own[later], p.s[later], p.s[later] + p.n[later] - 1 + plan.width))
                have.append([c[~later] for c in (p.key, p.tail, p.segment, own, p.s, p.n, p.place)])
                count += len(own)
                if count >= RUN_RECORDS:
                    yield from flushed(have, marks, first + flushes)
                    have, marks, count, flushes = [], [], 0, flushes + 1
        if count:
            yield from flushed(have, marks, first + flushes)

    return rows


def merge_runs(plan: Plan):
    """mapInArrow: (bucket, payload, fresh) of one bucket to MERGED: marks, segments whose words are asked for, and the run of what is fresh."""

    def rows(batches):
        old, new, bucket = [], [], 0
        for batch in batches:
            for b, p, fresh in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = pickle.loads(p)
                if isinstance(x, tuple):
                    yield from batches_of(*x)
                else:
                    bucket = b
                    (new if fresh else old).append(p)
        if not new:
            return
        sets = [unpacked(x) for x in (old, new) if x]
        key, tail, segment, ids, s, n, place = (np.concatenate(c) for c in zip(*sets))
        order = multikey_order([key, tail, segment, ids, s])
        fresh = order >= len(key) - len(sets[-1][0])
        k, t, g = key[order], tail[order], segment[order]
        start = np.ones(len(order), dtype=bool)
        start[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        first = start.copy()
        first[1:] |= g[1:] != g[:-1]
        group, at = np.cumsum(start) - 1, np.flatnonzero(start)
        own = ids[order]
        several = (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)) & np.logical_or.reduceat(fresh, at)
        x = order[several[group]]
        yield from batches_of(ids[x], s[x], s[x] + n[x], place[x])
        # Of equal segments of a batch the earliest stays, and none where an older run holds one.
        x = order[fresh & first]
        if len(x):
            yield _batch(bucket=[bucket], payload=[packed([c[x] for c in (key, tail, segment, ids, s, n, place)])])

    return rows


def folded(batches):
    """mapInArrow: the runs of one bucket as one sorted run. Segments differ between runs, so nothing is dropped."""
    payloads, bucket = [], 0
    for batch in batches:
        payloads += batch.column(1).to_pylist()
        bucket = batch.column(0)[0].as_py() if batch.num_rows else bucket
    if payloads:
        columns = unpacked(payloads)
        order = multikey_order(columns[:5])
        yield run_batch([(bucket, packed([c[order] for c in columns]))])


def asked_segments(plan: Plan, splitters: np.ndarray):
    """mapInArrow: (id, text, asked) to runs of segments with their words, in the buckets of their anchors."""

    def flushed(have):
        key, ids, s, n, place, size = (np.concatenate(c) for c in zip(*(h[:6] for h in have)))
        text = np.concatenate([h[6] for h in have])
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        for b, lo, hi in cut(key[order], splitters):
            x = order[lo:hi]
            yield run_batch([(b, pickle.dumps([ids[x], s[x], n[x], place[x], size[x], text[A.ranges(start[x], size[x])]], protocol=5))])

    def rows(batches):
        have, count = [], 0
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), A.text_bytes(batch.column(1))
            asked = batch.column(2)
            per = np.diff(asked.offsets.to_numpy())
            fields = [asked.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            at = np.concatenate([[0], np.cumsum(per)])
            for lo, hi in A.chunks(offsets):
                buf = data[offsets[lo] : offsets[hi]]
                starts, ends, off = A.words(buf, offsets[lo : hi + 1] - offsets[lo], A.UNSPACED)
                text, ws, we = normal(buf, starts, ends)
                s, e, place = (f[at[lo] : at[hi]] for f in fields)
                row = np.repeat(np.arange(hi - lo), per[lo:hi])
                if not len(row):
                    continue
                hasher = A.Hasher(A.word_codes(buf, starts, ends))
                first = off[row] + s
                anchor = first + place
                size = we[off[row] + e - 1 + plan.width - 1] - ws[first] + 1  # with the space after the last word
                have.append((hasher.spans(anchor, anchor + plan.k), ids[lo:hi][row], s, e - s, place, size, text[A.ranges(ws[first], size)]))
                count += int(size.sum())
                if count >= RUN_BYTES:
                    yield from flushed(have)
                    have, count = [], 0
        if count:
            yield from flushed(have)

    return rows


def equal_words(plan: Plan):
    """mapInArrow: the segments of a bucket to marks (id, s, e) of windows that a smaller id has too."""

    def rows(batches):
        have = [pickle.loads(p) for batch in batches for p in batch.column(1).to_pylist()]
        if not have:
            return
        ids, s, n, place, size = (np.concatenate([h[i] for h in have]) for i in range(5))
        text = np.concatenate([h[5] for h in have])
        start = np.cumsum(size) - size
        order = np.lexsort((s, ids))
        raw, known, later = text.tobytes(), {}, []
        for i, who, a, b, p in zip(order.tolist(), ids[order].tolist(), start[order].tolist(), (start + size)[order].tolist(), place[order].tolist()):
            if known.setdefault((p, raw[a:b]), who) != who:
                later.append(i)
        del known
        x = np.array(later, dtype=np.int64)
        if len(x):
            yield from batches_of(*merged_marks(ids[x], s[x], s[x] + n[x] - 1 + plan.width))
        stays = np.ones(len(ids), dtype=bool)
        stays[x] = False
        x = order[stays[order]]
        text = text[A.ranges(start[x], size[x])]
        ws, we, off = A.words(text, np.concatenate([[0], np.cumsum(size[x])]), A.UNSPACED)
        first = A.ranges(off[:-1], n[x])
        owner = np.repeat(x, n[x])
        if not len(first):
            return
        hashes = A.Hasher(A.word_codes(text, ws, we)).spans(first, first + plan.width)
        by = np.argsort(hashes, kind="stable")  # equals in the order of documents
        new = np.ones(len(by), dtype=bool)
        new[1:] = hashes[by][1:] != hashes[by][:-1]
        head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        pair = np.flatnonzero(ids[owner[by]] != ids[owner[head]])
        begin, long = ws[first], we[first + plan.width - 1] - ws[first]
        a, b = by[pair], head[pair]
        same = long[a] == long[b]
        same[same] = same_bytes(text, begin[a[same]], begin[b[same]], long[a[same]])
        hit = np.zeros(len(by), dtype=bool)
        hit[a[same]] = True
        raw = text.tobytes()
        for h in np.unique(hashes[a[~same]]).tolist():  # a hash that different words share
            seen: dict[bytes, int] = {}
            for i in by[np.searchsorted(hashes[by], np.uint64(h)) : np.searchsorted(hashes[by], np.uint64(h), side="right")].tolist():
                hit[i] = seen.setdefault(raw[begin[i] : begin[i] + long[i]], int(ids[owner[i]])) != int(ids[owner[i]])
        y = np.flatnonzero(hit)
        if len(y):
            at = s[owner[y]] + y - (np.cumsum(n[x]) - n[x])[np.repeat(np.arange(len(x)), n[x])[y]]
            yield from batches_of(*merged_marks(ids[owner[y]], at, at + plan.width))

    return rows


class FingerprintIndex:
    def __init__(self, spark: SparkSession, buckets: int, width: int = 13, k: int = 4, fan_in: int = 2):
        self.spark, self.buckets, self.fan_in, self.plan = spark, buckets, fan_in, Plan("words", width, min(k, width))
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(*paths).where("payload IS NOT NULL")

    def _add(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def compact(self) -> None:
        """Merges full levels into the next."""
        for level, full in enumerate(self.levels):
            if len(full) >= self.fan_in:
                path = new_path(self.spark, "fingerprints")
                self._read(full).repartitionById(self.buckets, F.col("bucket")).mapInArrow(folded, RUNS).write.option("compression", "zstd").parquet(path)
                self.levels[level] = []
                self._add(path, level + 1)
                for old in full:
                    removed_path(self.spark, old)

    def add(self, batch: DataFrame, history: DataFrame | None = None, keep: bool = True) -> DataFrame:
        """batch: (id, text), new documents; history: the earlier ones. Returns the batch's marks (id, s, e): words of repeated windows.

        keep=False says that no batch follows, so that the batch's run needn't stay.
        """
        splitters = even_splitters(self.buckets)
        runs = batch.mapInArrow(records(self.plan, splitters), RUNS).withColumn("fresh", F.lit(True))
        if self.runs:
            runs = runs.unionByName(self._read(self.runs).withColumn("fresh", F.lit(False)))
        out = runs.repartitionById(self.buckets, F.col("bucket")).mapInArrow(merge_runs(self.plan), MERGED)
        path = new_path(self.spark, "fingerprints")
        (out if keep else out.where("payload IS NULL")).write.option("compression", "zstd").parquet(path)
        marks = self.spark.read.schema(MERGED).parquet(path).where("payload IS NULL")
        texts = batch if history is None else history.unionByName(batch)
        asked = marks.where("place IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("s", "e", "place")).alias("asked"))
        met = texts.join(asked, "id").select("id", "text", "asked").mapInArrow(asked_segments(self.plan, splitters), RUNS)
        equal = met.repartitionById(self.buckets, F.col("bucket")).mapInArrow(equal_words(self.plan), MERGED)
        found = written(marks.where("place IS NULL").select("id", "s", "e").unionByName(equal.select("id", "s", "e")), "repeats")
        if keep:
            self._add(path, 0)
            self.compact()
        return found


def cut_words(digest: bool):
    """mapInArrow: (id, text, marks) to SCHEMA."""

    def rows(batches):
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                ws = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words.append(len(ws))
                s, e = spans_of(batch.column(2), i)
                if len(s):
                    s, e = s.tolist(), e.tolist()
                    parts = [ws[a:b] for a, b in zip([0, *e], [*s, len(ws)])]
                    ws = [w for p in parts for w in p]
                n_removed.append(n_words[-1] - len(ws))
                text = b" ".join(ws)
                kept.append(hashlib.sha256(text).digest() if digest else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(kept, type=pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    return rows


def substring_dedup(docs: DataFrame, width: int = 13, k: int = 4, batches: int = 3, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): kept holds the words that stay, joined by spaces, or their SHA-256. docs go through the index in `batches` parts, in order of id."""
    spark = docs.sparkSession
    row_batches(spark)
    base, back = unique_rows(docs, id_col, text_col)
    cuts = base.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    index = FingerprintIndex(spark, partitions(base), width, k)  # two runs of a level make one of the next
    marks = None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = base if lo is None else base.where(F.col("id") > lo)
        own = own if hi is None else own.where(F.col("id") <= hi)
        found = index.add(own, None if lo is None else base.where(F.col("id") <= lo), keep=hi is not None)
        marks = found if marks is None else marks.unionByName(found)
    by_doc = marks.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    return restored(base.join(by_doc, "id", "left").select("id", "text", "marks").mapInArrow(cut_words(digest), SCHEMA), back)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select(real_id("id").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))
