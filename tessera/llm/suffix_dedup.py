"""Suffix-array dedup: bytes of strings that start earlier in the corpus go.

The suffix array is sparse: of every window of `width` bytes it holds the suffix at one anchor, the k-gram of the window with the least
hash (the first of equals). Equal windows have equal anchors at equal places, so no repeat is lost. The windows with one anchor form a
segment. The full array of every byte was not taken: at 8 bytes a suffix it moves many times the input.

1. A map task turns its documents into suffixes (the leading k = 24 bytes as three words, document, place). Within a few megabytes
   equal segments are folded to the earliest, by comparing their bytes; a passage in very many documents is thereby sent once a chunk.
   Splitters sampled from the suffixes' leading 8 bytes range-partition them; as a splitter is a whole leading word, suffixes that
   agree on a window never stand on both sides of a boundary, and neighbours across it have nothing to compare.
2. A bucket sorts its suffixes by multikey quicksort, word by word. Suffixes that share their leading bytes with others ask for
   their segments' bytes.
3. These meet in the same ranges. Equal segments are told by their bytes, and the windows of those left are sorted by multikey
   quicksort, eight bytes at a time as far as ties go, read from the text; of windows that agree to the end all but the first are marked.

An anchor that would fill half a bucket, by the sample, is crowded: its segments go window by window to buckets of the windows' own, where
equal windows are folded before they are sent (see repeats.py), and meet by 96 bits of hash.

Defined results. Null text is empty. A null id is smaller than any other. Rows that repeat id and text are one document and have
the same result; rows that repeat an id alone are documents ordered by a hash of their texts. An empty table gives an empty
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
from .common import partitions, real_id, restored, row_batches, ship, unique_rows, written
from .repeats import MARKS, RUN_RECORDS, RUNS, Plan, anchored, asked_windows, bucket_marks, elements, even_splitters, mark_batches, merged_marks, multikey_order, packed, run_batch

ship(__name__)

K, WORDS = 24, 3
#: Documents sampled for splitters, at least, for each hundred buckets, and at most; suffixes of a document; payload of a run.
LEAST_DOCS, DOCS_A_HUNDRED, MOST_DOCS, SUFFIXES, RUN_BYTES = 2000, 200, 20_000, 50, 8 << 20
#: How often a k-gram must be in the sample to be crowded, at least.
LEAST_CROWD = 8
ASKED = "id long, s long, e long, a long, crowded boolean"
SCHEMA = "id long, n_bytes long, removed array<struct<s:long,e:long>>, kept binary"
SPAN = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def spans_of(column, i: int) -> tuple[np.ndarray, np.ndarray]:
    got = column[i]
    if not got.is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = got.values
    return A.merged(x.field(0).to_numpy(zero_copy_only=False), x.field(1).to_numpy(zero_copy_only=False))


def cut_bytes(digest: bool):
    """mapInArrow: (id, text, marks) to SCHEMA; with digest, kept is the SHA-256 of the bytes that stay."""

    def rows(batches):
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            removed, kept = [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                s, e = spans_of(batch.column(2), i)
                if len(s):
                    stays = np.ones(len(text), dtype=bool)
                    for a, b in zip(s.tolist(), e.tolist()):
                        stays[a:b] = False
                    text = text[stays]
                removed.append([{"s": int(a), "e": int(b)} for a, b in zip(s, e)])
                kept.append(hashlib.sha256(text.tobytes()).digest() if digest else text.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), type=pa.int64()), pa.array(removed, type=SPAN), pa.array(kept, type=pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    return rows


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number whose order is theirs; beyond the end there are zeros."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(buf) + 8, dtype=np.uint64)
    for i in range(8):
        out[: len(buf)] |= padded[i : i + len(buf)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def suffixes(plan: Plan, buf: np.ndarray, off: np.ndarray):
    """(words of the suffixes, row, s, n, a, hash of the segment): a is the anchor's and s the first window's place in its row, n the number of windows."""
    codes, _ = elements(plan, buf, off)
    hasher, anchor, row, lo, hi = anchored(plan, codes, off)
    lead = words_at(buf)
    words = [lead[anchor + 8 * i] for i in range(WORDS)]
    segment = hasher.spans(lo, hi + plan.width) if len(lo) else np.zeros(0, dtype=np.uint64)
    return words, row, lo - off[row], hi - lo + 1, anchor - off[row], segment


def same_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of size bytes from x and from y are equal."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    differs = buf[A.ranges(x, size)] != buf[A.ranges(y, size)]
    return np.add.reduceat(differs, np.cumsum(size) - size) == 0


def folded(plan: Plan, buf: np.ndarray, off: np.ndarray, ids: np.ndarray, row, s, n, a, segment) -> np.ndarray:
    """Which segments of a chunk equal an earlier one, by their bytes."""
    order = np.lexsort((s, ids[row], segment))
    new = np.ones(len(order), dtype=bool)
    new[1:] = segment[order][1:] != segment[order][:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    pair = np.flatnonzero(~new)
    x, y = order[pair], head[pair]
    size = n + plan.width - 1
    pair = np.flatnonzero((size[x] == size[y]) & (a[x] - s[x] == a[y] - s[y]))
    x, y = x[pair], y[pair]
    same = same_bytes(buf, off[row[x]] + s[x], off[row[y]] + s[y], size[x])
    out = np.zeros(len(order), dtype=bool)
    out[x[same]] = True
    return out


def is_crowded(words: list[np.ndarray], crowded: np.ndarray) -> np.ndarray:
    """Which suffixes begin with one of the crowded k-grams (rows of words, sorted)."""
    out = np.zeros(len(words[0]), dtype=bool)
    if len(crowded):
        maybe = np.flatnonzero(np.isin(words[0], crowded[:, 0]))
        known = {tuple(x) for x in crowded.tolist()}
        out[maybe] = [tuple(x) in known for x in zip(*(w[maybe].tolist() for w in words))]
    return out


def pieces(kind: str, columns: list[np.ndarray], salt: int, buckets: int):
    """Rows that need no bucket of their own, in pieces dealt to several."""
    first = int(A.mix(np.array([salt % (1 << 64)], dtype=np.uint64))[0] >> np.uint64(8))
    for j, lo in enumerate(range(0, len(columns[0]), 1 << 13)):
        yield (first + j) % buckets, pickle.dumps((kind, *[c[lo : lo + (1 << 13)] for c in columns]), protocol=5)


def suffix_runs(plan: Plan, splitters: np.ndarray, crowded: np.ndarray):
    """mapInArrow: (id, text) to runs of suffixes, sorted and cut at the splitters, with what is known already."""
    buckets = len(splitters) + 1

    def flushed(have, marks, asks, salt):
        for kind, parts in (("marks", marks), ("asks", asks)):
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                if not len(columns[0]):
                    continue
                for r in pieces(kind, list(merged_marks(*columns)) if kind == "marks" else columns, salt, buckets):
                    yield run_batch([r])
        if have:
            columns = [np.concatenate(c) for c in zip(*have)]
            order = multikey_order(columns[:WORDS])
            cuts = np.searchsorted(columns[0][order], splitters, side="left")
            for b, (lo, hi) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(order)).tolist())):
                if lo < hi:
                    yield run_batch([(b, packed([c[order[lo:hi]] for c in columns]))])

    def rows(batches):
        have, marks, asks, count, flushes, first = [], [], [], 0, 0, 0
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), A.text_bytes(batch.column(1))
            first = int(ids[0]) if len(ids) and not first else first
            for lo, hi in A.chunks(offsets):
                buf, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words, row, s, n, a, segment = suffixes(plan, buf, off)
                own = ids[lo:hi]
                hot = is_crowded(words, crowded)
                later = folded(plan, buf, off, own, row, s, n, a, segment)
                marks.append((own[row[later]], s[later], s[later] + n[later] - 1 + plan.width))
                x = hot & ~later
                asks.append((own[row[x]], s[x], s[x] + n[x], a[x]))
                x = ~hot & ~later
                have.append([*[w[x] for w in words], own[row[x]], s[x], n[x], a[x]])
                count += len(row)
                if count >= RUN_RECORDS:
                    yield from flushed(have, marks, asks, first + flushes)
                    have, marks, asks, count, flushes = [], [], [], 0, flushes + 1
        if count:
            yield from flushed(have, marks, asks, first + flushes)

    return rows


def asked_batches(ids, s, e, a, asked: bool, crowded: bool):
    """Rows of ASKED; a is null for marks."""
    for lo in range(0, len(ids), 1 << 17):
        x = slice(lo, lo + (1 << 17))
        n = len(ids[x])
        place = pa.array(a[x], type=pa.int64()) if asked else pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[x], type=pa.int64()), pa.array(s[x], type=pa.int64()), pa.array(e[x], type=pa.int64()), place, pa.array(np.full(n, crowded))], names=["id", "s", "e", "a", "crowded"])


def shared_suffixes(batches):
    """mapInArrow: the runs of a bucket to ASKED: marks, and the segments of suffixes whose leading bytes others share."""
    have = []
    for batch in batches:
        for p in batch.column(1).to_pylist():
            x = pickle.loads(p)
            if isinstance(x, tuple):
                kind, ids, s, e = x[:4]
                yield from asked_batches(ids.astype(np.int64), s, e, x[4] if kind == "asks" else None, kind == "asks", kind == "asks")
            else:
                have.append(x)
    if not have:
        return
    columns = [np.concatenate([h[i] if i < WORDS else h[i].astype(np.int64) for h in have]) for i in range(WORDS + 4)]
    order = multikey_order(columns[:WORDS])
    words, (ids, s, n, a) = [c[order] for c in columns[:WORDS]], (c[order] for c in columns[WORDS:])
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
    x = same[:-1] | same[1:]
    yield from asked_batches(ids[x], s[x], s[x] + n[x], a[x], True, False)


def segment_runs(plan: Plan, splitters: np.ndarray):
    """mapInArrow: (id, text, asked) to runs of segments with their bytes, in the ranges of their anchors' leading words."""

    def flushed(have):
        head, ids, s, n, a, size = (np.concatenate(c) for c in zip(*(h[:6] for h in have)))
        blob = np.concatenate([h[6] for h in have])
        start = np.cumsum(size) - size
        order = np.argsort(head, kind="stable")
        cuts = np.searchsorted(head[order], splitters, side="left")
        for b, (lo, hi) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(order)).tolist())):
            if lo < hi:
                x = order[lo:hi]
                yield run_batch([(b, pickle.dumps([ids[x], s[x], n[x], a[x] - s[x], blob[A.ranges(start[x], size[x])]], protocol=5))])

    def rows(batches):
        have, count = [], 0
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), A.text_bytes(batch.column(1))
            asked = batch.column(2)
            per = np.diff(asked.offsets.to_numpy())
            s, e, a = (asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(len(ids)), per)
            size = e - s + plan.width - 1
            at = offsets[row] + a
            head = np.zeros(len(row), dtype=np.uint64)
            for i in range(8):
                head |= data[at + i].astype(np.uint64) << np.uint64(56 - 8 * i)
            have.append((head, ids[row], s, e - s, a, size, data[A.ranges(offsets[row] + s, size)]))
            count += int(size.sum())
            if count >= RUN_BYTES:
                yield from flushed(have)
                have, count = [], 0
        if count:
            yield from flushed(have)

    return rows


def window_order(blob: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of width bytes from `at` on in the order of their bytes, equals as they came, and which equal the one before them.

    Multikey quicksort by eight bytes at a time: each level reads and sorts only what the levels before left tied.
    """
    lead = words_at(blob)
    order = np.argsort(lead[at], kind="stable")
    first = lead[at[order]]
    ties = np.zeros(len(order) + 1, dtype=bool)
    ties[1:-1] = first[1:] == first[:-1]
    for depth in range(8, width, 8):
        inside = np.flatnonzero(ties[:-1] | ties[1:])
        if not len(inside):
            break
        run = np.cumsum(~ties[:-1][inside])
        values = lead[at[order[inside]] + depth]
        if width - depth < 8:
            values = values >> np.uint64(8 * (8 - width + depth))
        inner = np.lexsort((values, run))
        order[inside] = order[inside][inner]
        values, run = values[inner], run[inner]
        same = np.zeros(len(inside), dtype=bool)
        same[1:] = (values[1:] == values[:-1]) & (run[1:] == run[:-1])
        ties[:-1][inside] = same
    return order, ties[:-1]


def segment_marks(plan: Plan):
    """mapInArrow: the segments of a bucket to marks (id, s, e): later ones of equal segments, and later ones of equal windows of the others."""

    def rows(batches):
        have = [pickle.loads(p) for batch in batches for p in batch.column(1).to_pylist()]
        if not have:
            return
        ids, s, n, place = (np.concatenate([h[i] for h in have]) for i in range(4))
        blob = np.concatenate([h[4] for h in have])
        size = n + plan.width - 1
        start = np.cumsum(size) - size
        order = np.lexsort((s, ids))
        text, known, later = blob.tobytes(), set(), []
        for i, a, b, p in zip(order.tolist(), start[order].tolist(), (start + size)[order].tolist(), place[order].tolist()):
            key = (p, text[a:b])
            if key in known:
                later.append(i)
            known.add(key)
        del known, text
        x = np.array(later, dtype=np.int64)
        if len(x):
            yield from mark_batches(*merged_marks(ids[x], s[x], s[x] + size[x]))
        stays = np.ones(len(ids), dtype=bool)
        stays[x] = False
        x = order[stays[order]]
        window = A.ranges(start[x], n[x])
        owner = np.repeat(x, n[x])
        by, same = window_order(blob, window, plan.width)
        y = by[same]
        at = s[owner[y]] + window[y] - start[owner[y]]
        if len(y):
            yield from mark_batches(*merged_marks(ids[owner[y]], at, at + plan.width))

    return rows


def sampled(plan: Plan, docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters of n ranges of leading words, crowded k-grams) from the suffixes of a sample of documents, chosen by a hash of the id."""
    want = min(MOST_DOCS, max(LEAST_DOCS, DOCS_A_HUNDRED * n // 100))
    share = min(1.0, want / max(1, docs.count()))

    def rows(batches):
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            for lo, hi in A.chunks(offsets):
                words, row, *_ = suffixes(plan, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                size = np.bincount(row, minlength=hi - lo)[row] if len(row) else row
                some = nth % np.maximum(1, size // SUFFIXES) == 0
                yield pa.RecordBatch.from_arrays([pa.array(w[some].view(np.int64)) for w in words], names=[f"w{i}" for i in range(WORDS)])

    some = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit(5), "id"), 2) <= int(share * 2**62)).mapInArrow(rows, ", ".join(f"w{i} long" for i in range(WORDS))).toPandas()
    keys = np.stack([some[f"w{i}"].to_numpy(dtype=np.int64).view(np.uint64) for i in range(WORDS)], axis=1)
    if not len(keys):
        return even_splitters(n), keys
    grams, count = np.unique(keys, axis=0, return_counts=True)
    crowded = grams[count >= max(LEAST_CROWD, len(keys) / (2 * n))]
    lead = np.sort(keys[:, 0])
    return np.unique(lead[(np.arange(1, n) * len(lead)) // n]), crowded


def repeated_bytes(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs: (id, text) with ids that don't repeat. (id, s, e): marked ranges of bytes, which may overlap."""
    n = partitions(docs)
    splitters, crowded = sampled(plan, docs, n)
    buckets = len(splitters) + 1
    runs = docs.mapInArrow(suffix_runs(plan, splitters, crowded), RUNS).repartitionById(buckets, F.col("bucket"))
    found = written(runs.mapInArrow(shared_suffixes, ASKED), "suffixes")
    asked = found.where("a IS NOT NULL").groupBy("id").agg(
        F.collect_list(F.when(~F.col("crowded"), F.struct("s", "e", "a"))).alias("asked"), F.collect_list(F.when(F.col("crowded"), F.struct("s", "e"))).alias("crowded"),
    )
    texts = docs.join(asked, "id")
    plain = texts.where(F.size("asked") > 0).select("id", "text", "asked").mapInArrow(segment_runs(plan, splitters), RUNS)
    out = found.where("a IS NULL").select("id", "s", "e")
    out = out.unionByName(written(plain.repartitionById(buckets, F.col("bucket")).mapInArrow(segment_marks(plan), MARKS), "segments").select("id", "s", "e"))
    if len(crowded):
        single = texts.where(F.size("crowded") > 0).select("id", "text", "crowded").mapInArrow(asked_windows(plan, even_splitters(n)), RUNS)
        out = out.unionByName(written(single.repartitionById(n, F.col("bucket")).mapInArrow(bucket_marks(plan), MARKS), "windows").select("id", "s", "e"))
    return out


def suffix_dedup(docs: DataFrame, width: int = 100, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed spans, kept): kept holds the bytes that stay, or their SHA-256. width: at least 24."""
    if width < K:
        raise ValueError(f"a string has at least {K} bytes")
    row_batches(docs.sparkSession)
    base, back = unique_rows(docs, id_col, text_col)
    marks = repeated_bytes(base, Plan("bytes", width, K))
    by_doc = marks.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    return restored(base.join(by_doc, "id", "left").select("id", "text", "marks").mapInArrow(cut_bytes(digest), SCHEMA), back)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = suffix_dedup(docs, digest=True)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select(real_id("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
