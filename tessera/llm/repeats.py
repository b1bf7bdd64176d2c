"""Repeated windows of a sequence (bytes or words) across a corpus, from a sparse set of its suffixes: the parts that operators share.

A window of `width` elements is repeated if an equal one starts earlier. Sorting every suffix costs many times the corpus, so
only anchors are sorted: in each window the k-gram with the least hash (the first of equals). Equal windows have equal anchors at
equal offsets, so no repeat is lost. The windows that share an anchor form one segment, whose hash tells whole segments apart.

Records of segments go to buckets as sorted runs, one binary row a bucket; of equal segments a map task sends on only the earliest, so
a passage that very many documents hold is no hot key, and the rest are marked at once. Windows that are asked for one by one (of
segments that agree in part) are hashed and meet in buckets of their own hashes in the same way.

Keys are 64 + 32 bits and, for segments, 64 bits more.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import arrays as A
from .common import ship

ship(__name__)

RUN_RECORDS = 400_000
RUNS = "bucket int, payload binary"
MARKS = "id long, s long, e long"


@dataclass(frozen=True)
class Plan:
    """unit: 'bytes' or 'words'; width: elements of a window; k: elements of an anchor."""

    unit: str
    width: int
    k: int


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    low = int(x.min()) if len(x) else 0
    for kind in (np.uint8, np.uint16, np.uint32):
        if low >= 0 and top <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def packed(columns: list[np.ndarray]) -> bytes:
    return pickle.dumps([_narrow(c) if c.dtype == np.int64 else c for c in columns], protocol=5)


def unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    parts = [pickle.loads(p) for p in payloads]
    return [np.concatenate([p[i] if p[i].dtype.kind == "u" and p[i].dtype.itemsize == 8 or i < KEYS else p[i].astype(np.int64) for p in parts]) for i in range(len(parts[0]))]


KEYS = 3  # key (64 bits), tail (32 bits), segment (64 bits) come first; id, s, n follow


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order by the first column, ties by the second and so on: each level sorts only the runs of equals that the one before has left."""
    order = np.argsort(columns[0], kind="stable")
    ties = np.zeros(len(order) + 1, dtype=bool)  # position i is equal to position i - 1
    first = columns[0][order]
    ties[1:-1] = first[1:] == first[:-1]
    for column in columns[1:]:
        inside = ties[:-1] | ties[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        run = np.cumsum(~ties[:-1][at])
        values = column[order[at]]
        inner = np.lexsort((values, run))
        order[at] = order[at][inner]
        values, run = values[inner], run[inner]
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (values[1:] == values[:-1]) & (run[1:] == run[:-1])
        ties[:-1][at] = same
    return order


def elements(plan: Plan, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the elements of all rows and the rows' offsets in them."""
    if plan.unit == "bytes":
        return A.BYTE_CODES[buf], off
    starts, ends, word_off = A.words(buf, off, A.UNSPACED)
    return A.word_codes(buf, starts, ends), word_off


def tails(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """32 bits from single elements of a window, apart from its hash."""
    x = codes[starts] * np.uint64(3) + codes[starts + width // 3] * np.uint64(5) + codes[starts + 2 * width // 3] * np.uint64(7) + codes[starts + width - 1]
    return (A.mix(x) >> np.uint64(32)).astype(np.uint32)


def anchored(plan: Plan, codes: np.ndarray, eoff: np.ndarray):
    """(hasher, anchor, row, first window, last window) of every segment, all places in codes. Windows never cross rows."""
    counts = np.maximum(np.diff(eoff) - plan.width + 1, 0)
    if not counts.any():
        none = np.zeros(0, dtype=np.int64)
        return None, none, none, none, none
    hasher = A.Hasher(codes)
    grams = hasher.windows(plan.k)
    low = np.uint64(0xFFFFFFFF)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = A.window_minima(keyed, plan.width - plan.k + 1)
    at = A.ranges(eoff[:-1], counts)
    anchor = (least[at] & low).astype(np.int64)
    row = A.rows_of(np.concatenate([[0], np.cumsum(counts)]))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    g = np.flatnonzero(new)
    last = np.append(g[1:], len(at)) - 1
    return hasher, anchor[g], row[g], at[g], at[last]


def equals(key, tail, segment, ids, s) -> tuple[np.ndarray, np.ndarray]:
    """The order by (key, tail, segment, id, s), and which agree with the one before them in the first three."""
    order = multikey_order([key, tail, segment, ids, s])
    key, tail, segment = key[order], tail[order], segment[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (tail[1:] == tail[:-1]) & (segment[1:] == segment[:-1])
    return order, same


def runs_of(plan: Plan, splitters: np.ndarray, columns: list[np.ndarray], salt: int):
    """Rows of RUNS: a sorted run a bucket, and the marks that are known already."""
    key, tail, segment, ids, s, n = columns
    order, later = equals(key, tail, segment, ids, s)
    marks, rest = order[later], order[~later]
    if len(marks):  # in pieces, so that no bucket gets them all
        known = merged_marks(ids[marks], s[marks], s[marks] + n[marks] - 1 + plan.width)
        first = int(A.mix(np.array([salt % (1 << 64)], dtype=np.uint64))[0] >> np.uint64(8))
        for j, lo in enumerate(range(0, len(known[0]), 1 << 13)):
            yield (first + j) % (len(splitters) + 1), pickle.dumps(tuple(c[lo : lo + (1 << 13)] for c in known), protocol=5)
    key = key[rest]
    cuts = np.searchsorted(key, splitters, side="left")
    for b, (lo, hi) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(key)).tolist())):
        if lo < hi:
            own = rest[lo:hi]
            yield b, packed([key[lo:hi], tail[own], segment[own], ids[own], s[own], n[own]])


def merged_marks(ids: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of one document that overlap or touch as one."""
    order = np.lexsort((s, ids))
    ids, s, e = ids[order], s[order], e[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[1:] != ids[:-1]
    # Ends never fall within a document: windows of a later start end later, up to the length of segments.
    doc = np.cumsum(new)
    top = np.maximum.accumulate(e + doc * (1 << 40)) - doc * (1 << 40)
    new[1:] |= s[1:] > top[:-1]
    g = np.flatnonzero(new)
    return ids[g], s[g], top[np.append(g[1:], len(ids)) - 1]


def run_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], type=pa.int32()), pa.array([p for _, p in rows], type=pa.binary())], names=["bucket", "payload"])


def mark_batches(ids, s, e):
    for lo in range(0, len(ids), 1 << 17):
        x = slice(lo, lo + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(c[x], type=pa.int64()) for c in (ids, s, e)], names=["id", "s", "e"])


def bucket_marks(plan: Plan):
    """mapInArrow: all runs of a bucket to MARKS: the later ones of equal windows."""

    def rows(batches):
        payloads = []
        for batch in batches:
            for p in batch.column(1).to_pylist():
                x = pickle.loads(p)
                if isinstance(x, tuple):
                    yield from mark_batches(*x)
                else:
                    payloads.append(p)
        if not payloads:
            return
        key, tail, segment, ids, s, n = unpacked(payloads)
        order, later = equals(key, tail, segment, ids, s)
        x = order[later]
        if len(x):
            yield from mark_batches(*merged_marks(ids[x], s[x], s[x] + n[x] - 1 + plan.width))

    return rows


def asked_windows(plan: Plan, splitters: np.ndarray):
    """mapInArrow: (id, text, asked) to runs of single windows."""

    def rows(batches):
        have, count, flushes = [], 0, 0
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), A.text_bytes(batch.column(1))
            asked = batch.column(2)
            per = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            s, e = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.concatenate([[0], np.cumsum(per)])
            for lo, hi in A.chunks(offsets):
                codes, eoff = elements(plan, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                own = slice(at[lo], at[hi])
                row = np.repeat(np.arange(hi - lo), per[lo:hi])
                base = eoff[row]
                starts = A.ranges(base + s[own], e[own] - s[own])
                rows_ = np.repeat(row, e[own] - s[own])
                if not len(starts):
                    continue
                hasher = A.Hasher(codes)
                key = hasher.spans(starts, starts + plan.width)
                have.append([key, tails(codes, starts, plan.width), np.zeros(len(key), dtype=np.uint64), ids[lo:hi][rows_], starts - eoff[rows_], np.ones(len(key), dtype=np.int64)])
                count += len(key)
                if count >= RUN_RECORDS:
                    for r in runs_of(plan, splitters, [np.concatenate(c) for c in zip(*have)], int(ids[0]) + flushes):
                        yield run_batch([r])
                    have, count, flushes = [], 0, flushes + 1
        if count:
            for r in runs_of(plan, splitters, [np.concatenate(c) for c in zip(*have)], int(ids[0]) + flushes):
                yield run_batch([r])

    return rows


def even_splitters(n: int) -> np.ndarray:
    """n ranges of uniform 64-bit keys."""
    return np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
