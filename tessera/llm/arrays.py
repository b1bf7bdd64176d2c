"""Worker-side array code: texts of an Arrow batch as one byte array, words, rolling hashes and window minima with NumPy.

Everything runs over chunks of whole documents of a few megabytes, so a worker's memory doesn't depend on the partition.
"""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def byte_table(word_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: `[^\x20\x09-\x0D]+` and `[0-9a-z\x80-\xFF]+` over UTF-8 bytes.
UNSPACED = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Hasher:
    """Hashes of any interval of a sequence of 64-bit codes, from one running sum: equal intervals have equal hashes."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.up, self.down = powers(self.n)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(codes * self.up[: self.n], dtype=np.uint64, out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, dtype=np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * BASE)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if offsets is not None and n else np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, row after the last) of pieces of at most limit bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets of the rows' words. offsets[0] is 0."""
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hasher(BYTE_CODES[buf]).spans(starts, ends)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of width keys."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + count), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch as one; sorted by start. starts needn't be sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]
