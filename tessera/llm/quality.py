"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes some twenty numbers (shares of character classes, repetition, word shapes), computed over the whole text.
Shallow trees are boosted cyclically, one feature after the other, on the bins of that feature; their sum is a lookup table a
feature. Then the pairs of features with the largest gains on the residuals get tables of their own. A score is the sigmoid of
the intercept and the table entries of the text's bins: a few array look-ups a text.

The model is fitted on the driver from at most `max_train` labelled rows (a bound, by a hash of the id); scoring reads every text.

Defined results. Null text counts as empty; empty texts have features (all 0) and a score. Null labels and labels of ids without
a document are not learned from; an id with several labels gives one row for each. Without any labelled row every score is
0.5. A null id is scored too. Rows that repeat an id are scored each for itself. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import arrays as A
from .common import id_key, real_id, row_batches, ship, text_of

ship(__name__)

FEATURES = [
    "log_bytes", "log_words", "upper", "lower", "digit", "punctuation", "symbol", "blank", "newline", "high", "word_length", "long_words", "one_char_words",
    "symbol_words", "upper_words", "same_as_before", "distinct_words", "top_word", "line_words", "sentence_ends", "capital_words", "pair_repeats", "bracket",
]
MAX_TRAIN = 20_000


def _table(chars) -> np.ndarray:
    return A.byte_table([ord(c) for c in chars])


UPPER, LOWER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
PUNCTUATION, SYMBOL, BLANK, NEWLINE, BRACKET = _table(".,;:'\"-?"), _table("!#$%&*+/<=>@\\^_`|~"), _table(" \t\r\x0b\x0c"), _table("\n"), _table("()[]{}")
HIGH = A.byte_table(range(0x80, 0x100))
CLASSES = {"upper": UPPER, "lower": LOWER, "digit": DIGIT, "punctuation": PUNCTUATION, "symbol": SYMBOL, "blank": BLANK, "newline": NEWLINE, "high": HIGH, "bracket": BRACKET}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets]).astype(np.float64)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    per = np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size)}
    for name, table in CLASSES.items():
        out[name] = _sums(table[buf], off) / per
    starts, ends, woff = A.words(buf, off, A.UNSPACED)
    n_words = np.diff(woff).astype(np.float64)
    words = np.maximum(n_words, 1)
    length = (ends - starts).astype(np.int64)
    share = lambda flags: _sums(flags, woff) / words
    out["log_words"] = np.log1p(n_words)
    out["word_length"] = _sums(length, woff) / words
    out["long_words"] = share(length > 12)
    out["one_char_words"] = share(length == 1)
    empty = len(starts) == 0
    last = buf[ends - 1] if not empty else np.zeros(0, dtype=np.uint8)
    first = buf[starts] if not empty else last
    before = buf[np.maximum(ends - 2, 0)] if not empty else last
    out["symbol_words"] = share(SYMBOL[last] | (SYMBOL[before] & (length > 1)))
    small = np.concatenate([[0], np.cumsum(LOWER[buf])])
    big = np.concatenate([[0], np.cumsum(UPPER[buf])])
    out["upper_words"] = share((small[ends] == small[starts]) & (big[ends] - big[starts] > 1)) if not empty else np.zeros(n)
    out["capital_words"] = share(UPPER[first])
    out["sentence_ends"] = share((last == ord(".")) | (last == ord("?")))
    codes = A.word_codes(buf, starts, ends)
    row = A.rows_of(woff)
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    out["same_as_before"] = share(same)

    def spread(values, rows):
        """(distinct values, most of one value) a text."""
        if not len(values):
            return np.zeros(n), np.zeros(n)
        key = A.mix(values + rows.astype(np.uint64) * A.BASE)
        got, at, count = np.unique(key, return_index=True, return_counts=True)
        most = np.zeros(n, dtype=np.int64)
        np.maximum.at(most, rows[at], count)
        return np.bincount(rows[at], minlength=n).astype(np.float64), most.astype(np.float64)

    distinct, most = spread(codes, row)
    out["distinct_words"] = distinct / np.sqrt(words)
    out["top_word"] = most / words
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, dtype=np.int64)
    pairs = codes[pair] * np.uint64(3) ^ codes[pair + 1] if len(pair) else np.zeros(0, dtype=np.uint64)
    kinds, _ = spread(pairs, row[pair] if len(pair) else pair)
    out["pair_repeats"] = 1 - kinds / np.maximum(n_words - 1, 1)
    out["line_words"] = np.log1p(n_words / (out["newline"] * size + 1))
    x = np.column_stack([out[f] for f in FEATURES])
    x[size == 0] = 0
    return x


def feature_rows(batches):
    """mapInArrow: (id, text, y) to (id, x, y)."""
    for batch in batches:
        data, offsets = A.text_bytes(batch.column(1))
        xs = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in A.chunks(offsets)]
        x = np.vstack(xs).astype(np.float32) if xs else np.zeros((0, len(FEATURES)), dtype=np.float32)
        flat = pa.array(x.ravel(), type=pa.float32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), type=pa.int32()), flat), batch.column(2)], names=["id", "x", "y"])


class AdditiveModel:
    """Lookup tables: one a feature over its bins, one a chosen pair over coarser bins."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 60, pairs: int = 6, pair_rounds: int = 30, rate: float = 0.15, leaves: int = 4, l2: float = 2.0):
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.leaves, self.l2 = bins, pair_bins, rounds, pairs, pair_rounds, rate, leaves, l2
        self.intercept, self.edges, self.tables, self.pair_tables = 0.0, [], [], []

    @staticmethod
    def _edges(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, n) / n))

    def _tree(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """A tree of few leaves over ordered bins, grown best split first; the values of the bins."""
        parts = [(0, len(grad))]
        g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
        score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + self.l2)
        while len(parts) < self.leaves:
            best = (1e-9, None, None)
            for i, (a, b) in enumerate(parts):
                if b - a > 1:
                    cut = np.arange(a + 1, b)
                    gain = score(a, cut) + score(cut, b) - score(a, b)
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (gain[j], i, int(cut[j]))
            if best[1] is None:
                break
            a, b = parts.pop(best[1])
            parts += [(a, best[2]), (best[2], b)]
        out = np.zeros(len(grad))
        for a, b in parts:
            out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + self.l2)
        return out

    def _pair_tree(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """A tree of two levels over the cells of two features' bins: a cut of one feature, then a cut of the other in each half, all chosen together."""
        l2 = 5 * self.l2

        def halves(g, h):
            """Gain and place of the best cut of bins with sums g and h; no cut if there is one bin."""
            g, h = g.cumsum(), h.cumsum()
            gain = g[:-1] ** 2 / (h[:-1] + l2) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + l2)
            return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (float(g[-1] ** 2 / (h[-1] + l2)), len(g) + 1)

        best = (-1.0, None)
        for turned in (False, True):
            g, h = (grad.T, hess.T) if turned else (grad, hess)
            for cut in range(1, len(g)):
                low, high = halves(g[:cut].sum(axis=0), h[:cut].sum(axis=0)), halves(g[cut:].sum(axis=0), h[cut:].sum(axis=0))
                if low[0] + high[0] > best[0] + 1e-12:
                    best = (low[0] + high[0], (turned, cut, low[1], high[1]))
        turned, cut, low, high = best[1]
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        out = np.zeros(g.shape)
        for box in ((slice(0, cut), slice(0, low)), (slice(0, cut), slice(low, None)), (slice(cut, None), slice(0, high)), (slice(cut, None), slice(high, None))):
            out[box] = g[box].sum() / (h[box].sum() + l2)
        return out.T if turned else out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, m = x.shape if len(x) else (0, len(FEATURES))
        self.edges = [self._edges(x[:, j], self.bins) if n else np.zeros(0) for j in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not n or y.min() == y.max():
            share = (y.sum() + 1) / (n + 2) if n else 0.5
            self.intercept = float(np.log(share / (1 - share)))
            return self
        b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        share = y.mean()
        self.intercept = float(np.log(share / (1 - share)))
        f = np.full(n, self.intercept)
        prob = lambda: 1 / (1 + np.exp(-f))
        for _ in range(self.rounds):
            for j in range(m):
                p = prob()
                step = self.rate * self._tree(np.bincount(b[j], y - p, len(self.tables[j])), np.bincount(b[j], p * (1 - p), len(self.tables[j])))
                self.tables[j] += step
                f += step[b[j]]
        coarse = [self._edges(x[:, j], self.pair_bins) for j in range(m)]
        cb = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
        k = self.pair_bins
        p = prob()
        gains = []
        for i in range(m):
            for j in range(i):
                cell = cb[i] * k + cb[j]
                g, h = np.bincount(cell, y - p, k * k), np.bincount(cell, p * (1 - p), k * k)
                gains.append((float((g**2 / (h + self.l2)).sum()), i, j))
        chosen = sorted(gains, reverse=True)[: self.n_pairs]
        self.pair_tables = [(i, j, coarse[i], coarse[j], np.zeros((k, k))) for _, i, j in chosen]
        for _ in range(self.pair_rounds):
            for i, j, _, _, table in self.pair_tables:
                p = prob()
                cell = cb[i] * k + cb[j]
                g, h = np.bincount(cell, y - p, k * k), np.bincount(cell, p * (1 - p), k * k)
                step = self.rate * self._pair_tree(g.reshape(k, k), h.reshape(k, k))
                table += step
                f += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            f += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, ei, ej, table in self.pair_tables:
            f += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-f))


def held_out(id_col: str = "id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label_col: str = "quality", label_id: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Learns from labelled rows outside the held-out fifth, at most about max_train of them; so few that they are broadcast to the texts.

    Of several documents with a labelled id the one with the least features counts.
    """
    wanted = labels.select(id_key(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").where(~held_out())
    share = min(1.0, max_train / max(1, wanted.count()))
    some = wanted.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 2) <= int(share * 2**62))
    texts = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "text", "y")
    # one row a label, however often documents repeat its id: what reaches the driver is bounded by the labels taken
    got = texts.mapInArrow(feature_rows, "id long, x array<float>, y int").groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["id", "y", "key"], kind="stable")
    x = np.vstack(got["x"].to_list()).astype(np.float32) if len(got) else np.zeros((0, len(FEATURES)), dtype=np.float32)
    return AdditiveModel().fit(x, got["y"].to_numpy(dtype=np.float64))


def quality_score(model: AdditiveModel, text_col: str = "text") -> Column:
    """The score of a text as a column: features and look-ups, batch by batch, without a shuffle."""

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        data, offsets = A.text_bytes(text)
        parts = [model.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float32)) for lo, hi in A.chunks(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), type=pa.float64())

    return score(text_of(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""
    row_batches(docs.sparkSession)
    model = train(docs, labels, max_train, id_col=id_col, text_col=text_col)
    return docs.select(id_key(id_col).alias("id"), quality_score(model, text_col).alias("score"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels).withColumn("doc_id", real_id("id"))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
