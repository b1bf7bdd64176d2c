"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The automaton holds every run of words of every item. Documents stream through it once: at each word the length of the longest
item run that ends there is tracked; where it reaches the window length, the last `window` words are hit and the items with
that window are noted. Items with fewer words than a window count as one window. Only stretches of a document whose adjacent
words are adjacent words of some item can hold a window; these are found with array operations, and the automaton walks them.

Automata are built on the driver from groups of at most MAX_WORDS item words, and kept as arrays of about 70 bytes a word. A text is read
once and walked against all of them, and nothing is shuffled. What is broadcast has a checked size: beyond PASS_WORDS item words, about
300 MB, the next automata take a further pass over the documents, and the passes' hits are united by row.

Defined results. Null and empty texts have no words and no hits. A null item is an item without words. Items that repeat an id
count once, by id, with the windows of all their rows; a null item_id counts as the id 'null'. An empty benchmark hits nothing;
empty documents give an empty result. Rows that repeat a doc_id stay rows of their own, however large the benchmark is. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import arrays as A
from .common import id_key, real_id, row_batches, ship, text_of

ship(__name__)

#: Words that an automaton holds at most, and that all automata of a pass hold; an item with more is by itself.
MAX_WORDS, PASS_WORDS = 200_000, 4_000_000
ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "id long, n_words long, hits array<struct<s:long,e:long>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    return ITEM_WORD.findall((text or "").encode().translate(bytes(A.LOWERED)))


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window of the given length and of short items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        names = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: i for i, w in enumerate(names)}
        coded = [(item, [self.vocabulary[w] for w in ws]) for item, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, set[str]] = {}
        for item, seq in coded:
            state, matched, short = 0, 0, len(seq) < window
            for c in seq:
                state, matched = self.step(state, matched, c)
                if not short and matched >= window:
                    self.window_items.setdefault(self.cut(state), set()).add(item)
            if short:
                self.short_items.setdefault(state, set()).add(item)
        self.least = min((min(len(s), window) for _, s in coded), default=0)
        joined = np.frombuffer(b"".join(names) or b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) for w in names], dtype=np.int64) if names else np.zeros(0, dtype=np.int64)
        starts = ends - np.array([len(w) for w in names], dtype=np.int64)
        codes = A.word_codes(joined, starts, ends)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.size, self.words = max(1, len(names)), sum(len(s) for _, s in coded)
        self.pairs = np.unique(np.array([a * self.size + b for _, s in coded for a, b in zip(s, s[1:])], dtype=np.int64))
        self._freeze()

    def _freeze(self) -> None:
        """Steps as one sorted array of (state, word), items as lists of numbers by state."""
        steps = sorted((state * self.size + c, to) for state, out in enumerate(self.next) for c, to in out.items())
        self.keys, self.to = array("q", (k for k, _ in steps)), array("i", (t for _, t in steps))
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.item_names = sorted({i for some in (self.window_items, self.short_items) for x in some.values() for i in x})
        number = {n: i for i, n in enumerate(self.item_names)}
        self.window_states = array("i", sorted(self.window_items))
        self.window_starts, self.window_numbers = array("i", [0]), array("i")
        for state in self.window_states:
            self.window_numbers.extend(sorted(number[i] for i in self.window_items[state]))
            self.window_starts.append(len(self.window_numbers))
        del self.next, self.vocabulary, self.window_items

    def go(self, state: int, c: int) -> int | None:
        """The state after one more word; dictionaries while the automaton grows, then the sorted steps."""
        if hasattr(self, "next"):
            return self.next[state].get(c)
        key = state * self.size + c
        i = bisect_left(self.keys, key)
        return self.to[i] if i < len(self.keys) and self.keys[i] == key else None

    def items_at(self, state: int) -> list[str]:
        i = bisect_left(self.window_states, state)
        if i == len(self.window_states) or self.window_states[i] != state:
            return []
        return [self.item_names[n] for n in self.window_numbers[self.window_starts[i] : self.window_starts[i + 1]]]

    def _clone(self, p: int, q: int, c: int) -> int:
        r = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        to = self.go(state, c)
        while to is None and state:
            state = self.link[state]
            matched = self.length[state]
            to = self.go(state, c)
        return (to, matched + 1) if to is not None else (0, 0)

    def cut(self, state: int) -> int:
        """The state of the last `window` words of a state that holds longer runs."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def word_ids(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], -1)

    def walk(self, seq, base: int):
        """(start, end, items) of every window that ends at a word of seq; positions count from base."""
        state, matched = 0, 0
        for i, c in enumerate(seq):
            state, matched = self.step(state, matched, c)
            if matched >= self.window:
                yield base + i + 1 - self.window, base + i + 1, self.items_at(self.cut(state))
            if self.short_items and matched:
                up = state
                while up > 0:
                    if up in self.short_items and self.length[up] <= matched:
                        yield base + i + 1 - self.length[up], base + i + 1, self.short_items[up]
                    up = self.link[up]


def stretches(automaton: Automaton, words: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, starts, ends) of the stretches of words whose neighbours are neighbours in some item; others hold no window."""
    ids = automaton.word_ids(words)
    known = ids >= 0
    joins = np.zeros(len(ids), dtype=bool)  # the word continues a stretch
    both = known[1:] & known[:-1]
    both[word_off[(word_off > 0) & (word_off < len(ids))] - 1] = False
    at = np.flatnonzero(both)
    if len(at) and len(automaton.pairs):
        key = ids[at] * automaton.size + ids[at + 1]
        to = np.minimum(np.searchsorted(automaton.pairs, key), len(automaton.pairs) - 1)
        joins[at[automaton.pairs[to] == key] + 1] = True
    heads = np.flatnonzero(known & ~joins)
    # A stretch ends before the next head or unknown word.
    stops = np.flatnonzero(~joins)
    tails = np.append(stops, len(ids))[np.searchsorted(stops, heads, side="right")]
    long = tails - heads >= automaton.least
    return ids, heads[long], tails[long]


def scan(automata: list[Automaton]):
    """mapInArrow function: (id, text) to SCHEMA."""

    def rows(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column(0), A.text_bytes(batch.column(1))
            n_words, hits, items = [], [], []
            for lo, hi in A.chunks(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                buf = A.LOWERED[data[offsets[lo] : offsets[hi]]]
                starts, ends, word_off = A.words(buf, off, A.ALNUM)
                n_words.append(np.diff(word_off))
                found_hits: list[list] = [[] for _ in range(hi - lo)]
                found_items: list[set] = [set() for _ in range(hi - lo)]
                codes = A.word_codes(buf, starts, ends)
                for automaton in automata:
                    if not (automaton.least and len(starts)):
                        continue
                    numbers, heads, tails = stretches(automaton, codes, word_off)
                    for h, t in zip(heads.tolist(), tails.tolist()):
                        row = int(np.searchsorted(word_off, h, side="right")) - 1
                        for s, e, who in automaton.walk(numbers[h:t].tolist(), h - int(word_off[row])):
                            spans = found_hits[row]
                            if spans and s <= spans[-1][1] and s >= spans[-1][0]:
                                spans[-1][1] = max(e, spans[-1][1])
                            else:
                                spans.append([s, e])
                            found_items[row].update(who)
                hits += found_hits
                items += found_items
            spans = []
            for x in hits:
                s, e = A.merged(np.array([a for a, _ in x], dtype=np.int64), np.array([b for _, b in x], dtype=np.int64)) if x else ((), ())
                spans.append([{"s": int(a), "e": int(b)} for a, b in zip(s, e)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate(n_words) if n_words else np.zeros(0, dtype=np.int64), type=pa.int64()),
                 pa.array(spans, type=pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))],
                names=["id", "n_words", "hits", "items"],
            )

    return rows


def item_groups(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_words: int):
    """Automata of at most max_words words each (an item with more is one by itself). Items come to the driver group by group."""
    group, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_of(text_col).alias("text")).toLocalIterator():
        ws = item_words(r["text"])
        if group and size + len(ws) > max_words:
            yield Automaton(group, window)
            group, size = [], 0
        group.append((r["item"], ws))
        size += len(ws)
    yield Automaton(group, window)


def passes(automata: Iterator[Automaton], pass_words: int) -> Iterator[list[Automaton]]:
    """Lists of automata that hold at most pass_words words together, or one automaton."""
    some, size = [], 0
    for a in automata:
        if some and size + a.words > pass_words:
            yield some
            some, size = [], 0
        some.append(a)
        size += a.words
    yield some


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart whose ids are equal or null; rows that agree in it agree in id and text."""
    text = text_of(text_col)
    return F.struct(id_key(id_col).alias("id"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"))


def united(docs: DataFrame, each: Iterable[list[Automaton]], id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, hits, items, copies) of several passes, a row for each row_key, which is the id here; copies is the number of its rows."""
    texts = docs.select(row_key(id_col, text_col).alias("id"), text_of(text_col).alias("text"))
    schema = SCHEMA.replace("id long", "id struct<id:long,t:long,u:int>", 1)
    parts = [texts.mapInArrow(scan(automata), schema) for automata in each]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = (F.count("*") / len(parts)).cast("int").alias("copies")
    out = out.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), copies)
    start = F.array().cast("array<struct<s:bigint,e:bigint>>")
    touches = lambda acc, x: (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"])
    joined = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))
    return out.withColumn("hits", F.aggregate("hits", start, lambda acc, x: F.when(touches(acc, x), joined(acc, x)).otherwise(F.concat(acc, F.array(x)))))


def with_n_hit(out: DataFrame) -> DataFrame:
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """(id, n_words, hits, items, n_hit): merged spans of hit words [s, e) and the items whose windows occur."""
    row_batches(docs.sparkSession)
    each = passes(item_groups(benchmark, item_col, item_text_col, window, max_words), pass_words)
    first = list(itertools.islice(each, 2))
    if len(first) == 1:
        return with_n_hit(docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(scan(first[0]), SCHEMA))
    out = united(docs, itertools.chain(first, each), id_col, text_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return with_n_hit(out.select(F.col("id.id").alias("id"), "n_words", "hits", "items"))


def flagged(automata: list[Automaton], text_col: str = "text") -> Column:
    """Whether a text is contaminated, as a column: one pass needs no join back to the documents."""

    @F.arrow_udf(BooleanType())
    def flag(text: pa.Array) -> pa.Array:
        out = []
        for b in scan(automata)([pa.RecordBatch.from_arrays([pa.array(np.zeros(len(text), dtype=np.int64)), text], names=["id", "text"])]):
            for n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                hit = sum(h["e"] - h["s"] for h in hits)
                out.append(hit > 0 and 20 * hit >= n)
        return pa.array(out, type=pa.bool_())

    return flag(text_of(text_col))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    row_batches(docs.sparkSession)
    each = passes(item_groups(benchmark, "item_id", "text", window, max_words), pass_words)
    first = list(itertools.islice(each, 2))
    if len(first) == 1:
        return docs.where(~flagged(first[0], text_col))
    found = with_n_hit(united(docs, itertools.chain(first, each), id_col, text_col)).where(is_contaminated()).select(F.col("id").alias("__id"))
    return docs.withColumn("__key", row_key(id_col, text_col)).join(found.hint("shuffle_hash"), F.col("__key") == F.col("__id"), "left_anti").drop("__key")


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        real_id("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
