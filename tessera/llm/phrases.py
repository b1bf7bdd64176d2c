"""Phrase collocations from count tries: phrases of two and three words that occur together more often than their parts explain.

1. A task reads its documents as a shard. Words become numbers in the order of their bytes, and every word position becomes a path of up to
   three words (shorter where its piece of text ends). The distinct paths with their counts, as one sorted array of packed numbers, are
   the shard's trie of depth three; a node is a run of the array. It is sent on sorted, as columns, after every TOKENS words, so memory
   doesn't depend on the shard, on a document's length or on a language's share.
2. Prefix ranges of the paths merge the sorted tries. Splitters are paths sampled from a share of the documents, at most MOST_SAMPLES
   of them; they cut every trie where it is made, so the tries are made once and stored once, as shuffle files. A path comes at most once
   from each trie, and a frequent first word is split at its second or third. The merged stream is walked once: a node's count is the sum of its run, and nodes below the least count end there. Only
   the nodes that touch a range's edges are partial; they are the only ones that a sum over ranges changes.
3. What is left are the frequent nodes. A node's parents, found by walking down from its first word, give the left parts; its suffix links, which
   lead from (a, b, c) to (b, c) and on to (c), give the right parts. Both are equi-joins over frequent nodes, which Spark may split.
4. The candidates are range-partitioned by language and rank order; ranks are positions in the ranges, so no language is sorted by one task.

Defined results. Null text is empty and has no words; a null language is `und`, an empty one stays empty. Rows that repeat an id, or an id and a
text, are documents of their own and all count. Ties stand in the byte order of the phrase. Ids are never read. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, row_batches, ship, text_of, written

ship(__name__)

#: Words of a trie, words that are added at a time, rows of an output batch.
TOKENS, STEP, ROWS = 1 << 20, 1 << 16, 1 << 16
PIECE_END, WORD = re.compile(rb"[.,;:!?\n-\r]"), re.compile(rb"[^ \t]+")
BITS = 21
#: Bytes of text a range that are read for splitters, paths a range that are kept of them, and all such paths at most.
SAMPLE_BYTES, SAMPLES, MOST_SAMPLES = 1 << 16, 40, 1_000_000
PATHS = "lang string, w1 string, w2 string, w3 string, n long, bucket int"
NODES = "lang string, w1 string, w2 string, w3 string, f long, best long"
WORDS = ["w1", "w2", "w3"]


class Trie:
    """Count tries of depth three, one a language, over one vocabulary. splitters: sorted (lang, w1, w2, w3) in bytes."""

    def __init__(self, splitters: list[tuple[bytes, ...]] = ()):
        self.splitters = splitters
        self.number: dict[bytes, int] = {b"": 0}
        self.ids: dict[str, array] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Adds a text piece by piece; yields the tries whenever they are full."""
        for piece in PIECE_END.split(text.lower()):  # bytes.lower() changes A-Z alone
            if len(piece) <= STEP:
                if words := piece.split():
                    self._extend(lang, words)
                    self._extend(lang, [b""])
                    if self.size >= TOKENS:
                        yield from self.flushed()
                continue
            words = []
            for m in WORD.finditer(piece):  # a long piece comes in steps; of a full trie the last two words open the next
                words.append(m.group())
                if len(words) >= STEP:
                    self._extend(lang, words)
                    words = []
                    if self.size >= TOKENS:
                        yield from self.flushed(open_lang=lang)
            self._extend(lang, [*words, b""])

    def _extend(self, lang: str, words: list[bytes]) -> None:
        number = self.number
        self.ids.setdefault(lang, array("i")).extend([number.setdefault(w, len(number)) for w in words])
        self.size += len(words)

    def flushed(self, open_lang: str | None = None) -> Iterator[pa.RecordBatch]:
        """The sorted paths with counts; then the trie is empty, but for the last words of a piece that goes on."""
        names = sorted(self.number)
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.fromiter((self.number[w] for w in names), dtype=np.int64, count=len(names))] = np.arange(len(names))
        column = pa.array(names, type=pa.binary()).cast(pa.string())
        rest: list[bytes] = []
        for lang in sorted(self.ids):
            ids = rank[np.frombuffer(self.ids[lang], dtype=np.int32)]
            upto = len(ids)
            if lang == open_lang:
                upto = max(0, len(ids) - 2)
                rest = [names[i] for i in ids[upto:]]
            padded = np.concatenate([ids, [0, 0]])
            a, b, c = padded[:upto], padded[1 : upto + 1], padded[2 : upto + 2]
            a, b, c = (x[a > 0] for x in (a, b, c))
            paths, counts = np.unique(a << 2 * BITS | b << BITS | np.where(b > 0, c, 0), return_counts=True)
            buckets = self._buckets(lang, names, paths)
            for at in range(0, len(paths), ROWS):
                part = paths[at : at + ROWS]
                levels = [column.take(pa.array(x)) for x in (part >> 2 * BITS, part >> BITS & (1 << BITS) - 1, part & (1 << BITS) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), type=pa.string()), *levels, pa.array(counts[at : at + ROWS]), pa.array(buckets[at : at + ROWS])], ["lang", *WORDS, "n", "bucket"])
        self.__init__(self.splitters)
        if open_lang is not None:
            self._extend(open_lang, rest)


    def _buckets(self, lang: str, names: list[bytes], paths: np.ndarray) -> np.ndarray:
        """How many splitters are not above each path."""
        code = lang.encode()
        first, after = bisect_left(self.splitters, (code,)), bisect_left(self.splitters, (code + b"\0",))
        cuts = []
        for _, *words in self.splitters[first:after]:
            cut, known = 0, True
            for w in words:  # a word that the vocabulary lacks cuts before the next one
                at = bisect_left(names, w) if known else 0
                known = known and at < len(names) and names[at] == w
                cut = cut << BITS | at
            cuts.append(np.searchsorted(paths, cut))
        return (first + np.searchsorted(np.array(cuts, dtype=np.int64), np.arange(len(paths)), side="right")).astype(np.int32)


def sampled_paths(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    chance = random.Random(7)
    for batch in shard_tries(batches, []):
        yield batch.take(pa.array([i for i in range(batch.num_rows) if chance.random() < share], type=pa.int64()))


def shard_tries(batches: Iterator[pa.RecordBatch], splitters: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    trie = Trie(splitters)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
            yield from trie.add(lang.as_py(), text.as_py())
    yield from trie.flushed()


class Level:
    """The nodes of one depth while a merged stream passes: the open node waits for more of its rows."""

    def __init__(self, depth: int, least: int):
        self.depth, self.least, self.open, self.first = depth, least, None, True

    def closed(self, key: list, f: int, best: int, edge: bool) -> list[tuple]:
        words = key[1:] + [""] * (3 - self.depth)
        return [(key[0], *words, f, best)] if edge or f >= self.least else []

    def take(self, columns: list[pa.Array], starts: np.ndarray, f: np.ndarray, child: np.ndarray) -> Iterator[tuple]:
        """starts: where this batch's rows begin a node; the rows before the first belong to the open one. Yields nodes that ended."""
        if not len(f):
            return
        head = starts[0] if len(starts) else len(f)
        if head:
            self.open[1] += int(f[:head].sum())
            self.open[2] = max(self.open[2], int(child[:head].max()))
        if not len(starts):
            return
        if self.open is not None:
            yield from self.closed(*self.open, edge=self.first)
            self.first = False
        sums, best = np.add.reduceat(f, starts), np.maximum.reduceat(child, starts)
        done = np.arange(len(starts) - 1)
        wanted = done[(sums[:-1] >= self.least) | ((done == 0) & self.first)]
        keys = [c.take(pa.array(starts[wanted])).to_pylist() for c in columns[: self.depth + 1]]
        for i, *key in zip(wanted, *keys):
            yield from self.closed(list(key), int(sums[i]), int(best[i]), edge=self.first and i == 0)
        self.first = self.first and len(done) == 0
        self.open = [[c[int(starts[-1])].as_py() for c in columns[: self.depth + 1]], int(sums[-1]), int(best[-1])]

    def end(self) -> list[tuple]:
        return self.closed(*self.open, edge=True) if self.open is not None else []


def walked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merges a range of sorted tries: equal paths become one, and every node's count is known when its run ends.

    Paths of three words are whole in a range. Nodes of fewer words that touch its edges, and the counts of languages, are partial.
    """
    levels = [Level(0, 1), Level(1, least), Level(2, least)]
    rest: pa.Table | None = None
    last: list | None = None

    def nodes(table: pa.Table, final: bool) -> Iterator[tuple]:
        nonlocal rest, last
        columns = [table.column(i).combine_chunks() for i in range(4)]
        counts = table.column(4).to_numpy()
        new = np.zeros((4, len(counts)), dtype=bool)
        for i, c in enumerate(columns):
            new[i, 1:] = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        for i in range(1, 4):
            new[i] |= new[i - 1]
        starts = np.flatnonzero(new[3] | (np.arange(len(counts)) == 0))
        f = np.add.reduceat(counts, starts)
        if not final:  # more of the last path may follow
            at = pa.array(starts[-1:])
            rest = pa.table([c.take(at) for c in columns] + [pa.array(f[-1:])], names=table.column_names)
            starts, f = starts[:-1], f[:-1]
        else:
            rest = None
        if not len(starts):
            return
        at = pa.array(starts)
        columns, new = [c.take(at) for c in columns], new[:, starts]
        now = [c[0].as_py() for c in columns]
        differs = False
        for i in range(4):
            differs = differs or last is None or last[i] != now[i]
            new[i, 0] = differs
        last = [c[len(f) - 1].as_py() for c in columns]
        child = np.where((pc.binary_length(columns[3]).to_numpy(zero_copy_only=False) > 0) & (f >= least), f, 0)
        whole = np.flatnonzero(child)
        yield from zip(*[c.take(pa.array(whole)).to_pylist() for c in columns], f[whole].tolist(), [0] * len(whole))
        pair = pc.binary_length(columns[2]).to_numpy(zero_copy_only=False) > 0
        for level in levels[:2]:
            yield from level.take(columns, np.flatnonzero(new[level.depth]), f, np.zeros_like(f))
        kept = [c.filter(pa.array(pair)) for c in columns]
        # a pair's first row may be one that the filter leaves; its start is that row's
        yield from levels[2].take(kept, np.flatnonzero(new[2][pair]), f[pair], child[pair])

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for row in rows:
            some.append(row)
            if len(some) >= ROWS:
                yield as_batch(some)
                some = []
        if some:
            yield as_batch(some)

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from batched(nodes(table if rest is None else pa.concat_tables([rest, table]), False))
    if rest is not None:
        yield from batched(nodes(rest, True))
    yield from batched(row for level in levels for row in level.end())


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    *keys, f, best = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, type=pa.string()) for k in keys] + [pa.array(x, type=pa.int64()) for x in (f, best)], ["lang", *WORDS, "f", "best"])


def frequent_nodes(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, w1, w2, w3, f, best): phrases with f >= least and, without words, the number of words of each language.

    Words beyond a phrase's end are empty; best: the largest count of a phrase with one word more behind, 0 below `least`.
    """
    row_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    ranges = partitions(docs, 8)
    splitters = _splitters(texts, ranges)
    paths = texts.mapInArrow(lambda batches: shard_tries(batches, splitters), PATHS)
    merged = paths.repartitionById(ranges, "bucket").drop("bucket").sortWithinPartitions("lang", *WORDS)
    parts = merged.mapInArrow(lambda batches: walked(batches, least), NODES)
    summed = parts.groupBy("lang", *WORDS).agg(F.sum("f").alias("f"), F.max("best").alias("best"))
    return written(summed.where((F.col("f") >= least) | (F.col("w1") == "")), "nodes")


def _splitters(texts: DataFrame, ranges: int) -> list[tuple[bytes, ...]]:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(1, min(SAMPLES, MOST_SAMPLES // ranges))
    read = min(1.0, SAMPLE_BYTES * ranges / max(1, size))
    share = min(1.0, each * ranges / max(1.0, size * read / 6))  # a word and its blank take about six bytes
    found = texts.sample(read, 11).mapInArrow(lambda batches: sampled_paths(batches, share), PATHS).select("lang", *WORDS)
    sample = sorted({tuple(x.encode() for x in r) for r in found.collect()})
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) with 38 digits: whole for counts below 10**15."""
    whole = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)})")


def collocations(nodes: DataFrame, least: int = 10, inside_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one covers. nodes: a written table of frequent_nodes."""
    one = nodes.where("w1 <> '' AND w2 = ''").select("lang", "w1", "f")
    two = nodes.where("w2 <> '' AND w3 = ''").select("lang", "w1", "w2", "f", "best")
    three = nodes.where("w3 <> ''").select("lang", *WORDS, "f")
    head = one.select("lang", "w1", F.col("f").alias("f1"))
    tail = one.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2"))
    two = two.join(head, ["lang", "w1"]).join(tail, ["lang", "w2"])  # left part by the walk, right part by the suffix link
    before = two.select("lang", "w1", "w2", F.col("f").alias("f12"), "f1")
    link = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"), F.col("f2").alias("f3"))
    three = three.join(before, ["lang", "w1", "w2"]).join(link, ["lang", "w2", "w3"])
    cut = three.withColumns({"s1": _score("f", "f1", "f23"), "s2": _score("f", "f12", "f3")})
    later = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(later, F.col(y)).otherwise(F.col(x))
    triples = cut.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("f").alias("a"), pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
    ahead = nodes.where("w3 <> ''").groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("ahead"))
    inside = F.greatest("best", F.coalesce("ahead", F.lit(0)))
    pairs = two.join(ahead, ["lang", "w1", "w2"], "left").where((inside < least) | (inside * 100 < F.col("f") * inside_percent))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f", "f1", "f2").alias("score"))
    return pairs.unionByName(triples)


def ranked(found: DataFrame, n: int, first: int = 2000) -> DataFrame:
    """The first rows of each language with their rank. n: ranges of the rank order, each sorted by itself."""
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    at = F.monotonically_increasing_id()
    rows = written(found.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", at).withColumn("range", F.shiftright("at", 33)), "ranked")
    ranges = rows.groupBy("lang", "range").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < first)
    out = rows.join(ranges.drop("size"), ["lang", "range"]).withColumn("rank", F.col("at") - F.col("start") + F.col("before") + 1)
    return out.where(F.col("rank") <= first).drop("at", "range", "start", "before")


def phrase_mining(docs: DataFrame, least: int = 10, inside_percent: int = 50, first: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    nodes = frequent_nodes(docs, least, lang_col, text_col)
    totals = nodes.where("w1 = ''").select("lang", F.col("f").alias("n"))
    best = ranked(collocations(nodes, least, inside_percent), partitions(nodes), first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY p ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY p ORDER BY i) AS w3 FROM i),
f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
x AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 p JOIN f1 l ON l.lang = p.lang AND l.w1 = p.w1 JOIN f1 r ON r.lang = p.lang AND r.w1 = p.w2
  LEFT JOIN x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2
  WHERE p.f >= 10 AND (x.f IS NULL OR 100 * x.f < 50 * p.f)
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, l.f, r.f
  FROM f3 p JOIN f1 l ON l.lang = p.lang AND l.w1 = p.w1 JOIN f2 r ON r.lang = p.lang AND r.w1 = p.w2 AND r.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, l.f, r.f
  FROM f3 p JOIN f2 l ON l.lang = p.lang AND l.w1 = p.w1 AND l.w2 = p.w2 JOIN f1 r ON r.lang = p.lang AND r.w1 = p.w3),
k AS (SELECT *, 1000000::HUGEINT * a * a // (l * r) AS score FROM c),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
