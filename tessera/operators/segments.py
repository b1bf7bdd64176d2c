"""A text index in segments (X2, X7, X8), and BM25 that reads no more than can matter.

A batch of documents becomes an immutable segment: postings in blocks of BLOCK, sorted by term, each with its greatest term frequency and
least document length, and the lengths, sorted by id. Documents that come again or go away are named by a tombstone, which hides them in the
segments before it. Segments of a size are merged into one, without the texts. The list of segments and tombstones, with the numbers of live
documents and words, is published as a version (see sources/versions.py), so an index can be opened again, also as it was before.
What a batch costs: its own postings, the lengths in its range of ids, and its share of merges, which grows with the logarithm of the index.
Texts are read once: documents are inverted in batches where their texts are, and what is shuffled, once, into the order it is written in, are
pieces of up to BLOCK postings of a term.

Search bounds scores (MaxScore with block-wise bounds). The rarest terms of a query give a score that its k-th hit has at least. Terms that can't
lift a document over it even together are left for later; of the other terms only the blocks are read whose bound, with those of all other
terms, reaches it. Where hits are few, those that still can reach it are completed with the terms left out; where they are many, postings are
dealt by document, each once, and meet all queries there, so that no hit is shuffled. Results equal those of full scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import retrieval as R
from tessera.operators.graph import checkpointed, stored
from tessera.sources import versions as V

BLOCK, FAN_IN = 128, 4
#: Postings of a query's rarest terms that are scored first, for a bound.
SEED = 20_000
#: Scores are compared after rounding to six digits, so bounds leave that much room.
SLACK = 1e-5
#: Terms that are pushed down to the scan; of more terms all blocks are read and joined.
PUSHED_TERMS = 5_000
#: Hits of essential terms that are completed one by one, and postings that a task meets queries with or writes.
FEW_HITS, POSTINGS = 200_000, 400_000


def _cut(size: int):
    """Where the pieces of terms begin, at most `size` entries long. terms: a number for each entry, equal ones together."""

    def cut(terms):
        import numpy as np

        places = np.arange(len(terms))
        begins = np.append(True, terms[1:] != terms[:-1])
        return np.flatnonzero((places - np.maximum.accumulate(np.where(begins, places, 0))) % size == 0)

    return cut


def _inverted(size: int):
    """mapInArrow: (id, tokens) to what `inverted` gives: the terms of a batch of documents, and a row with the documents' lengths."""
    cut = _cut(size)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = lambda edges, names, *columns: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(columns, names))
        names = ["term", "first", "n", "entries", "docs"]
        for b in batches:
            docs, ids, dl = b.num_rows, b.column("id"), pc.list_value_length(b.column("tokens")).cast(pa.int32())
            if not docs:
                continue
            lengths, nothing = lists(np.array([0, docs]), ["id", "dl"], ids, dl), lists(np.array([0]), ["id", "tf", "dl"], ids[:0], pa.array([], pa.int64()), dl[:0])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, nothing.type), lengths], names)
            words = b.column("tokens").flatten().dictionary_encode()
            if not len(words):
                continue
            keys = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * docs + np.repeat(np.arange(docs), dl.to_numpy())
            keys, tf = np.unique(keys, return_counts=True)
            terms, at = keys // docs, pa.array(keys % docs)
            starts = cut(terms)
            edges = np.append(starts, len(keys))
            found = ids.take(at)
            entries = lists(edges, ["id", "tf", "dl"], found, pa.array(tf.astype(np.int64)), dl.take(at))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(terms[starts])).cast(pa.string()), found.take(pa.array(starts)), pa.array(np.diff(edges)), entries, pa.nulls(len(starts), lengths.type)], names)

    return work


def _blocks(size: int):
    """mapInArrow: (term, entries), sorted by term, to blocks of at most `size` entries."""
    cut = _cut(size)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            term, flat = b.column("term"), b.column("entries").flatten()
            if not len(flat):
                continue
            rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("entries")).to_numpy())
            new = np.append(True, pc.not_equal(term.slice(1), term.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False))
            at = cut(np.cumsum(new)[rows])
            edges = np.append(at, len(flat)).astype(np.int32)
            best, least = np.maximum.reduceat(pc.struct_field(flat, "tf").to_numpy(), at), np.minimum.reduceat(pc.struct_field(flat, "dl").to_numpy(), at)
            yield pa.RecordBatch.from_arrays([term.take(pa.array(rows[at])), pa.array(np.diff(edges).astype(np.int64)), pa.array(best), pa.array(least), pa.ListArray.from_arrays(pa.array(edges), flat)], ["term", "n", "max_tf", "min_dl", "entries"])

    return work


def inverted(docs: DataFrame) -> DataFrame:
    """(term, first, n, entries, docs) of docs (id, text), as a table: pieces of the postings of a batch of documents, and rows with their lengths (docs)."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"term string, first {kind}, n bigint, entries {_entries(kind)}, docs array<struct<id:{kind},dl:int>>"
    return stored(docs.select("id", S.bm25_tokens("text").alias("tokens")).mapInArrow(_inverted(BLOCK), schema))


def merged_blocks(pieces: DataFrame, tasks: int | None = None) -> DataFrame:
    """(term, n, max_tf, min_dl, entries) with at most BLOCK entries each, in the order of terms. pieces: term, first (id), entries.

    Ranges of (term, first) are sorted, and blocks are cut where the rows are, so a frequent term is in no single task. Ranges are sampled first, so
    pieces should be a table, not work to be done twice.
    """
    n = () if tasks is None else (tasks,)
    placed = pieces.select("term", "first", "entries").repartitionByRange(*n, "term", "first").sortWithinPartitions("term", "first")
    kind = pieces.schema["first"].dataType.simpleString()
    return placed.select("term", "entries").mapInArrow(_blocks(BLOCK), f"term string, n bigint, max_tf bigint, min_dl int, entries {_entries(kind)}")


def blocks_of(postings: DataFrame) -> DataFrame:
    """The blocks of postings: id, term, tf, dl."""
    entry = F.struct("id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))
    return merged_blocks(postings.select("term", F.col("id").alias("first"), F.array(entry).alias("entries")))


def _entries(kind: str) -> str:
    return f"array<struct<id:{kind},tf:bigint,dl:int>>"


@dataclass(frozen=True)
class SegmentIndex:
    """A version of the index. segments: name, seq, docs, postings; tombstones: name, seq."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[dict, ...] = ()
    tombstones: tuple[dict, ...] = ()
    live: dict = field(default_factory=lambda: {"docs": 0, "length": 0, "id": "bigint"})

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> SegmentIndex:
        number, content = V.read(spark, path, version)
        return cls(spark, path, number, tuple(content.get("segments", ())), tuple(content.get("tombstones", ())), content.get("live", {"docs": 0, "length": 0, "id": "bigint"}))

    def _next(self) -> int:
        return 1 + max([x["seq"] for x in (*self.segments, *self.tombstones)], default=0)

    def _read(self, segment: dict, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment['name']}/{what}")

    def _dead(self) -> DataFrame | None:
        """(id, before): ids that are hidden in the segments before a number."""
        if not self.tombstones:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{t['name']}").select("id", F.lit(t["seq"]).alias("before")) for t in self.tombstones]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("id").agg(F.max("before").alias("before"))

    def _living(self, rows: DataFrame) -> DataFrame:
        """Without hidden rows. rows: id, seq and more."""
        dead = self._dead()
        if dead is None:
            return rows
        return rows.join(dead.hint("shuffle_hash"), "id", "left").where(F.col("before").isNull() | (F.col("before") <= F.col("seq"))).drop("before")

    def lengths(self) -> DataFrame:
        """(id, dl) of the live documents."""
        return self._living(self._all("lengths")).drop("seq")

    def _all(self, what: str, some: tuple[dict, ...] | None = None) -> DataFrame:
        parts = [self._read(s, what).withColumn("seq", F.lit(s["seq"])) for s in (self.segments if some is None else some)]
        if not parts:
            kind = self.live["id"]
            schema = f"id {kind}, dl int" if what == "lengths" else f"term string, n bigint, max_tf bigint, min_dl int, entries {_entries(kind)}"
            return self.spark.createDataFrame([], schema + ", seq int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _hidden(self, ids: DataFrame, seq: int) -> tuple[dict, dict]:
        """Writes a tombstone; returns it and what it hides as live numbers. Lengths outside the range of ids aren't read."""
        name = V.folder("", "tombstone")[1:]
        ids.select("id").distinct().write.parquet(f"{self.path}/{name}")
        gone = self.spark.read.parquet(f"{self.path}/{name}")
        low, high = gone.agg(F.min("id"), F.max("id")).first()
        if low is None or not self.segments:
            return {"name": name, "seq": seq}, {"docs": 0, "length": 0}
        met = self._living(self._all("lengths").where(F.col("id").between(low, high))).join(gone, "id", "left_semi")
        hit = met.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return {"name": name, "seq": seq}, {"docs": hit.n, "length": hit.length}

    def _published(self, segments, tombstones, live) -> SegmentIndex:
        number = V.publish(self.spark, self.path, {"segments": list(segments), "tombstones": list(tombstones), "live": live}, self.version)
        return SegmentIndex(self.spark, self.path, number, tuple(segments), tuple(tombstones), live)

    def _written(self, blocks: DataFrame, lengths: DataFrame, seq: int) -> dict:
        name = V.folder("", "segment")[1:]
        blocks.write.parquet(f"{self.path}/{name}/blocks")
        lengths.select("id", "dl").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/{name}/lengths")
        n = self.spark.read.parquet(f"{self.path}/{name}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return {"name": name, "seq": seq, "docs": n.n, "length": n.length}

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SegmentIndex:
        """docs replace what the index holds under their ids. Ids must not repeat within docs. Rows without an id are left out."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
        seq = self._next()
        read = inverted(rows)
        total = read.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        segment = self._written(merged_blocks(read.where("term IS NOT NULL"), total // POSTINGS + 1), read.select(F.inline("docs")), seq)
        stone, gone = self._hidden(self._read(segment, "lengths"), seq)
        live = {"docs": self.live["docs"] - gone["docs"] + segment["docs"], "length": self.live["length"] - gone["length"] + segment["length"], "id": rows.schema["id"].dataType.simpleString()}
        stones = (*self.tombstones, stone) if gone["docs"] else self.tombstones
        return self._published((*self.segments, segment), stones, live)._merged()

    def delete(self, ids: DataFrame) -> SegmentIndex:
        """ids: id. Those that the index doesn't hold change nothing."""
        stone, gone = self._hidden(ids, self._next())
        if not gone["docs"]:
            return self
        live = self.live | {"docs": self.live["docs"] - gone["docs"], "length": self.live["length"] - gone["length"]}
        return self._published(self.segments, (*self.tombstones, stone), live)

    def _tier(self, segment: dict) -> int:
        return int(math.log(max(1, segment["docs"]), FAN_IN))

    def _merged(self) -> SegmentIndex:
        """Merges tiers that hold FAN_IN segments or more, until none does. Hidden documents leave with the merge."""
        tiers: dict[int, list[dict]] = {}
        for s in self.segments:
            tiers.setdefault(self._tier(s), []).append(s)
        full = [some for _, some in sorted(tiers.items()) if len(some) >= FAN_IN]
        if not full:
            return self
        some = tuple(full[0])
        # a merged segment stands where its last part stood: later tombstones hide in it, earlier ones have been applied
        postings = self._living(self._all("blocks", some).select("seq", "term", F.inline("entries"))).select("id", "term", "tf", "dl")
        segment = self._written(blocks_of(stored(postings)), self._living(self._all("lengths", some)), max(s["seq"] for s in some))
        rest = [s for s in self.segments if s not in some] + ([segment] if segment["docs"] else [])
        oldest = min((s["seq"] for s in rest), default=0)
        stones = [t for t in self.tombstones if t["seq"] > oldest]
        return self._published(rest, stones, self.live)._merged()

    def stats(self) -> tuple[int, float]:
        return self.live["docs"], self.live["length"] / max(1, self.live["docs"])

    def search(self, queries: DataFrame, limit: int = 10, min_score: float = 0.1) -> DataFrame:
        """queries: query_id, text. (query_id, id, score, rank)."""
        n, avgdl = self.stats()
        wanted = checkpointed(query_terms(queries))
        blocks = self._all("blocks")
        terms = [r.term for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        if len(terms) <= PUSHED_TERMS:
            blocks = blocks.where(F.col("term").isin(terms))
        return pruned(blocks, wanted, n, avgdl, limit, min_score, self._living if self.tombstones else None)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(S.bm25_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _part(tf: Column, dl: Column, avgdl: float) -> Column:
    return F.col("qtf") * F.col("idf") * R.bm25_weight(tf, dl, F.lit(float(avgdl)))


def bounded(blocks: DataFrame, wanted: DataFrame, n: int, avgdl: float, limit: int, living=None) -> tuple[DataFrame, DataFrame]:
    """(terms, bounds). terms: query_id, term, qtf, idf, bound, essential, rest; bounds: query_id, least, left.

    least: what the k-th hit scores at least; bound: what a term adds at most; rest: what all other terms of the query add at most;
    left: what the terms that aren't essential add together at most.
    """
    alive = living or (lambda x: x)
    most = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(R.bm25_weight(F.col("max_tf"), F.col("min_dl"), F.lit(float(avgdl)))).alias("weight"))
    if living is not None:  # hidden documents don't count
        most = most.drop("df").join(alive(blocks.select("seq", "term", F.explode("entries.id").alias("id"))).groupBy("term").agg(F.count("*").alias("df")), "term")
    terms = wanted.join(most, "term").withColumn("idf", R.idf(F.lit(n), F.col("df"))).withColumn("bound", F.col("qtf") * F.col("idf") * F.col("weight"))
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    terms = checkpointed(terms.withColumns({"sum_df": F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(rarest), "total": F.sum("bound").over(Window.partitionBy("query_id"))}))
    seeds = terms.where(f"nth = 1 OR sum_df <= {SEED}").select("query_id", "term", "qtf", "idf")
    rare = blocks.join(R.few(seeds.select("term").distinct()), "term", "left_semi").select("seq", "term", F.inline("entries"))
    first = alive(rare).join(R.few(seeds), "term").groupBy("query_id", "id").agg(F.sum(_part(F.col("tf"), F.col("dl"), avgdl)).alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"))
    least = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("s")).otherwise(0.0).alias("least"))
    up = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    terms = checkpointed(terms.withColumn("essential", F.sum("bound").over(up) >= F.col("least")).withColumn("rest", F.col("total") - F.col("bound")))
    return terms, terms.groupBy("query_id").agg(F.max("least").alias("least"), F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).alias("left"))


def needed(blocks: DataFrame, terms: DataFrame, avgdl: float, late: bool = False) -> DataFrame:
    """The blocks of essential terms that can hold a hit of some query, each once. late: also all blocks of terms that aren't essential to some query."""
    least = F.when(F.col("essential"), (F.col("least") - F.col("rest")) / (F.col("qtf") * F.col("idf"))).otherwise(F.lit(0.0 if late else None))
    asked = R.few(terms.groupBy("term").agg(F.min(least).alias("needs")))
    return blocks.join(asked, "term").where(R.bm25_weight(F.col("max_tf"), F.col("min_dl"), F.lit(float(avgdl))) >= F.col("needs")).drop("needs")


def pruned(blocks: DataFrame, wanted: DataFrame, n: int, avgdl: float, limit: int = 10, min_score: float = 0.1, living=None) -> DataFrame:
    """The best of each query, as full scoring has them: (query_id, id, score, rank).

    blocks: term, n, max_tf, min_dl, entries, seq; wanted: query_id, term, qtf; living: leaves hidden rows (id, seq) out.
    """
    blocks = blocks.join(R.few(wanted.select("term").distinct()), "term", "left_semi")
    terms, bounds = bounded(blocks, wanted, n, avgdl, limit, living)
    hits = terms.agg(F.coalesce(F.sum(F.when(F.col("essential"), F.col("df"))), F.lit(0))).first()[0]
    scored = _completed if hits <= FEW_HITS else _together
    scored = scored(blocks, terms, bounds, avgdl, min_score, living or (lambda x: x)).where(F.col("score") >= min_score)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _completed(blocks: DataFrame, terms: DataFrame, bounds: DataFrame, avgdl: float, min_score: float, alive) -> DataFrame:
    """(query_id, id, score): the few hits of essential terms are sent to the other terms' postings."""
    asked = lambda which: R.few(terms.where(which).select("query_id", "term", "qtf", "idf"))
    part = _part(F.col("tf"), F.col("dl"), avgdl)
    hits = alive(needed(blocks, terms, avgdl).select("seq", "term", F.inline("entries"))).join(asked("essential"), "term")
    partial = hits.groupBy("query_id", "id").agg(F.sum(part).alias("s"))
    reach = F.col("s") + F.col("left")
    candidates = R.few(partial.join(R.few(bounds), "query_id").where((reach >= F.col("least")) & (reach >= min_score - SLACK)).select("query_id", "id", "s"))
    others = asked("NOT essential")
    late = blocks.join(others, "term", "left_semi").select("seq", "term", F.inline("entries")).join(candidates, "id", "left_semi")
    more = alive(late).join(others, "term").join(candidates, ["query_id", "id"], "left_semi").select("query_id", "id", part.alias("s"))
    return candidates.unionByName(more).groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def _together(blocks: DataFrame, terms: DataFrame, bounds: DataFrame, avgdl: float, min_score: float, alive) -> DataFrame:
    """(query_id, id, score): postings are dealt by document, about POSTINGS a task, and meet their queries there; hits are summed where they are made."""
    numbers = R.few(terms.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))
    asked = R.few(terms.join(numbers, "term").select("query_id", "no", "qtf", "idf"))
    total = terms.select("term", "df").distinct().agg(F.sum("df")).first()[0]
    rows = needed(blocks, terms, avgdl, late=True).join(numbers, "term").select("seq", F.col("no").cast("long"), F.inline("entries"))
    dealt = alive(rows.repartition(total // POSTINGS + 1, "id"))
    scored = dealt.join(asked, "no").groupBy("query_id", "id").agg(F.sum(_part(F.col("tf"), F.col("dl"), avgdl)).alias("score"))
    # a document in a block that was left out can't reach the least score
    return scored.join(R.few(bounds.select("query_id", "least")), "query_id").where(F.col("score") >= F.col("least")).drop("least")
