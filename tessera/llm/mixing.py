"""Mixing sources to target weights (native: DataFrame operations only).

Targets: sources share `share` x all words by weight; a target stops at `epochs` x its source's size and the excess is shared
again by weight until none is above. That is min(cap, level x weight) for one level, found from running sums over the sources.

Schedule: slot i of the mix takes the golden-ratio point frac(i x phi), in whole numbers modulo 2^64, which falls into one source's
part of the cumulative targets. A slot is a block of `block` words. Slots are ranked per source, and the k-th slot of a source takes the k-th block of
that source's documents, laid end to end in shuffled order (hash of the id) and read round again when they end. Ranks beyond a
source's target are dropped, and the few that the point set leaves out (its discrepancy is logarithmic) follow at the end, so a
source gives its target exactly. A document's words stand in the slots of its blocks; read in the order of slots, every stretch of
the mix has about the weights. Running sums and ranks are made in two steps, within buckets of about BUCKET rows and over the
buckets' sums, so no source meets in one task.

Defined results. Null texts have size 0. A null source is a source, after all others. Rows that repeat an id are documents of
their own, taken each for itself. Sources without words have target 0. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, id_key, real_id, text_of, written

#: 2^64 over the golden ratio.
PHI = 11400714819323198485
CELLS, BUCKET = 4096, 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes: (source, size) rows. Returns source, source_size, documents, weight, target. One row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumns({"cap": F.col("source_size") * float(epochs), "all": F.sum("source_size").over(Window.partitionBy()) * float(share)})
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if the sources before this one are capped and this and later ones are not; the right one is the first that its source doesn't stop.
    by = by.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return by.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "documents", "weight", "target")


def _running(rows: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """name: the sum of value over the rows before, for rows of the same keys, by bucket and then by order. Two steps, so that a large key isn't one task's."""
    rows = rows.withColumn("__v", value)
    sums = rows.groupBy(*keys, bucket).agg(F.sum("__v").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in [*keys, bucket]], before)
    on = None
    for k in [*keys, bucket]:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    own = F.coalesce(F.sum("__v").over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__own", own)
    return rows.join(sums, on).withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__v", "__own", "__before", *[f"__{k}" for k in [*keys, bucket]])


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, sid, k): slot numbers in order of the mix; the slot takes the k-th block of source sid. targets: sid, target."""
    spark = targets.sparkSession
    bounds = targets.withColumns({"quota": F.ceil(F.round("target") / block).cast("long"), "share": F.col("target") / F.sum("target").over(Window.partitionBy())})
    bounds = bounds.withColumn("hi", F.sum("share").over(Window.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("share")).where("quota > 0")
    total = bounds.agg(F.sum("quota")).first()[0] or 0
    # A source's part spans grid cells; points meet the parts of their cell by an equi-join.
    cells = bounds.select("sid", "lo", "hi", "quota", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    point = (F.col("id").cast("decimal(18,0)") * whole(PHI) % whole(2**64)).cast("double") / 2.0**64
    points = spark.range(total).select(F.col("id").alias("slot"), F.least(point, F.lit(1 - 2.0**-53)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").where("u >= lo AND u < hi").select("slot", "sid", "quota", F.floor(F.col("slot") / BUCKET).alias("part"))
    ranked = _running(dealt, ["sid"], "part", ["slot"], F.lit(1), "k")
    some = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    late = bounds.join(some, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = late.select(F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("k"), "sid").select((F.lit(total) + F.col("k")).alias("slot"), "sid", "k")
    return ranked.where("k < quota").select("slot", "sid", "k").unionByName(late)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, block: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (documents: id, row, size, source, source_size, target, taken, first_slot, slots, pieces; schedule: slot, sid, k; pieces: which part of which document a block is).

    pieces says which words of the document go where, in the order of the mix: (slot, offset, words), a document that is read twice with both readings;
    first_slot is the first slot that holds words of the document, slots the number of those. Null, 0 and empty where none are taken.
    """
    t = text_of(text_col)
    sized = written(docs.select(id_key(id_col).alias("id"), F.xxhash64(id_key(id_col), t).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(t).alias("size")), "sizes")
    targets = source_targets(sized.select("source", "size"), weights, share, epochs)
    targets = written(targets.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "targets")
    slots = schedule(targets.select("sid", "target"), block)
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("documents") / BUCKET))).cast("int").alias("bits")
    named = targets.select(F.col("source").alias("__source"), "sid", "source_size", "target", bits)
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("shuffled", F.xxhash64(F.lit(11), "row"))
    rows = rows.withColumn("bucket", F.expr("shiftrightunsigned(shuffled, 64 - bits)"))
    placed = _running(rows, ["sid"], "bucket", ["shuffled", "row"], F.col("size"), "start")
    # Each pass over the source continues the line of words; blocks of equal length cut it.
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("at") + F.col("size"), F.round("target").cast("long"))).where("at < end")
    pieces = passes.select("sid", "id", "row", "start", "at", "end", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("k"))
    pieces = pieces.withColumn("words", F.least("end", (F.col("k") + 1) * block) - F.greatest("at", F.col("k") * block))
    pieces = pieces.withColumn("offset", F.greatest(F.lit(0), F.col("k") * block - F.col("at")).cast("long")).withColumn("words", F.col("words").cast("long"))
    joined = pieces.join(slots, ["sid", "k"])
    taken = joined.groupBy(F.col("sid").alias("__sid"), F.col("start").alias("__start"), F.col("id").alias("__id")).agg(F.sum("words").cast("long").alias("__taken"), F.min("slot").alias("first_slot"), F.array_sort(F.collect_list(F.struct("slot", "offset", "words"))).alias("__pieces"))
    # Documents with words have places of their own, so (sid, start, id) tells rows apart; those without take nothing.
    out = placed.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("start") == F.col("__start")) & (F.col("id") == F.col("__id")) & (F.col("size") > 0), "left")
    nothing = F.lit(0).cast("long")
    out = out.select("id", "row", "size", "source", "source_size", "target", F.coalesce("__taken", nothing).alias("taken"), "first_slot", F.coalesce(F.size(F.array_distinct(F.transform("__pieces", lambda p: p["slot"]))).cast("long"), nothing).alias("slots"), F.coalesce("__pieces", F.array()).alias("pieces"))
    return out, slots, joined


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, _, _ = mix(docs)
    return out.select(real_id("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "slots", "pieces")
