"""How quality filters interact: what each removes in every order, and what others would have removed anyway.

Five conditions make a document fail: few words, few distinct words, many capitals, symbols, or a text that a smaller id has too. A
document's failures are a mask of five bits, and all questions about orders are answered by the counts of masks in a part (a source):
the documents that pass a set of filters are those whose mask has no bit of the set. So the documents are read, and counted by
(part, mask), once; the 120 orders with their 5 steps are read off 32 sums a part.

Duplicates are found by partition refinement. One scan notes each text's length in code points and the hashes of successive blocks
(256 code points, the next 4,096, the rest). Rows are split by length, then by one block hash after the other; after each split the classes
of one row are dropped, and a split deals with numbers only. Then the surviving texts are compared in full: they are grouped by
themselves, so equal means equal bytes. Copies within a task fold before anything is shuffled, and a class's counts are partial sums, so a
group of copies of any size stays in no single task. Which rows of the second scan survived is told by a broadcast bitmap of 16 bits a
class, at most MOST_WORDS words (64 MB); where there are more classes, more texts than needed are compared, with the same result.
Should texts differ in spite of equal hashes, their rows are judged by their texts.

Defined results. Null text is empty; empty texts are copies of each other. A null source and an empty one are one part. A null id is smaller
than any other. Rows that repeat an id are documents of their own, and none of them is the other's copy. A label with a
null id marks nothing; labels that repeat an id count as one, with a mark if any of them has it. Very long texts are read like others, one at a
time. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, text_of, written

FILTERS = "ABCDE"
SPLIT = r"[\x20\x09-\x0D]+"
#: Lengths of the blocks in code points; what follows is the last block.
BLOCKS = (256, 4096)
#: Words of 64 bits that the bitmap of classes has at least and at most.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 23
KEYS = ["len", *(f"h{i}" for i in range(len(BLOCKS) + 1))]


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, symbols: str = "[#$%&*|]") -> Column:
    """Bits 0 to 3: the conditions that a text settles by itself."""
    words = F.array_remove(F.split(text, SPLIT, -1), "")
    n, capitals = F.size(words), F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = [n < min_words, F.size(F.array_distinct(words)) * 100 < n * distinct_percent, capitals.cast("long") * 100 > F.char_length(text).cast("long") * capital_percent, F.rlike(text, F.lit(symbols))]
    return sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))


def block_hash(text: Column) -> Column:
    return F.xxhash64(text)


def class_columns(text: str, hashed=block_hash) -> dict[str, Column]:
    """KEYS: the length, and the hash of each block."""
    out, at = {"len": F.char_length(text)}, 1
    for key, size in zip(KEYS[1:], [*BLOCKS, None]):
        out[key] = hashed(F.substring(text, at, size) if size else F.expr(f"substring({text}, {at})"))
        at += size or 0
    return out


def survivors(rows: DataFrame) -> DataFrame:
    """The distinct KEYS of the classes with several rows. rows: a written table with KEYS. Each round splits what is left by one key more."""
    left = rows.select(*KEYS)
    for i in range(1, len(KEYS)):
        # written, so that the join is free to broadcast it, or to split the rows of a large class over tasks
        several = written(left.groupBy(*KEYS[:i]).count().where("count > 1").drop("count"), f"several-{i}")
        left = written(left.join(several, KEYS[:i], "left_semi"), f"refined-{i}")
    return left.groupBy(*KEYS).count().where("count > 1").drop("count")


def _place(words: int) -> tuple[Column, Column]:
    at = F.xxhash64(*KEYS)
    return F.pmod(F.shiftright(at, 6), F.lit(words)), at.bitwiseAND(F.lit(63)).cast("int")


def likely(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of texts whose KEYS may be among the classes. classes: a written table."""
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (classes.count() // 4).bit_length()))
    word, bit = _place(words)
    bitmap = classes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    kept = texts.withColumns({"word": word, "bit": bit}).join(F.broadcast(bitmap), "word")  # at most `words` rows
    return kept.where(F.getbit("bits", F.col("bit")) == 1).select(*texts.columns)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hashed=block_hash) -> DataFrame:
    """(id, part, mask) of every row of docs."""
    read = docs.select(id_key(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    read = read.withColumns(class_columns("text", hashed))
    rows = written(read.withColumn("mask", failures(F.col("text"))).drop("text"), "masks")
    several = written(survivors(rows), "classes")
    texts = likely(read.drop("part"), several).groupBy(*KEYS, "text").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    compared = texts.groupBy(*KEYS).agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    repeated = written(compared.where("n > 1"), "repeated")
    copy = F.when(F.col("id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    joined = rows.join(repeated.drop("n"), KEYS, "left")
    plain = joined.where("texts IS NULL OR texts = 1").select("id", "part", (F.col("mask") + F.coalesce(copy, F.lit(0))).alias("mask"))
    odd = repeated.where("texts > 1").select(*KEYS)
    if odd.isEmpty():
        return plain
    apart = read.join(odd, KEYS, "left_semi")
    firsts = apart.groupBy("text").agg(F.min("id").alias("first"))
    return plain.unionByName(apart.join(firsts, "text").select("id", "part", (failures(F.col("text")) + copy).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic). masks: id, part, mask; labels: doc_id, quality, toxic."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    some = lambda c, to: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(to)
    return masks.join(marks, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), some("quality", "good"), some("toxic", "toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before as a mask, filter's number): 120 orders of 5 steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), i + 1, before, f))
            before |= 1 << f
    return out


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step. counts: part, mask, n, good, toxic."""
    k = len(FILTERS)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 a part
    total = lambda some, c: F.aggregate(some, F.lit(0).cast("long"), lambda x, m: x + m[c])
    sets, filters = F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.sequence(F.lit(0), F.lit(k - 1))
    passing = lambda c: F.transform(sets, lambda s: total(F.filter("masks", lambda m: m["mask"].bitwiseAND(s) == 0), c))
    bit = lambda f: F.call_function("shiftleft", F.lit(1), f)
    alone = F.transform(filters, lambda f: total(F.filter("masks", lambda m: m["mask"] == bit(f)), "n"))
    # Of the orders, |before|! * (k - 1 - |before|)! have just the filters `before` ahead of a filter.
    ways = F.array(*[F.lit(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) if s != (1 << k) - 1 else 0) for s in range(1 << k)])
    gain = lambda f, s: F.get(ways, s) * (F.get("n", s) - F.get("n", s.bitwiseOR(bit(f))))  # noqa: E731  0 where s has f
    shapley = F.transform(filters, lambda f: F.aggregate(sets, F.lit(0).cast("long"), lambda x, s: x + gain(f, s)))
    step = F.expr("explode(array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {i}, 'before', {x}, 'after', {x | 1 << f}, 'f', {f})" for o, i, x, f in steps()) + "))")
    sums = parts.select("part", passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"), alone.alias("alone"))
    sums = written(sums, "sums")  # else the optimizer would work the sums out anew wherever one is read
    rows = sums.withColumn("shapley", shapley).select("*", step.alias("s")).select("*", "s.*")
    at = lambda c, s: F.get(F.col(c), F.col(s))
    fails = F.get("n", F.lit(0)) - F.get("n", bit(F.col("f")))
    lost = lambda c: at(c, "before") - at(c, "after")
    out = {
        "kept": at("n", "after"), "removed": lost("n"), "redundant": fails - lost("n"), "unique_fails": at("alone", "f"), "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": at("shapley", "f"),
    }
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(n) for n, c in out.items()])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(mask_counts(masked(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT t.part, coalesce(g.good, 0) AS good, coalesce(g.toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM t LEFT JOIN g ON t.doc_id = g.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
o AS (
  SELECT a.l || b.l || c2.l || d.l || e.l AS filter_order, [a.b, b.b, c2.b, d.b, e.b] AS bits
  FROM f a JOIN f b ON a.l <> b.l JOIN f c2 ON c2.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c2.l) JOIN f e ON e.l NOT IN (a.l, b.l, c2.l, d.l)),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(i)),
x AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
    sum(CASE WHEN mask & (s.before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & s.before = 0 AND mask & s.bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & s.before <> 0 AND mask & s.bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = s.bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & s.before = 0 AND mask & s.bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & s.before = 0 AND mask & s.bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM x
"""
