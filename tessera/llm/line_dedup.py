"""Line dedup (native: DataFrame operations only).

Every long line becomes a 128-bit hash with its document and position; this table is written once, so the texts are hashed once.
Hashes are range-partitioned and sorted within partitions by hash, document (largest first) and position. A stream over each
partition meets a hash's last document first, numbers its documents, and so knows which occurrences go. The result is not text but,
for each document, a compressed bitmap of the lines it keeps: 64 lines a word, and words that keep all their lines left out.

A hash that fills a good part of a partition would stay in one task. A frequent-items sketch of bounded size finds such hashes
(of a hash that makes more than a fraction 1 / TRACKED of all rows none is missed); they are counted by partial sums instead,
and their at most HOT winners are broadcast to their occurrences. Both ways give the same lines; the sketch only deals them out.

Defined results. Null and empty texts have one empty line. A null id is smaller than any other. Rows that repeat an id count as one
document when documents are counted, and lines stay in all rows with the largest id. Lines are told apart by 128 bits of hash. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, id_key, partitions, real_id, text_of, written

#: Most hashes that the sketch names, and what it tracks for that.
HOT, TRACKED = 1000, 10_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Rows are told apart by id and text: rows that repeat both have the same bitmap."""
    return [id_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("t")]


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, t, h1, h2, pos): every long line."""
    keys = F.transform(lines_of(text_of(text_col)), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos")))
    long = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(977), x["k"]).alias("h2"), x["pos"].alias("pos")))
    return docs.select(*_row_key(id_col, text_col), F.inline(hashed))


def repeated_lines(lines: DataFrame, min_docs: int, n: int) -> DataFrame:
    """(id, t, pos) of the occurrences that go. lines: a written table of occurrences; n: partitions."""
    sketch = lines.agg(F.expr(f"approx_top_k(h1, {HOT}, {TRACKED})").alias("top"), F.greatest(F.lit(1024), F.count("*") / (4 * n)).alias("limit"))
    few = F.broadcast(sketch.select(F.inline("top"), "limit").where("count >= limit").select(F.col("item").alias("h1")))
    gone = ["id", "t", "pos"]
    latest = Window.partitionBy("h1", "h2").orderBy(F.desc("id"))
    whole = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = lines.join(few, "h1", "left_anti").repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("id"), "pos")
    streamed = ranged.withColumns({"last": F.first("id").over(latest), "nth": F.dense_rank().over(latest)}).withColumn("docs", F.max("nth").over(whole))
    cold = streamed.where((F.col("docs") >= min_docs) & (F.col("id") < F.col("last"))).select(*gone)
    crowded = lines.join(few, "h1", "left_semi")
    winners = crowded.groupBy("h1", "h2").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs)
    return cold.unionByName(crowded.join(F.broadcast(winners.select("h1", "h2", "last")), ["h1", "h2"]).where("id < last").select(*gone))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, keeps, n_dropped): rows of docs that lose lines. keeps maps the number of a word of 64 lines to the bits that stay, where not all do."""
    lines = written(occurrences(docs, id_col, text_col, min_chars), "lines")
    gone = repeated_lines(lines, min_docs, partitions(docs)).select("id", "t", (F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = gone.groupBy("id", "t", "word").agg(F.bit_or("bit").alias("bits"))
    keeps = F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))
    return words.groupBy("id", "t").agg(keeps.alias("keeps"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with two more columns: kept_text and line_counts (lines before, lines dropped)."""
    maps = bitmaps.select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("keeps").alias("__keeps"), F.col("n_dropped").alias("__n"))
    key, t = _row_key(id_col, text_col)
    lines = lines_of(text_of(text_col))
    bits = lambda i: F.coalesce(F.try_element_at("__keeps", (i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(lines, lambda x, i: F.getbit(bits(i), i % 64) == 1)
    return (
        docs.withColumns({"__id": key, "__t": t})
        .join(maps, ["__id", "__t"], "left")
        .withColumns({
            "kept_text": F.when(F.col("__n").isNull(), text_of(text_col)).otherwise(F.array_join(kept, "\n")),
            "line_counts": F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped")),
        })
        .drop("__id", "__t", "__keeps", "__n")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, line_dedup(docs))
    return out.select(real_id("doc_id").alias("doc_id"), "line_counts.n_lines", "line_counts.n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
    translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, j: {'i': j, 'line': x})) AS u FROM documents) x),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id < c.last, false) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
