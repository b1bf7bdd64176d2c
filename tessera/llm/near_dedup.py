"""MinHash near-dedup: BagMinHash signatures, bands, and verification of the multiset overlap.

A text is the multiset of its runs of `shingle` words (lower-cased letters and digits). The similarity of two texts is the weighted Jaccard
of their multisets: the sum of the lesser counts over the sum of the greater ones. BagMinHash: the weights are cut into levels, and
the levels into a hierarchy of dyadic ranges (1, 2, 3 to 4, 5 to 8 and so on). Each (shingle, range) is a Poisson process over
the registers at a rate of the range's width. Its points come in ascending order, stop beyond the largest register of the text, and
fall down the range's binary tree to a level; those at levels within the shingle's count go to their registers, which keep the
least. A count of c thus takes log c processes. Registers of two texts agree with a probability that equals the similarity, so bands
of registers find candidates.

1. Texts with equal multisets form one class from the start; only its smallest id goes on.
2. In each bucket of a band the members are held, by the texts themselves, against the most central one: the text that meets the
   most others in its buckets. Links join classes (see components).
3. Where a bucket still holds several classes, every pair across classes is verified, in blocks of members: those of the central
   text's class meet the others, and the others meet each other too. A pair that shares several buckets is compared in the first
   of them. Left out are only pairs whose class is the same already, by links found before, and pairs whose numbers of shingles rule
   the similarity out.
With 4 registers a band and 20 bands, a pair at similarity 0.8 is a candidate with probability 0.99997, one at 0.9 with 1 - 1e-9.

Defined results. A text of fewer words than a shingle, but not none, is one shingle of all its words. Texts without words (null,
empty, only punctuation) are copies of nothing: each is its own class. A null id is smaller than any other. Rows that repeat an
id and the text are one document; rows that repeat an id alone are documents of their own. The class id is the smallest id in
the class. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import id_key, partitions, real_id, restored, row_batches, ship, text_of, unique_rows, written

ship(__name__)

BANDS, ROWS = 20, 4
SIGNED = "id long, f1 long, f2 long, n long, bands array<long>"
MEMBERS_A_TASK = 256
#: Members and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Links of a chunk that one task joins to trees, about.
CHUNK = 1 << 18


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of every text; buf is lower-cased."""
    starts, ends, woff = A.words(buf, off, A.ALNUM)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64)
    hasher = A.Hasher(A.word_codes(buf, starts, ends))
    n = np.diff(woff)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = A.ranges(woff[:-1], counts)
    row = np.repeat(np.arange(len(n)), counts)
    return row, hasher.spans(at, at + np.minimum(n, size)[row])


def multisets(row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted by row and shingle."""
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
    g = np.flatnonzero(new)
    return row[g], codes[g], np.diff(np.append(g, len(row)))


def bag_minhash(row: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers. Every unit of weight has points at rate 1 a register."""
    registers = np.full(n * m, np.inf)
    ranges = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    nth = np.arange(int(ranges.sum())) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    doc, most = np.repeat(row, ranges), np.repeat(counts, ranges)
    seed = A.mix(np.repeat(codes, ranges) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    depth = np.maximum(nth - 1, 0).astype(np.uint64)  # the range is 1, or above 2**depth up to 2**(depth + 1)
    below = np.where(nth > 0, 1 << depth.astype(np.int64), 0)
    rate = m * np.maximum(below, 1).astype(np.float64)
    point, turn = np.zeros(len(seed)), 0
    while len(seed):
        turn += 1
        draw = A.mix(seed + np.uint64(turn * 0xE7037ED1A0B428DB % 2**64))
        point = point - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = doc * m + ((draw & np.uint64(0x7FF)).astype(np.int64) * m >> 11)
        # The way down the tree: one bit for each level of it. Ranges of one level need no descent.
        hit, deep = np.ones(len(seed), dtype=bool), np.flatnonzero(depth)
        leaf = (A.mix(draw[deep]) >> np.uint64(1) >> (np.uint64(63) - depth[deep])).astype(np.int64)
        hit[deep] = below[deep] + leaf < most[deep]
        np.minimum.at(registers, slot[hit], point[hit])
        top = registers.reshape(n, m).max(axis=1)
        on = point < top[doc]
        seed, point, doc, most, depth, below, rate = (x[on] for x in (seed, point, doc, most, depth, below, rate))
    return registers.reshape(n, m)


def signatures(size: int, bands: int, rows: int):
    """mapInArrow: (id, text) to SIGNED. f1 and f2 tell multisets apart; both are 0 for a text without words. n is the number of shingles. A band holds 16 bits of each of its registers."""
    if not 1 <= rows <= 4:
        raise ValueError("a band has one to four registers")

    def work(batches):
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(1))
            f1s, f2s, ns, bs = [], [], [], []
            for lo, hi in A.chunks(offsets):
                n = hi - lo
                row, codes, counts = multisets(*shingles(A.LOWERED[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], size))
                prints = []
                for salt in (1, 2):
                    total = np.zeros(n + 1, dtype=np.uint64)
                    h = A.mix(codes * np.uint64(2) + np.uint64(salt)) * counts.astype(np.uint64)
                    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h, dtype=np.uint64)])
                    edge = np.searchsorted(row, np.arange(n + 1))
                    total = sums[edge[1:]] - sums[edge[:-1]]
                    prints.append(total.view(np.int64))
                filled = np.bincount(row, minlength=n) > 0
                some = np.flatnonzero(filled)
                renumber = np.cumsum(filled) - 1
                registers = bag_minhash(renumber[row], codes, counts, len(some), bands * rows).view(np.uint64).reshape(len(some), bands, rows)
                keys = np.zeros((len(some), bands), dtype=np.uint64)
                for r in range(rows):
                    keys |= A.mix(registers[:, :, r]) >> np.uint64(48) << np.uint64(16 * r)
                f1s.append(prints[0]), f2s.append(prints[1])
                ns.append(np.bincount(row, weights=counts, minlength=n).astype(np.int64))
                width = np.zeros(n, dtype=np.int64)
                width[some] = bands
                bs.append((width, keys.ravel().view(np.int64)))
            if not f1s:
                continue
            at = np.concatenate([[0], np.cumsum(np.concatenate([w for w, _ in bs]))])
            lists = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(np.concatenate([k for _, k in bs]), type=pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(f1s)), pa.array(np.concatenate(f2s)), pa.array(np.concatenate(ns)), lists], names=["id", "f1", "f2", "n", "bands"])

    return work


def verify(size: int, threshold: float):
    """mapInArrow: (a, salt, b, text), sorted so that a text comes first (b null) and then those held against it, to (a, b) links."""

    def work(batches):
        key, own = None, None
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(3))
            a, salt, b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for lo, hi in A.chunks(offsets):
                row, codes, counts = multisets(*shingles(A.LOWERED[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], size))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    x, c = codes[edge[i] : edge[i + 1]], counts[edge[i] : edge[i + 1]]
                    j = lo + i
                    if b[j] is None:
                        key, own = (a[j], salt[j]), (x.copy(), c.copy(), int(c.sum()))
                    elif key == (a[j], salt[j]) and len(x) and len(own[0]):
                        at = np.minimum(np.searchsorted(own[0], x), len(own[0]) - 1)
                        both = own[0][at] == x
                        common = int(np.minimum(own[1][at[both]], c[both]).sum())
                        if common >= threshold * (own[2] + int(c.sum()) - common) - 1e-9:
                            out.append((a[j], b[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type=pa.int64()), pa.array([x for _, x in out], type=pa.int64())], names=["a", "b"])

    return work


def verified(docs: DataFrame, pairs: DataFrame, size: int, threshold: float, n: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar. A text that many others are held against is dealt to several tasks; texts are shuffled once."""
    shares = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / MEMBERS_A_TASK).cast("int").alias("shares"))
    leaders = shares.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    members = pairs.join(shares, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("salt"), "b")
    # A shuffled join at every size: what is asked for grows with the documents.
    rows = docs.join(leaders.unionByName(members).hint("shuffle_hash"), "id").select("a", "salt", "b", "text")
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(verify(size, threshold), "a long, b long")


def block_links(parts: list, one: bool, band: int, threshold: float) -> list[tuple[int, int]]:
    """Links that join all classes with a similar pair. parts: (id, class, side, bands, shingles, counts) for each text; one: a block against itself, else side 0 against side 1."""
    ids, cls, side = (np.array([p[k] for p in parts], dtype=np.int64) for k in range(3))
    bands = np.stack([p[3] for p in parts])[:, :band]
    width = np.array([len(p[4]) for p in parts])
    start = np.cumsum(width) - width
    counts = np.concatenate([p[5] for p in parts])
    known, codes = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
    total = np.add.reduceat(counts, start)
    mine, out = np.zeros(len(known), dtype=counts.dtype), []
    order = np.arange(len(ids))
    for x in order if one else np.flatnonzero(side == 0):
        # The first bucket that two texts share compares them.
        y = np.flatnonzero((order > x if one else side == 1) & (cls != cls[x]))
        y = y[np.minimum(total[y], total[x]) >= threshold * np.maximum(total[y], total[x]) - 1e-9]
        y = y[~(bands[y] == bands[x]).any(axis=1)]
        if not len(y):
            continue
        own = slice(start[x], start[x] + width[x])
        mine[codes[own]] = counts[own]
        at = A.ranges(start[y], width[y])
        common = np.add.reduceat(np.minimum(mine[codes[at]], counts[at]), np.cumsum(width[y]) - width[y])
        mine[codes[own]] = 0
        for z in y[common >= threshold * (total[x] + total[y] - common) - 1e-9]:
            if cls[z] != cls[x]:
                out.append((int(ids[x]), int(ids[z])))
                cls[cls == cls[z]] = cls[x]
    return out


def verify_blocks(size: int, threshold: float):
    """mapInArrow: (band, h, i, j, side, id, class, bands, text), sorted by the first four, to (a, b) links between blocks i and j of a bucket."""

    def work(batches):
        key, parts, out = None, [], []
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(8))
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            side, ids, cls = (batch.column(k).to_pylist() for k in (4, 5, 6))
            lists = batch.column(7)
            first, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in A.chunks(offsets):
                row, codes, counts = multisets(*shingles(A.LOWERED[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], size))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                for j in range(lo, hi):
                    if keys[j] != key:
                        if parts:
                            out += block_links(parts, key[2] == key[3], key[0], threshold)
                        key, parts = keys[j], []
                    own = slice(edge[j - lo], edge[j - lo + 1])
                    parts.append((ids[j], cls[j], side[j], values[first[j] : first[j + 1]].copy(), codes[own].copy(), counts[own].copy()))
        if parts:
            out += block_links(parts, key[2] == key[3], key[0], threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type=pa.int64()), pa.array([x for _, x in out], type=pa.int64())], names=["a", "b"])

    return work


def verified_blocks(texts: DataFrame, members: DataFrame, bands: DataFrame, size: int, threshold: float, n: int) -> DataFrame:
    """Links across classes in buckets, members (band, h, id, n, class, main), where main is the class of the bucket's central text.

    The bucket's other classes are dealt to blocks 0, 1, ..., and main to blocks -1, -2, ... Each block of the others meets every
    block, itself included, in a group of rows of its own; blocks of main don't meet each other.
    """
    by = F.struct(F.count("*").alias("k"), F.sum("n").alias("n"))
    dealt = lambda x: F.greatest(F.ceil(x["k"] / BLOCK), F.ceil(x["n"] / BLOCK_SHINGLES)).cast("int")
    sides = members.groupBy("band", "h", (F.col("class") == F.col("main")).alias("is_main")).agg(by.alias("x")).withColumn("blocks", dealt(F.col("x")))
    wide = sides.groupBy("band", "h").agg(F.coalesce(F.max(F.when(~F.col("is_main"), F.col("blocks"))), F.lit(0)).alias("others"), F.max(F.when(F.col("is_main"), F.col("blocks"))).alias("mains"))
    # Shuffled joins at every size: what is asked for grows with the documents.
    rows = members.join(wide.where("others > 0").hint("shuffle_hash"), ["band", "h"]).withColumn("main", F.col("class") == F.col("main"))
    own = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    met = F.explode(F.sequence(F.when(F.col("main"), 0).otherwise(-F.col("mains")), F.col("others") - 1))
    rows = rows.withColumn("own", own).select("band", "h", "id", "class", "own", met.alias("other"))
    i, j = F.greatest("own", "other"), F.least("own", "other")
    rows = rows.select("band", "h", i.alias("i"), j.alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), "id", "class")
    rows = bands.join(texts, "id").join(rows.hint("shuffle_hash"), "id").select("band", "h", "i", "j", "side", "id", "class", "bands", "text")
    rows = rows.repartition(n, "band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")
    return rows.mapInArrow(verify_blocks(size, threshold), "a long, b long")


def forest(batches):
    """mapInArrow: (a, b) links of a chunk to (id, class): the smallest id that the chunk's links reach from each of its ids."""
    links = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]) for b in batches]
    if not links:
        return
    ids, ends = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root, last = np.arange(len(ids)), None
    while last is None or (root != last).any():
        last = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, last[a], low)
        np.minimum.at(root, last[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "class"])


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that links reach. links: a written table (a, b); ids without links are left out.

    Tasks join the links of a chunk to trees. Ids that stand in trees of several chunks link those trees' roots, and the
    roots' components are found in the same way. Every tree has two ids and one root, so each turn has at most half as many ids.
    """
    chunks = max(1, -(-links.count() // CHUNK))
    trees = written(links.coalesce(chunks).mapInArrow(forest, "id long, class long"), "trees")
    if chunks == 1:
        return trees
    least = trees.groupBy("id").agg(F.min("class").alias("class"))
    met = trees.withColumnRenamed("class", "b").join(least, "id").where("b <> class").select(F.col("class").alias("a"), "b").distinct()
    met = written(met, "roots")
    if met.isEmpty():
        return least
    above = components(met).select(F.col("id").alias("__id"), F.col("class").alias("__class"))
    return least.join(above, F.col("class") == F.col("__id"), "left").select("id", F.coalesce("__class", "class").alias("class"))


def near_classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs: (id, text) with ids that don't repeat. (id, class) for every row."""
    n = partitions(docs)
    signed = written(docs.mapInArrow(signatures(shingle, bands, rows), SIGNED), "signatures")
    blank = F.size("bands") == 0
    reps = signed.where(~blank).groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    member = written(signed.where(~blank).join(reps, ["f1", "f2"]).select("id", "rep", "n", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    cells = member.where("id = rep").select("id", "n", F.posexplode("bands").alias("band", "h"))
    sizes = cells.groupBy("band", "h").agg(F.count("*").alias("size")).where("size > 1")
    cells = cells.join(sizes, ["band", "h"])
    # How much of the crowd a text meets: texts near the middle of a group share most of its buckets.
    crowd = cells.groupBy("id").agg(F.sum("size").alias("crowd"))
    cells = written(cells.join(crowd, "id"), "cells")
    # Only texts that share a bucket are read again.
    texts = written(docs.join(cells.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "texts")
    heads = cells.groupBy("band", "h").agg(F.max_by("id", F.struct("crowd", -F.col("id"))).alias("head"))
    cells = written(cells.join(heads, ["band", "h"]).select("band", "h", "id", "n", "size", "head"), "cells")
    pairs = cells.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(texts, pairs, shingle, threshold, n), "verified")
    labels = components(links)
    own, main = labels.toDF("id", "class"), labels.toDF("head", "main")
    named = cells.where("size > 2").join(own, "id", "left").join(main, "head", "left").select("band", "h", "id", "n", F.coalesce("class", "id").alias("class"), F.coalesce("main", "head").alias("main"))
    more = written(verified_blocks(texts, named, member.where("id = rep").select("id", "bands"), shingle, threshold, n), "verified")
    if not more.isEmpty():
        labels = components(written(links.unionByName(more), "links"))
    found = member.join(labels.withColumnRenamed("id", "__id"), F.col("rep") == F.col("__id"), "left").select("id", F.coalesce("class", "rep").alias("class"))
    return found.unionByName(signed.where(blank).select("id", F.col("id").alias("class")))


def near_dedup(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class, real_class) for every row of docs; class is the smallest id of the group."""
    row_batches(docs.sparkSession)
    base, back = unique_rows(docs, id_col, text_col)
    out = near_classes(base, shingle, threshold)
    if back is None:
        return out
    names = back.select(F.col("id").alias("class"), F.col("real").alias("real_class")).dropDuplicates(["class"])
    return restored(out.join(names, "class").select("id", F.col("real_class").alias("class")), back)


def representatives(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of every group of near-duplicates the row with the smallest id.

    Rows that repeat an id are told apart by their texts; of rows that repeat both, the least by all columns stays.
    """
    row_batches(docs.sparkSession)
    base, back = unique_rows(docs, id_col, text_col)
    gone = near_classes(base, shingle, threshold).where("id <> class").select(F.col("id").alias("__id"))
    # Shuffled joins at every size: what goes grows with the documents.
    keyed = docs.withColumn("__key", id_key(id_col))
    if back is None:
        return keyed.join(gone.hint("shuffle_hash"), F.col("__key") == F.col("__id"), "left_anti").select(*docs.columns)
    numbers = base.select(F.col("id").alias("__id"), F.xxhash64("text").alias("__t")).join(gone, "__id", "left_anti")
    real = back.select(F.col("id").alias("__id"), F.col("real").alias("__key")).distinct()
    stays = numbers.join(real, "__id").select("__key", "__t")
    rows = keyed.withColumn("__t", F.xxhash64(text_of(text_col))).join(stays.hint("shuffle_hash"), ["__key", "__t"], "left_semi")
    return rows.groupBy("__key", "__t").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(real_id("id").alias("doc_id"), real_id("class").alias("class_id"), (F.col("id") == F.col("class")).alias("kept"))
