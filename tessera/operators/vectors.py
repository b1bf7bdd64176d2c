"""Near vectors by lists (X11, X19, J19, R1): an inverted file of centroids, probed where a near vector can be, and exact cosines.

Centroids are fitted on a bounded sample (SAMPLE_PER_LIST vectors a list, at most MOST_LISTS lists, by spherical k-means); every vector is in the list
of its nearest centroid. A list with more than LIST_ROWS vectors is split, and so are the queries that meet it, so a share of a third
of all vectors is dealt over tasks; what meets is at most LIST_ROWS times LIST_ROWS vectors at a time, as one matrix product.

Which lists a query probes follows from the angle t of the threshold: if v is in the list of c and within t of the query q, whose nearest centroid is
n, then angle(q, c) <= angle(q, n) + 2 t. With `reach` 2 all such lists are probed and nothing is lost. With less, what noise of a given angle
seldom does is left out: in d dimensions the angle to a centroid changes by about t / sqrt(d), so that reach 1 finds nearly all.

Defined results. Null vectors, those of other lengths than the first sampled one, and zero vectors are near nothing. A vector isn't near itself: equal
ids never meet. Of equal cosines (to nine digits) the smaller id comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import checkpointed
from tessera.shipping import ship

ship(__name__)

LIST_ROWS, MOST_LISTS, SAMPLE_PER_LIST, ROUNDS = 4096, 1024, 16, 8


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centroids_of(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Spherical k-means on the vectors with the least hashes of their ids. vectors: id, vec."""
    n = vectors.count()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    rows = vectors.where("vec IS NOT NULL AND size(vec) > 0").orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE_PER_LIST).select("vec").collect()
    if not rows:
        return np.zeros((0, 0))
    same = [r.vec for r in rows if len(r.vec) == len(rows[0].vec) and None not in r.vec]
    m = np.array(same, dtype=np.float64)
    m = unit(m[np.linalg.norm(m, axis=1) > 0])
    c = m[: max(1, min(lists, len(m)))].copy()
    for _ in range(ROUNDS):
        if not len(m):
            break
        nearest = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, m)
        filled = np.linalg.norm(sums, axis=1) > 0
        c[filled] = unit(sums[filled])
    return c


@dataclass(frozen=True)
class VectorLists:
    """centroids: a row each; rows: list, part, id, vec (unit length); sizes: list, n, parts."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: DataFrame

    @classmethod
    def of(cls, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> VectorLists:
        named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        c = centroids_of(named, lists)
        placed = checkpointed(_probed(named, c, 0.0, 1))
        sizes = placed.groupBy("list").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / LIST_ROWS).cast("int"))
        sizes = checkpointed(sizes)  # at most MOST_LISTS rows
        parted = placed.join(F.broadcast(sizes.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        return cls(c, parted, sizes)

    def near(self, queries: DataFrame, k: int = 5, threshold: float = 0.75, reach: float = 1.0, first: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(from_id, to_id, similarity, rank): the k nearest of each query that reach the threshold; with `first` those with the least ids."""
        named = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        angle = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
        asked = checkpointed(_probed(named, self.centroids, reach * angle + 1e-6, None))
        counts = asked.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("chunks"))
        counts = checkpointed(counts.join(self.sizes, "list"))
        both = F.broadcast(counts.select("list", "chunks", "parts"))
        left = asked.join(both, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "chunk", "id", "vec")
        right = self.rows.join(F.broadcast(counts.select("list", "chunks")), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "part", "chunk", "id", "vec")
        kind = named.schema["id"].dataType.simpleString()
        key = ["list", "part", "chunk"]
        met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meeting(k, threshold, first), f"from_id {kind}, to_id {kind}, similarity double")
        order = ["to_id"] if first else [F.round("similarity", 9).desc(), "to_id"]
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("from_id").orderBy(*order))).where(F.col("rank") <= k)


def _probed(vectors: DataFrame, centroids: np.ndarray, margin: float, most: int | None) -> DataFrame:
    """(list, id, vec) for each list within margin of the nearest one's angle, at most `most` of them; vectors get unit length."""
    kind = vectors.schema["id"].dataType.simpleString()

    def work(frames):
        for f in frames:
            good = [i for i, v in enumerate(f["vec"]) if v is not None and centroids.size and len(v) == centroids.shape[1] and np.isfinite(np.asarray(v, dtype=np.float64)).all() and np.any(v)]
            if not good:
                continue
            m = unit(np.stack([np.asarray(f["vec"].iloc[i], dtype=np.float64) for i in good]))
            angles = np.arccos(np.clip(m @ centroids.T, -1.0, 1.0))
            if most == 1:
                r, c = np.arange(len(m)), np.argmin(angles, axis=1)
            else:
                r, c = np.nonzero(angles <= angles.min(axis=1, keepdims=True) + margin)
            for at in range(0, len(r), LIST_ROWS):
                some = r[at : at + LIST_ROWS]
                yield pd.DataFrame({"list": c[at : at + LIST_ROWS].astype(np.int32), "id": f["id"].iloc[[good[i] for i in some]].to_numpy(), "vec": list(m[some])})

    return vectors.mapInPandas(work, f"list int, id {kind}, vec array<double>")


def _meeting(k: int, threshold: float, first: bool):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, m = right["id"].to_numpy(), np.stack(right["vec"].to_numpy())
            for at in range(0, len(left), 512):
                some = left.iloc[at : at + 512]
                s = np.stack(some["vec"].to_numpy()) @ m.T
                for i, name in enumerate(some["id"]):
                    hit = np.flatnonzero((s[i] >= threshold - 1e-12) & (ids != name))
                    if len(hit) > k:
                        hit = hit[:k] if first else hit[np.lexsort((hit, -np.round(s[i][hit], 9)))[:k]]
                    out += [(name, ids[j], float(s[i][j])) for j in hit]
        return pd.DataFrame(out, columns=["from_id", "to_id", "similarity"])

    return work
