"""Lists of vectors against all pairs: recall by dimension, nothing lost with the full reach, split lists."""

import numpy as np
import pytest

from tessera.operators import sync as Y
from tessera.operators import vectors as W

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], SCHEMA)


def planted(d, copies=200, noise=0.955, seed=1):
    """Stored vectors, half of them in clusters, and new ones at a cosine of noise to a stored one."""
    r = np.random.default_rng(seed)
    stored = W.unit(np.concatenate([r.normal(size=(400, d)), (r.normal(size=(10, d)).repeat(40, axis=0) + 0.8 * r.normal(size=(400, d)))]))
    base = stored[r.choice(len(stored), copies, replace=False)]
    other = r.normal(size=base.shape)
    other = W.unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    return stored, noise * base + (1 - noise**2) ** 0.5 * other


@pytest.mark.parametrize("d", [8, 16, 64, 768])
def test_recall_of_planted_copies(spark, d):
    stored, new = planted(d)
    want = {1000 + i: int(np.flatnonzero(W.unit(new)[i] @ stored.T >= 0.95)[0]) for i in range(len(new))}
    got = {r.id: r.duplicate_of for r in Y.similar_on_upload(frame(spark, range(1000, 1200), new), frame(spark, range(len(stored)), stored)).collect()}
    assert len(got.keys() & want.keys()) >= 0.95 * len(want) and got.keys() <= want.keys()
    if d <= 16:
        every = {r.id: r.duplicate_of for r in Y.similar_on_upload(frame(spark, range(1000, 1200), new), frame(spark, range(len(stored)), stored), reach=2).collect()}
        assert every == want


def test_full_reach_and_split_lists_equal_all_pairs(spark, monkeypatch):
    """A third of the vectors are near copies of one: their list is split, and its queries too."""
    monkeypatch.setattr(W, "LIST_ROWS", 40)
    r = np.random.default_rng(5)
    m = np.concatenate([r.normal(size=(200, 12)), np.ones((100, 12)) + 0.05 * r.normal(size=(100, 12)), np.ones((5, 12))])
    lists = W.VectorLists.of(frame(spark, range(len(m)), m), lists=8)
    assert lists.sizes.selectExpr("max(parts)").first()[0] > 1
    u, asked = W.unit(m), range(0, 305, 3)
    s = np.round(u @ u.T, 9)
    for k, t in ((5, 0.75), (3, 0.4)):
        want = {(i, j, n) for i in asked for n, j in enumerate(sorted((j for j in range(len(m)) if j != i and s[i, j] >= t), key=lambda j: (-s[i, j], j))[:k], 1)}
        assert {(x.from_id, x.to_id, x["rank"]) for x in lists.near(frame(spark, asked, m[list(asked)]), k, t, reach=2).collect()} == want


def test_odd_vectors(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0])], SCHEMA)
    lists = W.VectorLists.of(stored)
    assert {(x.from_id, x.to_id) for x in lists.near(stored, 5, 0.9).collect()} == {(1, 6), (6, 1)}
    none = spark.createDataFrame([], SCHEMA)
    assert W.VectorLists.of(none).near(stored).count() == 0 and lists.near(none).count() == 0
