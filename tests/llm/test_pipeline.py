"""The pipeline's rows against plain versions of its stages."""

import random
import re

import brute
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_lines
from test_models_and_mix import waterfill
from test_near_and_bench import classes

import corpus_pipeline as P
from tessera.llm import near_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose with junk, a common line, near copies, copies, contaminated texts, null ids and repeated rows."""
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne", "ra", "so", "ti") for b in ("den", "fal", "gor", "hin", "jas", "kel", "min", "nor", "pas", "rut")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    line = "This line stands in a good many of the documents"
    items = [(i, prose(20)) for i in range(3)]
    texts = [f"{prose(40)}\n{line}\n{prose(30)}" for _ in range(12)] + [prose(r.randrange(5, 90)) for _ in range(30)]
    texts += [f"{prose(20)} {items[i % 3][1]} {prose(10)}" for i in range(5)] + [f"{prose(300)} {items[0][1]} {prose(300)}"]
    base = prose(100)
    texts += [base, base.upper(), base.replace("baden", "bafal"), base + " " + prose(3), None, "", "!!!"]
    junk = ["".join(r.choice("#$%&*@01") for _ in range(80)) for _ in range(25)]
    rows = [(i + 1, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + junk)]
    rows += [(3, prose(25), "en", "s1", 1), (None, prose(25), "en", "s2", 2), (None, prose(26), "en", "s2", 2), rows[5], (900, texts[14], None, None, None)]
    labels = [(i, int(i <= len(texts)), 0) for i in range(1, len(texts + junk) + 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def kept_lines(rows):
    """brute_lines' rule, with the texts. rows: (id, text), which may repeat ids; a null id is the smallest."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.AZ)
    holders = {}
    for i, t in rows:
        for k in map(strip, (t or "").split("\n")):
            holders.setdefault(k, set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(strip(x)) >= 20 and len(holders[strip(x)]) >= 3 and (-(2**63) if i is None else i) < max(holders[strip(x)]))]
        out.append(t if len(stay) == len(lines) else "\n".join(stay))
    return out


def test_run_against_plain_stages(spark, folder):
    path, rows, items = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    scores = {}
    for x in docs.withColumn("score", quality.quality_score(quality.train(docs, labels))).collect():
        scores[x.doc_id, x.text] = x.score
    left = [x for x in rows if scores[x[0], x[1]] >= 0.3]
    assert 25 < len(left) < len(rows) - 10
    texts = kept_lines([(x[0], x[1]) for x in left])
    plain = {x[0]: v for x, v in zip(left, texts)}
    unique = {i: v for i, v in brute_lines([(x[0], x[1]) for x in left if x[0] is not None and sum(y[0] == x[0] for y in left) == 1]).items()}
    assert unique and any(v[1] for v in unique.values()) and plain
    left = [(x[0], t, *x[2:]) for x, t in zip(left, texts)]
    # Rows that repeat id and text are one document; others are numbered by id, as the operator's numbers go.
    order = sorted({(-(2**63) if x[0] is None else x[0], x[1] or "") for x in left})
    of = {k: n for n, k in enumerate(order)}
    group = classes([(n, t) for (_, t), n in of.items()])
    least = {}
    for n, c in group.items():
        least.setdefault(c, []).append(n)
    several = {frozenset(v) for v in least.values() if len(v) > 1}
    got = P.near_duplicates(spark, spark.createDataFrame(left, SCHEMA), path).collect()
    stayed = [of[-(2**63) if x.doc_id is None else x.doc_id, x.text or ""] for x in got]
    assert len(stayed) == len(least) and len(set(stayed)) == len(stayed) and several
    ids = [k[0] for k in order]
    for v in least.values():
        mine = [n for n in stayed if n in v]
        assert len(mine) == 1 and ids[mine[0]] == min(ids[n] for n in v)
    left = [tuple(x) for x in got]
    dirty = brute.contamination([(n, x[1]) for n, x in enumerate(left)], items)
    left = [x for n, x in enumerate(left) if not dirty[n][4]]
    assert sum(v[4] for v in dirty.values()) >= 3
    out = P.run(spark, path).toPandas()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    number = lambda x: -1 if x is None or x != x else int(x)
    assert sorted((number(i), int(n)) for i, n in zip(out.doc_id, out["size"])) == sorted((number(x[0]), count(x[1])) for x in left)
    sizes = {}
    for x in left:
        sizes[x[3]] = sizes.get(x[3], 0) + count(x[1])
    want = waterfill(sizes)
    for s, g in out.groupby("source", dropna=False):
        s = None if isinstance(s, float) else s
        assert set(g.source_size) == {sizes[s]} and g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1
    assert (out.taken <= 2 * out["size"]).all()


def test_run_leaves_little_in_the_shared_store(spark, folder):
    import os

    from tessera.llm.common import shared_dir

    store = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(store))
    assert P.run(spark, folder[0]).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(store)) - before}
    assert {"stage-0", "stage-1", "stage-2", "stage-3"} <= left and not {"lines", "signatures", "texts", "verified", "cells"} & left


def test_every_stage_takes_awkward_rows(spark, folder, awkward):
    path, _, _ = folder
    for name, stage in P.STAGES:
        out = stage(spark, awkward, path)
        if name != "source mixing":
            assert out.columns == P.COLUMNS, name
        rows = out.count()
        assert 0 < rows <= awkward.count(), name
        assert out.where("doc_id IS NULL").count() > 0 or name == "quality classifier", name


def test_representatives_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x"), (5, b, "y"), (3, b + " more", "z"), (5, a, "w"), (None, None, "n"), (None, "", "m"), (None, None, None), (7, a + " extra", "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((tuple(r) for r in near_dedup.representatives(d).collect()), key=str)
    assert got == sorted([(5, a, "w"), (3, b + " more", "z"), (None, None, None)], key=str)
    plain = d.where("lang IN ('x', 'z', 'v')")
    assert {r.lang for r in near_dedup.representatives(plain).collect()} == {"x", "z"}
    assert near_dedup.representatives(plain.where(F.lit(False))).count() == 0


def test_numbers_follow_ids(spark):
    from tessera.llm.common import unique_rows

    d = spark.createDataFrame([(i % 700 if i % 5 else None, f"t{i % 900}") for i in range(2000)], "doc_id long, text string").repartition(5)
    base, back = unique_rows(d)
    pairs = sorted({(r.id, r.real) for r in back.collect()})
    reals = [r for _, r in pairs]
    assert reals == sorted(reals) and len(pairs) == base.count() == d.distinct().count()
