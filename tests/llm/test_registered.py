"""The registered queries over whole tables of the smallest size, against plain versions."""

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_and_mix import plain_cosines, waterfill
from test_near_and_bench import classes

from tessera.llm import licenses, secrets
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def result(spark, name, *columns):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, SF).select("doc_id", *columns).collect()}


def test_op1(spark, rows):
    assert result(spark, "op1_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup([r[:2] for r in rows])


def test_op2(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = result(spark, "op2_decontamination", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination([r[:2] for r in rows], items) and any(v[4] for v in got.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_op5(spark, rows):
    got = QUERIES["op5_source_mixing"](spark, SF).collect()
    sizes, of = {}, {r[0]: r[2] for r in rows}
    for r in got:
        sizes[of[r.doc_id]] = sizes.get(of[r.doc_id], 0) + r["size"]
    want, taken = waterfill(sizes), {}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"] and (r.first_slot is None) == (r.taken == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_op6(spark, rows):
    assert result(spark, "op6_substring_dedup", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup([r[:2] for r in rows])


def test_op8(spark):
    """Every pattern tried on every text of the second size (the smallest has no findings), and each finding scored by itself."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.start, r.length, r.rule): r.score for r in QUERIES["op8_secret_scan"](spark, sf).collect()}
    words = secrets.dictionary(docs)
    forest, describe, want = secrets.fit_forest(words=words), secrets.Describer(words), {}
    for i, text, source in docs.select("doc_id", "text", "source").collect():
        b, taken = (text or "").encode(), set()
        for rule, pattern in secrets.COMPILED:
            for m in pattern.finditer(b):
                s, e = m.span(1) if pattern.groups else m.span()
                if not taken & set(range(s, e)):
                    taken |= set(range(s, e))
                    part = lambda x: x.decode(errors="replace")
                    x = describe(rule, part(b[s:e]), part(b[max(0, s - secrets.SPAN - 8) : s]), part(b[e : e + secrets.SPAN + 8]), f"{source}/{i}")
                    want[i, s, e - s, rule] = float(forest.score(np.array([x]))[0])
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)


def test_op9(spark, rows):
    got = result(spark, "op9_near_dedup", "class_id", "kept")
    want = classes([r[:2] for r in rows])
    assert got == {i: (c, i == c) for i, c in want.items()} and len(set(want.values())) < len(want)


def test_op10(spark, rows):
    got = result(spark, "op10_license_scan", "license", "similarity", "origin")
    texts = spark.createDataFrame([(i, t or "", "") for i, t, _ in rows], "id long, text string, path string")
    v = licenses.Vocabulary()
    v.weigh(*licenses.document_frequencies(texts, v))
    for i, t, _ in rows[::4]:
        assert got[i][1] == pytest.approx(min(plain_cosines(v, t or "")[0], 1), abs=2e-6)
    assert len(got) == len(rows) and all((v[0] is not None) == (v[2] != "none") for v in got.values()) and any(v[0] for v in got.values())
    assert QUERIES["op10_license_scan"](spark, SF).where(F.col("is_license_file")).count() == 0


def test_op12(spark):
    """Every page against the standard library's parser: these pages name their article."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op12_html_text"](spark, SF).collect()}
    want = {r.page_id: (r.url, brute.article(r.html)) for r in rows}
    assert got == {i: (u, t, len(t)) for i, (u, t) in want.items()} and len(got) == len(rows) and all(t for _, t, _ in got.values())
