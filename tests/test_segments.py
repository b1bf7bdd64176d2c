"""The segmented index against a fresh build, its versions, and published tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import segments as SG
from tessera.sources import versions as V


def texts(r, ids, common=("the", "of", "and")):
    words = [f"w{i}" for i in range(200)]
    return [(i, " ".join(r.choice(common) if r.random() < 0.4 else r.choice(words) for _ in range(r.randrange(0, 40)))) for i in ids]


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in texts(r, range(12))] + [(100, ""), (101, "nothing here matches zzz"), (102, "the of and"), (103, "w1 w1 w1 the")]
    return spark.createDataFrame(rows, "query_id long, text string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Batches with changed, repeated and deleted documents; small tiers, so that segments merge twice over."""
    r = random.Random(9)
    path, docs = str(tmp_path_factory.mktemp("index") / "i"), {}
    index, states = SG.SegmentIndex.open(spark, path), {}
    for n in range(6):
        batch = texts(r, r.sample(range(120), 40)) + ([(500, None), (501, "知识图谱 异步编程 the")] if n == 2 else [])
        docs |= dict(batch)
        index = index.add(spark.createDataFrame(batch, "doc_id long, text string"))
        if n in (1, 4):
            gone = r.sample(sorted(docs), 15) + [9999]
            docs = {i: t for i, t in docs.items() if i not in gone}
            index = index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        states[index.version] = dict(docs)
    return path, docs, states


def test_equal_to_a_fresh_build(spark, built, queries, monkeypatch):
    path, docs, states = built
    monkeypatch.setattr(SG, "SEED", 60)
    index = SG.SegmentIndex.open(spark, path)
    fresh = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    assert len(index.segments) < 6 and index.live["docs"] == len(docs)
    assert {r.id: r.dl for r in index.lengths().collect()} == {r.id: r.dl for r in fresh.select(F.col("doc_id").alias("id"), R.S.bm25_length("text").alias("dl")).collect()}
    for limit, least in ((10, 0.1), (3, 0.1), (1000, 2.0)):
        want = R.scored_batch(R.postings(fresh), R.corpus_stats(fresh), queries, limit, least)
        got = hits(index.search(queries, limit, least))
        assert got == hits(want) and (least > 1 or len({q for q, *_ in got}) > 10)


def test_old_versions_stay_and_writers_meet(spark, built, queries):
    path, _, states = built
    number, docs = sorted(states.items())[1]
    old = SG.SegmentIndex.open(spark, path, number)
    fresh = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    assert hits(old.search(queries)) == hits(R.scored_batch(R.postings(fresh), R.corpus_stats(fresh), queries))
    with pytest.raises(V.Conflict):
        old.delete(spark.createDataFrame([(sorted(docs)[0],)], "id long"))
    with pytest.raises(FileNotFoundError):
        SG.SegmentIndex.open(spark, path, 10**6)


def test_blocks_that_are_not_read(spark, monkeypatch):
    """A frequent term beside a rare one: its blocks can't lift a document over the tenth hit."""
    monkeypatch.setattr(SG, "BLOCK", 16)
    rows = [(i, "the " * (1 + i % 3) + f"x{i} " * 5) for i in range(2000)] + [(5000 + i, "rare the " + "y " * (i % 4)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare the")], "query_id long, text string")
    blocks = SG.blocks_of(R.postings(docs)).withColumn("seq", F.lit(0))
    n, avgdl = R.corpus_stats(docs).select("n", "avgdl").first()
    wanted = SG.query_terms(queries)
    terms, bounds = SG.bounded(blocks, wanted, n, avgdl, 10)
    assert {r.term: r.essential for r in terms.collect()} == {"rare": True, "the": False}
    assert blocks.where("term = 'the'").count() > 100 and SG.needed(blocks, terms, avgdl).count() <= 2
    assert hits(SG.pruned(blocks, wanted, n, avgdl)) == hits(R.scored_batch(R.postings(docs), R.corpus_stats(docs), queries))


def test_empty_index(spark, queries, tmp_path):
    index = SG.SegmentIndex.open(spark, str(tmp_path / "none"))
    assert index.search(queries).count() == 0 and index.lengths().count() == 0
    index = index.add(spark.createDataFrame([], "doc_id long, text string"))
    assert SG.SegmentIndex.open(spark, str(tmp_path / "none")).search(queries).count() == 0
    index = index.add(spark.createDataFrame([(None, "the"), (1, "the w1")], "doc_id long, text string"))
    assert hits(index.search(queries))[0][2] == 1


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert V.read(spark, path) == (0, {})
    folders = [V.folder(path, "t") for _ in range(3)]
    for f in folders:
        spark.range(3).write.parquet(f)
    one = V.publish(spark, path, {"t": folders[0]}, 0)
    two = V.publish(spark, path, {"t": folders[1]}, one)
    with pytest.raises(V.Conflict):
        V.publish(spark, path, {"t": "lost"}, one)
    assert V.numbers(spark, path) == [1, 2] and V.read(spark, path) == (2, {"t": folders[1]}) and V.read(spark, path, 1)[1] == {"t": folders[0]}
    V.removed_before(spark, path, two)
    assert V.numbers(spark, path) == [2] and spark.read.parquet(folders[1]).count() == 3
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if p.is_dir()) == [folders[1].split("/")[-1]]


def test_postings_meet_all_queries_at_their_document(spark, queries, tmp_path, monkeypatch):
    """Changed and deleted documents; every needed block is taken once, however many queries ask for it."""
    r = random.Random(3)
    monkeypatch.setattr(SG, "BLOCK", 4)
    first, again = texts(r, range(60)), texts(r, range(50, 70))
    rows = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    index = SG.SegmentIndex.open(spark, str(tmp_path / "i")).add(rows(first)).add(rows(again)).delete(spark.createDataFrame([(i,) for i in range(0, 60, 7)], "id long"))
    docs = {i: t for i, t in (dict(first) | dict(again)).items() if i >= 60 or i % 7}
    blocks, wanted = index._all("blocks"), SG.query_terms(queries)
    terms, _ = SG.bounded(blocks, wanted, *index.stats(), 10, index._living)
    for late in (False, True):
        taken = SG.needed(blocks, terms, index.stats()[1], late)
        assert taken.columns == blocks.columns and 0 < taken.count() == taken.distinct().count()
    want = hits(R.scored_batch(R.postings(rows(sorted(docs.items()))), R.corpus_stats(rows(sorted(docs.items()))), queries))
    for few in (0, 200_000):
        monkeypatch.setattr(SG, "FEW_HITS", few)
        assert hits(index.search(queries)) == want


def test_documents_are_inverted_where_their_texts_are(spark, monkeypatch):
    """What is shuffled are pieces of a term's postings, not a row each; lengths come from the same reading of the texts."""
    monkeypatch.setattr(SG, "BLOCK", 16)
    r = random.Random(8)
    docs = spark.createDataFrame([*texts(r, range(100)), (100, None), (101, ""), (102, "知识图谱 异步编程 the the"), (103, "the " * 40)], "id long, text string").repartition(2, "id")
    pieces = SG.inverted(docs)
    want = {(x.id, x.term, x.tf, x.dl) for x in R.postings(docs, "id", "text").collect()}
    for some in (pieces, SG.merged_blocks(pieces.where("term IS NOT NULL"), 3), SG.blocks_of(R.postings(docs, "id", "text"))):
        rows = some.where("term IS NOT NULL").collect()
        got = [(e.id, x.term, e.tf, e.dl) for x in rows for e in x.entries]
        assert set(got) == want and len(got) == len(want) and all(len(x.entries) == x.n <= 16 for x in rows)
        assert "max_tf" not in some.columns or all((x.max_tf, x.min_dl) == (max(e.tf for e in x.entries), min(e.dl for e in x.entries)) for x in rows)
    assert pieces.count() < len(want) / 2
    assert sorted(map(tuple, pieces.select(F.inline("docs")).collect())) == sorted(map(tuple, docs.select("id", R.S.bm25_length("text")).collect()))
