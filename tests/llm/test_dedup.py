"""Exact, line, suffix and substring dedup against brute force, and on awkward tables."""

import hashlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, suffix_dedup, substring_dedup
from tessera.llm.common import BLANKS, real_id
from tessera.llm.repeats import multikey_order


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_exact(docs, corpus):
    out = by_id(exact_dedup.exact_dedup(docs).select("id", "keep_id", "group_size", "kept", "digest"))
    norm = {r[0]: (r[1] or "").translate(brute.AZ) for r in corpus}
    last, count = {}, Counter(norm.values())
    for i, t in norm.items():
        last[t] = max(last.get(t, 0), i)
    assert out == {i: (last[t], count[t], i == last[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_exact_index_keeps_smallest_over_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, "smallest", fan_in=2)
    own = exact_dedup.normalised(docs).select("id", "digest")
    index.flush(own.where("id % 2 = 0"))
    index.flush(own.where("id % 2 = 1"))
    assert len(index.runs) == 1
    got = {r.digest: (r.keep_id, r.rows) for r in index.entries().collect()}
    want = {r.digest: (r.i, r.n) for r in own.groupBy("digest").agg(F.min("id").alias("i"), F.count("*").alias("n")).collect()}
    assert got == want


def test_exact_index_levels_and_filters(spark):
    """Runs wait in levels; the filters let every digest of a run through, and few others."""
    digest = lambda lo, hi: spark.range(lo, hi).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    index = exact_dedup.DigestIndex(spark, "smallest", fan_in=3)
    shapes = []
    for i in range(5):
        index.flush(digest(i * 40, i * 40 + 60))  # a third is in the run before too
        shapes.append([len(x) for x in index.levels])
    assert shapes == [[1], [2], [0, 1], [1, 1], [2, 1]]
    got = {(r.digest, r.keep_id, r.rows) for r in index.lookup(digest(30, 100).unionByName(digest(500, 600))).collect()}
    spread = lambda i: sum(k * 40 <= i < k * 40 + 60 for k in range(5))
    assert got == {(brute.sha(str(i).encode()), i, spread(i)) for i in range(30, 100)}
    bitmap = exact_dedup.filter_of(digest(0, 200))
    assert exact_dedup.maybe_in(digest(0, 200), bitmap).count() == 200
    assert exact_dedup.maybe_in(digest(200, 5000), bitmap).count() < 10
    index.compact()
    assert len(index.runs) == 1 and index.entries().count() == 220


def test_exact_index_opens_again(spark, tmp_path, monkeypatch):
    """Another session's index goes on where the last finished flush was; a broken one leaves nothing, and merged runs can be deleted."""
    digest = lambda lo, hi: spark.range(lo, hi).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    path, rows = str(tmp_path / "index"), lambda index: sorted((r.keep_id, r.rows) for r in index.entries().collect())
    opened = lambda: exact_dedup.DigestIndex(spark, "smallest", path, fan_in=2)
    assert opened().runs == []
    opened().flush(digest(0, 20))
    opened().flush(digest(10, 30))
    assert [len(x) for x in opened().levels] == [0, 1]
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            opened().flush(digest(500, 600))
    late, first = opened(), opened()
    first.flush(digest(25, 35))
    with pytest.raises(exact_dedup.versions.Conflict):
        late.flush(digest(900, 910))
    index = opened()
    assert rows(index) == [(i, 1 + (10 <= i < 20) + (25 <= i < 30)) for i in range(35)]
    index.compact()
    index.removed()
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 1 and rows(opened()) == rows(index)
    got = by_id(exact_dedup.exact_dedup(spark.createDataFrame([(99, "7"), (98, "77")], "doc_id long, text string"), "smallest", index=opened()).select("id", "keep_id", "group_size"))
    assert got == {99: (7, 2), 98: (98, 1)}
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "largest", path)


def test_exact_against_an_earlier_batch(spark):
    """Copies of a document of an earlier batch are found; those that only share its digest are told apart by bytes."""
    clash = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    schema = "doc_id long, text string"
    old = spark.createDataFrame([(i, f"text {i}") for i in range(10)], schema)
    new = spark.createDataFrame([(100 + i, f"TEXT {i}") for i in range(5, 20)], schema)
    index = exact_dedup.DigestIndex(spark, "smallest")
    index.flush(exact_dedup.normalised(old).select("id", "digest"))
    got = by_id(exact_dedup.exact_dedup(new, "smallest", index=index, history=old).select("id", "keep_id", "group_size", "kept"))
    assert got == {100 + i: (i if i < 10 else 100 + i, 2 if i < 10 else 1, i >= 10) for i in range(5, 20)}
    index = exact_dedup.DigestIndex(spark, "smallest")
    index.flush(exact_dedup.normalised(old, digest=clash).select("id", "digest"))
    assert by_id(exact_dedup.exact_dedup(new, "smallest", index=index, history=old, digest=clash).select("id", "keep_id", "group_size", "kept")) == got
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(new, "largest", index=index)


def test_exact_large_group_and_forced_clashes(spark):
    """A group of more rows than a task should take is salted, and bytes decide where digests clash."""
    rows = [(i, "the same text" if i % 3 else f"own {i % 50}") for i in range(6000)]
    last, count = {}, Counter(t for _, t in rows)
    for i, t in rows:
        last[t] = max(last.get(t, 0), i)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1)):
        got = by_id(exact_dedup.exact_dedup(d, digest=digest).select("id", "keep_id", "group_size", "kept"))
        assert got == {i: (last[t], count[t], i == last[t]) for i, t in rows}


def brute_lines(rows):
    key = lambda x: x.strip(BLANKS).translate(brute.AZ)
    docs_of, last = Counter(), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            docs_of[k] += 1
            last[k] = max(last.get(k, -1), i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and docs_of[key(x)] >= 3 and i < last[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), brute.sha("\n".join(kept).encode()))
    return out


def test_lines(docs, corpus):
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs))
    got = by_id(out.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2("kept_text", 256)))
    want = brute_lines([r[:2] for r in corpus])
    assert got == want and sum(v[1] for v in want.values()) > 4


def test_lines_beyond_one_word_of_the_bitmap(spark):
    common = "this very line is in all of the documents"
    rows = [(i, "\n".join([f"own line {i} number {j}" if j % 50 else common for j in range(200)])) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(line_dedup.apply_bitmaps(d, line_dedup.line_dedup(d)).select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2("kept_text", 256)))
    assert got == brute_lines(rows) and got[0][1] == 4


def test_lines_of_repeated_ids_and_hot_hashes(spark, monkeypatch):
    """Rows of one id are one document when documents are counted; the sketch's way and the sorted stream's agree."""
    line, other = "a line of more than twenty characters", "another line of more than twenty characters"
    rows = [(1, line), (1, line), (2, line), (3, other), (4, other + "\n" + other), (5, other), (5, other + "\nx")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.apply_bitmaps(d, line_dedup.line_dedup(d)).select("doc_id", "kept_text").collect())
    assert got == [(1, line), (1, line), (2, line), (3, ""), (4, ""), (5, other), (5, other + "\nx")]
    rows = [(i, "\n".join([line, f"own line of document number {i}", other if i % 2 else line])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    crowded = by_id(line_dedup.apply_bitmaps(d, line_dedup.line_dedup(d)).select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2("kept_text", 256)))
    monkeypatch.setattr(line_dedup, "HOT", 1)
    one = by_id(line_dedup.apply_bitmaps(d, line_dedup.line_dedup(d)).select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2("kept_text", 256)))
    assert crowded == one == brute_lines(rows)


def test_suffixes(docs, corpus):
    out = suffix_dedup.suffix_dedup(docs, digest=True)
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    got = by_id(out.select("id", "n_bytes", n, F.size("removed"), F.lower(F.hex("kept"))))
    want = brute.suffix_dedup([r[:2] for r in corpus])
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_suffixes_keep_bytes(docs, corpus):
    kept = {r.id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(docs).collect()}
    want = brute.suffix_dedup([r[:2] for r in corpus])
    assert {i: brute.sha(k) for i, k in kept.items()} == {i: v[3] for i, v in want.items()}


def test_suffixes_of_crowded_anchors_and_small_runs(spark, docs, corpus, monkeypatch):
    """The way of crowded anchors, runs of a few records and chunks of a few texts give the same bytes."""
    import numpy as np

    want = brute.suffix_dedup([r[:2] for r in corpus])
    plain = suffix_dedup.sampled

    def crowding(plan, d, n):
        splitters, _ = plain(plan, d, n)
        grams = []
        for r in corpus:
            t = np.frombuffer((r[1] or "").encode(), dtype=np.uint8)
            words, *_ = suffix_dedup.suffixes(plan, t, np.array([0, len(t)]))
            grams += list(zip(*(w.tolist() for w in words)))
        some = sorted({g for g in grams if grams.count(g) > 2})
        assert some
        return splitters, np.array(some, dtype=np.uint64)

    monkeypatch.setattr(suffix_dedup, "sampled", crowding)
    monkeypatch.setattr(suffix_dedup, "RUN_RECORDS", 50)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 500)
    kept = {r.id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert {i: brute.sha(k) for i, k in kept.items()} == {i: v[3] for i, v in want.items()}


def test_suffixes_of_long_periodic_and_very_long_texts(spark):
    """Texts beyond the chunk size, runs of one byte, and repeats that cross each other."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    long = " ".join(word() for _ in range(500_000))
    rows = [(1, long), (2, long[1_000_000:1_400_000] + "x" + long[10:700]), (3, "a" * 5000), (4, "ab" * 700 + "a" * 150), (5, "é" * 300), (6, "x" + "é" * 80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 2_200_000
    got = by_id(suffix_dedup.suffix_dedup(d, digest=True).select("id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]), F.size("removed"), F.lower(F.hex("kept"))))
    small = brute.suffix_dedup([(i, t) for i, t in rows if i > 2])
    assert {i: v for i, v in got.items() if i > 2} == small
    assert got[1][1] == 0 and got[2][0] == 400_691 and got[2][1] == 400_690 and got[2][2] == 2


def test_windows_in_order_of_their_bytes():
    import numpy as np

    rng = np.random.default_rng(0)
    blob = rng.integers(97, 99, 3000).astype(np.uint8)
    at, b = np.arange(2900), blob.tobytes()
    for width in (24, 30, 32, 37, 100):
        order, same = suffix_dedup.window_order(blob, at, width)
        want = sorted(at.tolist(), key=lambda i: (b[i : i + width], i))
        assert at[order].tolist() == want
        assert same.tolist() == [False] + [b[x : x + width] == b[y : y + width] for x, y in zip(want, want[1:])]


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substrings(docs, corpus, batches):
    out = substring_dedup.substring_dedup(docs, batches=batches, digest=True)
    got = by_id(out.select("id", "n_words", "n_removed", F.lower(F.hex("kept"))))
    want = brute.substring_dedup([r[:2] for r in corpus])
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_substrings_in_small_pieces_and_with_equal_hashes(spark, docs, corpus, monkeypatch):
    """Runs of a few records, and hashes that many different windows share: words decide."""
    import pickle
    import random

    import numpy as np

    from tessera.llm import arrays

    want = brute.substring_dedup([r[:2] for r in corpus])
    monkeypatch.setattr(substring_dedup, "RUN_RECORDS", 40)
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 400)
    got = by_id(substring_dedup.substring_dedup(docs, batches=4, digest=True).select("id", "n_words", "n_removed", F.lower(F.hex("kept"))))
    assert got == want
    plan = substring_dedup.Plan("words", 13, 4)
    r = random.Random(1)
    words = lambda n: " ".join(r.choice("abc") * r.randrange(1, 3) for _ in range(n))
    shared = words(30)
    texts = [(i, (words(10) + "  " + shared[i:] + "\n" + words(15)).encode()) for i in range(8)]
    rows = []
    for i, t in texts:
        buf = np.frombuffer(t, dtype=np.uint8)
        p = substring_dedup.Piece(plan, buf, np.array([0, len(buf)]))
        for j in range(len(p.lo)):
            a = p.starts[p.lo[j]]
            rows.append((i, int(p.s[j]), int(p.n[j]), int(p.place[j]), p.text[a : a + p.size[j] + 1]))
    payload = pickle.dumps([*[np.array([x[k] for x in rows], dtype=np.int64) for k in range(4)], np.array([len(x[4]) for x in rows]), np.concatenate([x[4] for x in rows])])
    full = arrays.Hasher.spans
    results = []
    for mask in (2**64 - 1, 7):  # whole hashes, and hashes of three bits
        monkeypatch.setattr(arrays.Hasher, "spans", lambda self, a, b, m=np.uint64(mask): full(self, a, b) & m)
        hit = {i: set() for i, _ in texts}
        for batch in substring_dedup.equal_words(plan)([substring_dedup.run_batch([(0, payload)])]):
            for x in batch.to_pylist():
                hit[x["id"]] |= set(range(x["s"], x["e"]))
        results.append({i: len(v) for i, v in hit.items()})
    plain = brute.substring_dedup([(i, t.decode()) for i, t in texts])
    assert results[0] == results[1] == {i: v[1] for i, v in plain.items()} and sum(results[0].values()) > 50


def test_substrings_of_a_very_long_text(spark):
    import random

    r = random.Random(8)
    long = [f"w{r.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, "own start " + "  ".join(long[1000:200_000]) + "\n" + " ".join(long[5:30])), (3, "la " * 60), (4, "la " * 61 + "end")]
    assert len(rows[0][1]) > 2 << 20
    got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).select("id", "n_words", "n_removed"))
    assert got == {1: (400_000, 0), 2: (199_027, 199_025), 3: (60, 0), 4: (62, 61)}


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(0)
    columns = [rng.integers(0, k, 3000) for k in (5, 7, 2, 1000)]
    assert [tuple(c[i] for c in columns) for i in multikey_order(columns)] == sorted(zip(*columns))


def test_awkward(awkward):
    n = awkward.count()
    ids = sorted(awkward.select("doc_id").collect(), key=str)
    for out in (
        exact_dedup.exact_dedup(awkward), suffix_dedup.suffix_dedup(awkward, digest=True), substring_dedup.substring_dedup(awkward, digest=True),
        line_dedup.apply_bitmaps(awkward, line_dedup.line_dedup(awkward)).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))),
    ):
        assert out.count() == n
        assert sorted(out.select(real_id("id").alias("doc_id")).collect(), key=str) == ids
    same = [r for r in suffix_dedup.suffix_dedup(awkward, digest=True).collect() if r.id == awkward.collect()[3].doc_id]
    assert len({(r.n_bytes, bytes(r.kept)) for r in same}) == 1  # rows that repeat are one document


def test_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert line_dedup.apply_bitmaps(nothing, line_dedup.line_dedup(nothing)).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    assert substring_dedup.substring_dedup(nothing).count() == 0
