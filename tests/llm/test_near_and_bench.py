"""Near-dedup and decontamination against brute force."""

from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontamination as D
from tessera.llm import near_dedup as N


def multiset(text, size=5):
    ws = brute.BENCH_WORD.findall((text or "").translate(brute.AZ))
    return Counter(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else Counter()


def classes(rows, least=0.8):
    sets, up = {i: multiset(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            common = sum((x & y).values())
            if common and common >= least * (sum(x.values()) + sum(y.values()) - common):
                a2, b2 = find(a), find(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: find(i) for i in ids}


def test_near(docs, corpus):
    got = {r.id: r["class"] for r in N.near_dedup(docs).collect()}
    want = classes([r[:2] for r in corpus])
    assert got == want and len(set(want.values())) < len(want)


def test_near_group_with_a_ragged_edge(spark):
    """A group of near copies larger than a small bucket, with members too far from its middle."""
    import random

    r = random.Random(3)
    base = [f"b{r.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(w if r.random() > (i % 12) * 0.004 else f"x{r.randrange(9999)}" for w in base)) for i in range(140)]
    got = {x.id: x["class"] for x in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_pair_among_unlike_members_of_large_buckets(spark, monkeypatch):
    """All texts share a template and with it every bucket, and only two, not central, are near enough."""
    template = [f"t{i}" for i in range(104)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(12 if i in (6, 144) else 14)])) for i in range(150)]
    want = classes(rows)
    assert want[144] == 6 and len(set(want.values())) == 149
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.id: x["class"] for x in N.near_dedup(frame).collect()} == want
    monkeypatch.setattr(N, "BLOCK", 20)
    assert {x.id: x["class"] for x in N.near_dedup(frame).collect()} == want


def test_block_links_against_all_pairs():
    """A block against itself and two blocks against each other give the classes of all pairs that share no earlier band."""
    rng = np.random.default_rng(4)
    parts = []
    for i in range(60):
        codes = np.unique(rng.integers(i % 5 * 40, i % 5 * 40 + 44, 90).astype(np.uint64))
        parts.append((i, i // 2 * 2 if i % 3 else i, i % 2, rng.integers(0, 9, 3), codes, rng.integers(1, 3, len(codes))))
    bags = [Counter(dict(zip(p[4].tolist(), p[5].tolist(), strict=True))) for p in parts]

    def joined(links):
        up = [p[1] for p in parts]
        for a, b in links:
            up = [up[a] if c == up[b] else c for c in up]
        return {frozenset(i for i, c in enumerate(up) if c == k) for k in up}

    for one in (True, False):
        want = [
            (a, b) for a in range(60) for b in range(60)
            if (a < b if one else (a % 2, b % 2) == (0, 1)) and not (parts[a][3][:2] == parts[b][3][:2]).any() and sum((bags[a] & bags[b]).values()) >= 0.6 * sum((bags[a] | bags[b]).values())
        ]
        got = N.block_links(parts, one, 2, 0.6)
        assert set(got) <= set(want) and joined(got) == joined(want) and len(joined(want)) < len(joined([]))


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    m, at = 400, []
    for _ in range(20):
        codes = np.unique(rng.integers(1, 2**62, 60).astype(np.uint64))
        x, y = rng.integers(0, 4, len(codes)), rng.integers(0, 4, len(codes))
        row = np.repeat([0, 1], len(codes))
        counts = np.concatenate([x, y])
        some = counts > 0
        h = N.bag_minhash(row[some], np.concatenate([codes, codes])[some], counts[some], 2, m)
        at.append((h[0] == h[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(at)) < 0.02 and np.max(np.abs(at)) < 0.12


def test_near_awkward(awkward, nothing):
    out = N.near_dedup(awkward).collect()
    assert len(out) == awkward.count() and N.near_dedup(nothing).count() == 0


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "short item here"), (10, "One, two; THREE four five six seven eight nine ten eleven twelve thirteen other end"), (3, None), (4, "?!"), (5, "x x x x x x x x x x x x x x x x")]
TEXTS = [
    (1, "zz " + ITEMS[0][1] + " yy"), (2, "a short item here b"), (3, "one two three four five six seven eight nine ten eleven twelve"), (4, None), (5, ""), (6, "x " * 40), (7, "word " * 300 + "short ITEM-here"),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen " * 3), (9, "é short item, here ß"), (10, "shortitem here short item"),
]


def test_contamination(spark):
    d, b = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.contamination(TEXTS, ITEMS)
    for max_words, pass_words in ((D.MAX_WORDS, D.PASS_WORDS), (20, D.PASS_WORDS), (20, 40)):  # one automaton, several in one pass, several passes
        out = D.contamination(d, b, max_words=max_words, pass_words=pass_words).select("id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), D.is_contaminated())
        assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    assert sum(v[4] for v in want.values()) >= 5


def test_contamination_keeps_rows_of_equal_and_null_ids_apart(spark):
    hit, clean = "zz " + ITEMS[0][1] + " yy", "nothing of the kind here"
    rows = [(1, hit), (1, clean), (2, hit), (2, hit), (None, hit), (None, clean), (None, clean + " too"), (None, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    sizes = ((D.MAX_WORDS, D.PASS_WORDS), (20, D.PASS_WORDS), (20, 30))
    one, several, more = ([tuple(r) for r in D.contamination(d, b, max_words=m, pass_words=p).select("id", "n_words", "n_hit", "hits", "items").collect()] for m, p in sizes)
    assert Counter(map(str, several)) == Counter(map(str, one)) == Counter(map(str, more)) and len(several) == len(rows)
    for m, p in sizes:
        left = Counter(tuple(r) for r in D.uncontaminated(d, b, max_words=m, pass_words=p).collect())
        assert left == Counter(r for r in rows if r[1] != hit)


def test_contamination_of_generated_texts(spark, docs, corpus):
    import random

    r = random.Random(2)
    items = [(i, " ".join((c[1] or "").split()[k : k + r.randrange(3, 40)])) for i, c in enumerate(corpus) if (k := r.randrange(10)) >= 0][:40]
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(docs, b).select("id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), D.is_contaminated())
    assert {r_[0]: tuple(r_)[1:] for r_ in out.collect()} == brute.contamination([c[:2] for c in corpus], items)


def test_contamination_of_a_very_long_text(spark):
    """A text beyond the chunk size, with an item at its end."""
    import random

    r = random.Random(4)
    text = " ".join(r.choice(["zig", "zag", "one", "two", "three"]) + str(r.randrange(50)) for _ in range(500_000)) + " " + ITEMS[0][1]
    rows = [(1, text), (2, ITEMS[0][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {x.id: (x.n_words, x.n_hit, x["items"], x.hits[0].e) for x in D.contamination(d, b).collect()}
    assert len(text) > 2 << 20 and got == {1: (500_015, 15, ["1", "10"], 500_015), 2: (15, 15, ["1", "10"], 15)}


def test_contamination_awkward(spark, awkward, nothing):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(awkward, b).count() == awkward.count()
    assert D.contamination(nothing, b).count() == 0
    assert D.contamination(awkward, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
