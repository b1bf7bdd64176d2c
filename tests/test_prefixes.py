"""The stored prefix dictionary against the words themselves."""

import random

import pytest

from tessera.operators.prefixes import PrefixIndex, words_of_files
from tessera.sources import versions as V


@pytest.fixture(scope="module")
def entries():
    r = random.Random(2)
    words = ["a", "an", "and", "android", "anna", "ann", "ant", "知识", "知识图谱", "the", "there", "them", "thesis", "z_y", "über"] + [f"the{i}" for i in range(30)] + [f"w{r.randrange(500)}" for _ in range(60)]
    return [(w, i, r.randrange(1, 5)) for w in dict.fromkeys(words) for i in r.sample(range(20), r.randrange(1, 6))]


def plain(entries, prefix, limit):
    words = {}
    for w, _, n in entries:
        f, c = words.get(w, (0, 0))
        words[w] = (f + n, c + 1)
    p = prefix.lower().strip()
    return sorted(((w, *fc) for w, fc in words.items() if p and w.startswith(p)), key=lambda x: (-x[1], x[0].encode()))[:limit]


PREFIXES = ["t", "TH", " the ", "thes", "thesis", "a", "an", "and", "知", "知识图谱", "q", "", "w1", "the1", "z", "ü"]


def check(index, entries):
    for p in PREFIXES:
        for limit in (3, 10, 25):
            assert [tuple(r) for r in index.autocomplete(p, limit).collect()] == plain(entries, p, limit), (p, limit)
        q = p.lower().strip()
        assert sorted(r.id for r in index.search(p).collect()) == sorted({i for w, i, _ in entries if w.startswith(q)})


def test_completions_and_changes(spark, entries, tmp_path):
    path, schema = str(tmp_path / "p"), "word string, id long, weight long"
    with pytest.raises(FileNotFoundError):
        PrefixIndex.open(spark, path).search("a")
    half = len(entries) // 2
    PrefixIndex.open(spark, path).add(spark.createDataFrame(entries[:half], schema))
    again = entries[: half // 2]
    index = PrefixIndex.open(spark, path).add(spark.createDataFrame(entries[half:] + again, schema))
    weights = {}
    for w, i, n in entries + again:
        weights[w, i] = weights.get((w, i), 0) + n
    now = [(w, i, n) for (w, i), n in weights.items()]
    check(index, now)
    gone = [1, 4, 7, 99]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    check(PrefixIndex.open(spark, path), [e for e in now if e[1] not in gone])
    assert V.numbers(spark, path) == [1, 2, 3] and PrefixIndex.open(spark, path, 2).table("words").count() == len({w for w, _, _ in now})


def test_a_long_prefix_is_pushed_to_the_scan(spark, entries, tmp_path):
    index = PrefixIndex.open(spark, str(tmp_path / "q")).add(spark.createDataFrame(entries, "word string, id long, weight long"))
    plan = index.table("words").where("word >= 'thesi'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(word,thesi)" in index.search("thesi")._jdf.queryExecution().executedPlan().toString()


def test_words_of_files(spark, tmp_path):
    """Which files of a base are indexed, under which ids, and what metadata lines weigh."""
    text = "# Title\n**Tags**: red, A, red\n**Project**: my-app\n**Other**: unseen\n\nred line red\nline two"
    paths = ["timeline/2024/a.md", "timeline/b.md", "active/topic/entries/deep/c.md", "active/topic/d.md", "notes/e.md", "timeline/f.txt", "MEMORY.md", "README.md", "timeline/MEMORY.md", "activex/topic/entries/g.md"]
    files = spark.createDataFrame([(p, text) for p in paths] + [("timeline/n.md", None), ("timeline/z.md", ""), (None, text)], "path string, text string")
    got = {(r.word, r.id): r.weight for r in words_of_files(files).collect()}
    want = {"title": 1, "red": 5, "my-app": 2, "my": 2, "app": 2, "line": 2, "two": 1}
    assert got == {(w, i): n for i in ("a", "b", "c", "core-MEMORY.md", "MEMORY") for w, n in want.items()}
    index = PrefixIndex.open(spark, str(tmp_path / "index")).add(words_of_files(files))
    assert [(r.word, r.frequency, r.n_entries) for r in index.autocomplete("r").collect()] == [("red", 25, 5)]
