import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy(r, words, share):
    return [w if r.random() > share else f"z{r.randrange(10**6)}" for w in words]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and lines, long and empty ones."""
    r = random.Random(5)
    vocabulary = [f"w{i}{'ab' * (i % 4)}" for i in range(900)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(prose(60)), "A common line that many documents share"
    base = prose(120)
    texts = [None, "", " \n\t ", "Ünïcode ß é 漢字 one two", "!!! ??? ...", "a"]
    texts += [" ".join(prose(r.randrange(1, 150))) for _ in range(30)]
    texts += [" ".join(prose(20)) + " " + passage + " " + " ".join(prose(20)) for _ in range(6)]
    texts += [" ".join(base)] * 3 + [" ".join(base).upper()] + [" ".join(near_copy(r, base, 0.02)) for _ in range(12)] + [" ".join(near_copy(r, base, 0.3)) for _ in range(4)]
    texts += ["\n".join([" ".join(prose(8)), f"  {line.upper() if i % 2 else line} ", " ".join(prose(9)), line]) for i in range(5)]
    texts += ["xyz " * 400, "ab" * 500, " ".join(prose(4000))]
    r.shuffle(texts)
    return [(i * 3 + 1, t, "en", None if i % 9 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def awkward(spark, corpus):
    """Nulls in every column, repeated rows and ids, clashing extra columns."""
    rows = [r + (1, "x", 2.0) for r in corpus[:25]]
    rows += [(None, None, None, None, None, None, None, None), (None, "null id text", None, None, None, 1, None, None), rows[3], rows[3], (rows[4][0], "another text of the same id", "en", "src1", 5, 1, "y", 0.5)]
    return spark.createDataFrame(rows, SCHEMA + ", id long, path string, score double")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
