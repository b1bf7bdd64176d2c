"""Golden values of scalar functions and predicates."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import browse as B


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,n", [("abcd", 1), ("abcde", 2), ("a", 1), ("hello world", 3), ("Hello 世界", 5), ("你好世界测试", 9), ("", 0), (None, 0)])
def test_estimate_tokens(spark, text, n):
    assert one(spark, S.estimate_tokens, text) == n


@pytest.mark.parametrize("text,tokens", [("知识图谱", ["知识", "识图", "图谱"]), ("JavaScript a x1", ["javascript", "x1"]), ("学", []), (None, [])])
def test_bm25_tokens(spark, text, tokens):
    assert one(spark, S.bm25_tokens, text) == tokens


def test_trie_tokens(spark):
    assert one(spark, S.trie_tokens, "a bb ccc") == ["bb", "ccc"]
    assert one(spark, S.trie_tokens, "kebab-case **bold**") == ["kebab-case", "bold", "kebab", "case"]


@pytest.mark.parametrize("text,link", [
    ("See [[Chapter 1|First Chapter]] for details", ("Chapter 1", None, "First Chapter", False)), ("![[image.png]]", ("image.png", None, None, True)),
    ("See [[01DEF456/01GHI789|Display Name]] for details", ("01GHI789", "01DEF456", "Display Name", False)), ("[[x]]", ("x", None, None, False)),
])
def test_wiki_links(spark, text, link):
    assert [tuple(x) for x in one(spark, S.wiki_links, text)] == [link]


def test_no_links(spark):
    assert one(spark, S.wiki_links, "no [links] here") == [] and one(spark, S.wiki_links, None) == []


@pytest.mark.parametrize("a,b,want", [(None, None, "a0"), ("a0", None, "a00"), (None, "a0", "00"), (None, "\x20", "a0"), ("a", "c", "b"), ("a", "b", "aV"), ("a", "a", "aV"), ("a", "az", "am")])
def test_fractional_index(a, b, want):
    assert S.fractional_index(a, b) == want


@pytest.mark.parametrize("x,want", [(2.5, 3.0), (-2.5, -2.0), (2.4, 2.0)])
def test_js_round(spark, x, want):
    assert one(spark, S.js_round, x, "double") == want


@pytest.mark.parametrize("path,want", [("/project/.env", True), ("/project/.ssh/id_rsa", True), ("/project/config.json", True), ("/project/src/index.js", False), ("C:\\x\\.git\\y", True)])
def test_excluded(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(B.excluded("p")).first()[0] is want


def test_sensitive_counts_a_type_once(spark):
    d = spark.createDataFrame([("password = 'abcd' password = 'efgh' Bearer abcdefghijkl",)], "t string")
    assert d.select(B.sensitive_types("t")).first()[0] == ["password", "bearer_token"]


def test_node_hash_defaults(spark):
    d = spark.range(1).select(S.node_hash(*[F.lit(None).cast("string")] * 6).alias("h"), F.substring(F.sha2(F.lit("undefined|undefined||||"), 256), 1, 16).alias("w"))
    r = d.first()
    assert r.h == r.w


def test_frontmatter(spark):
    text = "---\nid: 7\ndate: 2024-01-01T10:00:00\nno colon\nmeta: [1]\n---\nbody"
    assert one(spark, S.frontmatter, text) == {"id": "7", "date": "2024-01-01T10:00:00", "meta": "[1]"}
    assert one(spark, S.strip_frontmatter, text) == "body"


def test_line_and_column(spark):
    d = spark.createDataFrame([("ab\ncde\nf", 5)], "t string, o int").select(S.line_of_offset("t", "o"), S.column_of_offset("t", "o")).first()
    assert tuple(d) == (2, 2)
