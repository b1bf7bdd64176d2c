"""Phrases, page texts and the filter audit against plain versions, on awkward tables and at their seams."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, html_text, phrases

# Phrases.


def mined(df, **options):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.phrase_mining(df, **options).collect()}


@pytest.fixture(scope="module")
def talk():
    """A hot word and pair, phrases inside longer ones, ties, blanks, control characters, words that sort below a blank."""
    r = random.Random(3)
    rows = [(None, None), ("en", None), ("", ""), ("en", " \t .,;:!? \n\r\x0b\x0c")]
    for i in range(60):
        words = [r.choice(["the", "the", "of the", "New York City", "a\x01", "a", "b", "ß", "漢字", "x y", "x y z"]) for _ in range(40)]
        rows.append((["en", "en", "en", "de", None, ""][i % 6], "".join(w + r.choice([" ", " ", "  ", "\t", ". ", "\n"]) for w in words)))
    return rows + rows[-2:]


def test_phrases_against_brute_force(spark, talk):
    df = spark.createDataFrame([(l, t, 1, "x", 2) for l, t in talk], "lang string, text string, n long, w1 string, f int").repartition(3)
    want = brute.phrases(talk)
    assert mined(df) == want and len({k[0] for k in want}) == 4 and any(p[0].count(" ") == 2 for p in want.values())
    assert mined(df, first=3) == brute.phrases(talk, first=3)
    assert mined(df, least=4, inside_percent=80) == brute.phrases(talk, least=4, inside=80)


def test_phrases_of_small_tries_and_ranges(spark, talk, monkeypatch):
    """Tries that fill up within a piece, and walks whose batches hold a row or two."""
    monkeypatch.setattr(phrases, "TOKENS", 7)
    monkeypatch.setattr(phrases, "STEP", 3)
    monkeypatch.setattr(phrases, "ROWS", 2)
    df = spark.createDataFrame(talk, "lang string, text string").repartition(2)
    nodes = {}
    batches = [b for half in (talk[::2], talk[1::2]) for b in phrases.shard_tries(iter([_texts(half)]), [])]
    rows = sorted((r["lang"], r["w1"].encode(), r["w2"].encode(), r["w3"].encode(), r["n"]) for b in batches for r in b.to_pylist())
    cut = [0, *sorted({len(rows) // 3, len(rows) // 2}), len(rows)]
    while any(0 < c < len(rows) and rows[c][:4] == rows[c - 1][:4] for c in cut):  # equal paths are in one range
        cut = [c + 1 if 0 < c < len(rows) and rows[c][:4] == rows[c - 1][:4] else c for c in cut]
    for a, b in zip(cut, cut[1:]):
        for out in phrases.walked(_batches(rows[a:b], 2), 10):
            for r in out.to_pylist():
                key = (r["lang"], *(w for w in (r["w1"], r["w2"], r["w3"]) if w))
                nodes[key] = nodes.get(key, 0) + r["f"]
    want = {}
    for lang, text in talk:
        for k, c in brute_counts(lang, text).items():
            want[k] = want.get(k, 0) + c
    for k in [k for k in want if len(k) > 1]:
        assert want[k] < 10 or nodes[k] == want[k], k
    assert all(nodes[(lang,)] == sum(c for k, c in want.items() if len(k) == 2 and k[0] == lang) for lang in {k[0] for k in want})
    assert df.count() == len(talk)


def test_tries_are_cut_at_splitters(talk):
    """Every path's bucket is the number of splitters that are not above it, also where the vocabulary lacks a splitter's words."""
    rows = [r for b in phrases.shard_tries(iter([_texts(talk)]), []) for r in b.to_pylist()]
    keys = sorted({tuple(r[c].encode() for c in ("lang", "w1", "w2", "w3")) for r in rows})
    some = sorted({*keys[::17], (b"de", b"zzz", b"", b""), (b"", b"\x01", b"q", b""), (b"en", b"the", b"thf", b"a"), (b"en", b"the", b"the", b"thf"), (b"fr", b"a", b"b", b"c"), (b"zz", b"a", b"", b"")})
    for batch in phrases.shard_tries(iter([_texts(talk)]), some):
        for r in batch.to_pylist():
            key = tuple(r[c].encode() for c in ("lang", "w1", "w2", "w3"))
            assert r["bucket"] == sum(x <= key for x in some)


def brute_counts(lang, text):
    import re

    out = {}
    for piece in re.split(r"[.,;:!?\n-\r]", (text or "").lower()):
        ws = re.findall(r"[^ \t]+", piece)
        for k in (1, 2, 3):
            for i in range(len(ws) - k + 1):
                key = ("und" if lang is None else lang, *ws[i : i + k])
                out[key] = out.get(key, 0) + 1
    return out


def _texts(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(["und" if l is None else l for l, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])


def _batches(rows, n):
    import pyarrow as pa

    for i in range(0, len(rows), n):
        lang, a, b, c, count = zip(*rows[i : i + n])
        yield pa.RecordBatch.from_arrays([pa.array(lang)] + [pa.array([w.decode() for w in x]) for x in (a, b, c)] + [pa.array(count)], ["lang", "w1", "w2", "w3", "n"])


def test_phrases_of_a_very_long_text_and_exact_scores(spark):
    """A piece longer than a trie, and counts whose products pass 64 bits."""
    long = "alpha beta gamma " * 300_000
    df = spark.createDataFrame([("en", long), ("en", "delta alpha")], "lang string, text string")
    assert mined(df, first=5) == brute.phrases([("en", long), ("en", "delta alpha")], first=5)
    n = 3_000_000_001
    nodes = spark.createDataFrame(
        [("en", "a", "", "", n, 0), ("en", "b", "", "", n + 7, 0), ("en", "a", "b", "", n - 1, 0), ("en", "", "", "", 9 * n, 0)], "lang string, w1 string, w2 string, w3 string, f long, best long")
    row = phrases.collocations(nodes).collect()[0]
    assert row.score == 1000000 * (n - 1) ** 2 // (n * (n + 7))


def test_phrases_of_nothing(spark, nothing, awkward):
    assert mined(nothing) == {}
    assert mined(awkward, least=2) == brute.phrases([(r.lang, r.text) for r in awkward.collect()], least=2)


# Page texts.

FRAME = '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
PAGES = {
    "<p>One &amp; two&nbsp;three<br>four</p><p>five": "One & two three four\n\nfive",
    f"<html><head><title>T</title><style>p{{}}</style></head><body>{FRAME}<article><h1>Head&am</h1><p>Body <b>bold</b>er<p>Next</article><footer>&copy; x</footer>": "Head&am\n\nBody bolder\n\nNext",
    "<main><header><p>by me</p><h2>Title</h2></header><p>text</p><aside>side</aside><form>q <input></form><section id=comments><article class=comment>hi</article></section></main>": "Title\n\ntext",
    "<article><p>a<script>var x='</p>';</script>b</p><!-- <p>no</p> --><div hidden>h</div><div style='display: none'>i</div><noscript>j</noscript></article>": "ab",
    "<article>1 < 2 and <3 <a title='x > y' href=\"/>\">link</a></article>": "1 < 2 and <3 link",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>e</article>": "a\n\nb\n\nc\n\nd\n\ne",
    "<article><p>open <!-- never closed </p>": "open",
    "<article><p>x</p><script>never closed": "x",
    "<article><p class=\"broken>x</p><p>y</p></article>": "x\n\ny",
    "plain text only": "plain text only",
    "<div></p></div></article>  ": "",
    "<ARTICLE><P>Up&#x41;&#66;&lt;p&gt;</P></ARTICLE>": "UpAB<p>",
    None: "",
    "": "",
}


def test_markup(spark):
    rows = [(i, f"http://h{i}/", h, "x", 1) for i, h in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, h int")
    got = {r.id: (r.text, r.n_chars) for r in html_text.page_texts(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}


def test_repeats_of_a_host(spark):
    """Pages that name no article: what other pages of the host have goes, wherever it stands; mirrors and other hosts repeat nothing."""
    menu, legal = "Home News Sports Weather Money Travel Food Arts Games", "All rights of these pages are with their makers and friends"
    own = [f"tale{i} number {i} tells what happened on day {i} in town {i} and to whom it happened then" for i in range(6)]
    page = lambda i: f"<div>{menu}</div><div><p>{own[i]}</p><p>short {i}</p></div><div>{legal} {i}</div>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(4)]
    rows += [(10, "http://b.example/", page(4)), (11, "http://c.example/1", page(5)), (12, "http://c.example/2", page(5)), (None, "http://a.example", page(0)), (0, "http://a.example/x", page(0))]
    rows += [(20, "http://a.example/t", f"<div>{menu} tail</div>"), (21, None, page(0)), (22, "no url", page(1))]
    rows += [(30, "http://A.EXAMPLE:80/q", f"<nav>{legal}</nav><article>{menu} {own[0]}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(((r.id, r.text) for r in html_text.page_texts(df).collect()), key=str)
    cut = lambda i: f"{own[i]}\n\nshort {i}\n\n{i}"
    whole = lambda i: f"{menu}\n\n{own[i]}\n\nshort {i}\n\n{legal} {i}"
    want = [(i, cut(i)) for i in range(4)] + [(10, whole(4)), (11, whole(5)), (12, whole(5)), (-(2**63), cut(0)), (0, cut(0)), (20, "tail"), (30, f"{menu} {own[0]}")]
    assert [x for x in got if x[0] not in (21, 22)] == sorted(want, key=str)
    both = dict(got)
    assert both[21] == cut(0) and both[22] == cut(1)  # both stand for the host without a name


def test_repeats_of_a_large_group_and_long_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SUFFIXES", 50)
    footer = "this very common footer stands on every page of the large host"
    rows = [(i, "http://big/", f"<div>page {i} is {'long ' * (5000 if i == 3 else 1)}{i}</div><div>{footer}</div>") for i in range(300)]
    got = {r.id: r.text for r in html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: " ".join(f"page {i} is {'long ' * (5000 if i == 3 else 1)}{i}".split()) for i in range(300)}


def test_linear_time():
    """Texts that make careless scanners quadratic."""
    for html in ('<a href="' * 40_000, "<" * 200_000, "<!--" * 100_000, "<p " * 100_000, "<b>" * 100_000, "</div>" * 100_000, "<script>" * 50_000, "<article>" + "<p>x" * 50_000, "<div class='" + "a-" * 100_000 + "'>", "&amp" * 100_000):
        html_text.blocks(html)


def test_no_pages(spark):
    assert html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Filter audit.


def audited(docs, labels, **options):
    out = filter_audit.audit(filter_audit.mask_counts(filter_audit.masked(docs, **options), labels))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = out.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def labels_of(spark, docs):
    ids = [r.doc_id for r in docs.collect()]
    rows = [(i, n % 2, n % 3 == 0) for n, i in enumerate(ids)] + [(None, 1, True), (ids[0], 1, False), (ids[1], None, None), (10**9, 1, True)]
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in rows], "doc_id long, quality int, toxic int")


def extended(spark, corpus):
    """Copies whose lengths and first blocks agree, symbols, capitals, long texts."""
    base = "word " * 2000
    more = [base + "a", base + "b", base + "a", "x" * 256 + "y", "x" * 256 + "z", "x" * 256 + "y", "ABC def", "a # b", " ".join(f"w{i}" for i in range(300)), "漢" * 300, "漢" * 300, "a\U0001f600"]
    return corpus + [(5000 - i, t, "en", f"src{i % 2}", 1) for i, t in enumerate(more)]


def test_audit_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(extended(spark, corpus), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = labels_of(spark, docs)
    want = brute.filter_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert audited(docs, labels) == want and any(v[6] for v in want.values())
    # texts whose hashes all agree are told apart by themselves
    assert audited(docs, labels, hashed=lambda c: F.lit(7).cast("long")) == want


def test_audit_of_awkward_rows(spark, awkward, nothing):
    docs = awkward.withColumnsRenamed({"path": "part", "score": "mask"})
    labels = labels_of(spark, docs)
    assert audited(docs, labels) == brute.filter_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert audited(nothing, labels) == {}
    assert set(audited(docs, labels.limit(0))) == set(audited(docs, labels))


def test_audit_of_a_large_group(spark):
    rows = [(i, "the same text", "s", "hot", 1) for i in range(2000)] + [(5000 + i, f"text {i}", "s", "hot", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = audited(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got["hot", "EABCD", 1][:3] == (51, 1999, 0) and got["hot", "ABCDE", 5][:3] == (0, 0, 1999)
