"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import permutations


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(docs, width=100):
    """docs: (id, text). {id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def substring_dedup(docs, width=13):
    """{id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone, own = [False] * len(ws), set()
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            own.add(w)
        seen |= own
        out[i] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g).encode()))
    return out


AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, width=13):
    """{id: (n_words, n_hit, n_items, sha, contaminated)}"""
    windows = {}
    for item, text in items:
        ws = BENCH_WORD.findall((text or "").translate(AZ))
        for s in range(max(1, len(ws) - width + 1)):
            if ws:
                windows.setdefault(tuple(ws[s : s + width]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        ws = BENCH_WORD.findall((text or "").translate(AZ))
        hit, found = [False] * len(ws), set()
        for n in lengths:
            for s in range(len(ws) - n + 1):
                if (w := tuple(ws[s : s + n])) in windows:
                    hit[s : s + n] = [True] * n
                    found |= windows[w]
        n_hit = sum(hit)
        out[i] = (len(ws), n_hit, len(found), sha(",".join(sorted(found)).encode()), n_hit > 0 and 20 * n_hit >= len(ws))
    return out


class Article(HTMLParser):
    """Blocks inside `article`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "ul", "li", "div", "article") else []
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "ul", "li", "div", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    return "\n\n".join(t for b in p.blocks if (t := " ".join(b.split())))


def phrases(docs, least=10, inside=50, first=2000):
    """docs: (lang, text). {(lang, rank): (phrase, a, l, r, n, score)}"""
    f = {}
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            ws = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f.setdefault("und" if lang is None else lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = {}
    for lang, counts in f.items():
        n, found = sum(c for p, c in counts.items() if len(p) == 1), []
        longer = [(p, c) for p, c in counts.items() if len(p) == 3 and c >= least]
        for p, a in counts.items():
            if len(p) == 1 or a < least or any(len(p) == 2 and p in (t[:2], t[1:]) and 100 * c >= inside * a for t, c in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n, -s)
    return out


def filter_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). {(part, order, step): seven counts}; documents are filtered one order after the other."""
    low = lambda i: -(2**63) if i is None else i
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", low(i)), low(i))
    parts = {}
    for i, text, source in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": low(i) > first[t]}
        parts.setdefault(source or "", []).append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                fail = sum(x in r[1] for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), fail - len(gone), sum(r[1] == {x} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}
