"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is what one of PATTERNS matches anywhere in a text. The forest sees the candidate's length, its character transitions
under a model of plain words, its character classes and entropy, the share of it that dictionary words cover, the path of the file and the words
next to it. The dictionary is that of the corpus: the words that most documents hold, counted over all documents (dictionary). The
forest learns from labelled findings: rows of a table (findings_of), or, where there is none, findings made by rule (labelled_findings).

Defined results. Null and empty texts and paths have no candidates, and a null path counts as the empty path. A null id is
kept. Rows that repeat an id are scanned each for itself. An empty table gives an empty result. Extra columns are ignored,
whatever their names. Matches of one pattern don't overlap; where patterns match at the same place, the first in the list counts.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import id_key, real_id, row_batches, ship, text_of

ship(__name__)

# Publicly documented formats of credentials.
PATTERNS = [
    ("private_key", rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    ("aws_key_id", rb"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", rb"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    ("slack_token", rb"\bxox[abprs]-[0-9A-Za-z-]{10,60}"),
    ("google_key", rb"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", rb"\b[sr]k_live_[0-9A-Za-z]{16,}"),
    # from the start of a run to its first eyJ; what fails there fails for the rest of the run too, so each run is read once for each part
    ("jwt", rb"(?<![0-9A-Za-z_-])(?>[0-9A-Za-z_-]*?\b(?=eyJ))(eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{5,}+)"),
    ("assignment", rb"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,3}[=:]\s{0,3}[\"']?([0-9A-Za-z_./+=~!@#$%^&*-]{8,})"),
    ("opaque", rb"(?<![0-9A-Za-z/+_-])(?=[0-9A-Za-z/+_-]*[0-9])[0-9A-Za-z/+_-]{32,}(?![0-9A-Za-z/+_-])"),
]
WORDS = "the of and to in is that for it as was with be by on not are this from at or have an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other time new some could these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long here get both between life being under never day same another know while last might us great old year off come since against go came right used take three password secret token example test sample default changeme user admin key value name file data".split()
CONTEXT = ("token", "secret", "password", "passwd", "key", "auth", "credential", "bearer", "login")
DOUBT = ("example", "sample", "dummy", "test", "fake", "placeholder", "your", "xxxx", "changeme", "sha", "md5", "commit", "checksum", "uuid", "digest", "hash")
NAMES = ["length", "surprise", "digits", "upper", "other", "switches", "entropy", "covered", "repeats", "context", "doubt", "doubt_inside", "path_doubt", "named", "dashes"]
SPAN = 40
#: Words of a dictionary, documents that must hold one, and rows of labelled findings that are learnt, at most.
DICTIONARY, LEAST_DOCS, FINDINGS = 20_000, 5, 20_000


def bigram_model(words: list[str]) -> np.ndarray:
    counts = np.full((128, 128), 0.05)
    for w in words:
        for a, b in zip(w, w[1:]):
            counts[ord(a), ord(b)] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


NAMED = A.byte_table([*range(0x30, 0x3A), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)])


def dictionary(docs: DataFrame, size: int = DICTIONARY, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The `size` words of 3 to 20 letters, alone between other characters, that most rows hold; counted over whole texts of all rows."""

    def count(batches):
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(0))
            for lo, hi in A.chunks(offsets):
                buf = A.LOWERED[data[offsets[lo] : offsets[hi]]]
                starts, ends, at = A.words(buf, offsets[lo : hi + 1] - offsets[lo], NAMED)
                strange = np.concatenate([[0], np.cumsum((buf < 0x61) | (buf > 0x7A))])
                plain = (strange[ends] == strange[starts]) & (ends - starts >= 3) & (ends - starts <= 20)
                row, starts, ends = A.rows_of(at)[plain], starts[plain], ends[plain]
                codes = A.word_codes(buf, starts, ends)
                order = np.lexsort((row, codes))
                codes, row = codes[order], row[order]
                new = np.ones(len(codes), dtype=bool)
                new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
                kept = order[new]
                word, first, n = np.unique(codes[new], return_index=True, return_counts=True)
                text = buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([text[starts[i] : ends[i]].decode() for i in kept[first]], type=pa.string()), pa.array(n, type=pa.int64())], names=["word", "n"])

    row_batches(docs.sparkSession)
    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def findings_of(labelled: DataFrame, limit: int = FINDINGS) -> list[tuple[str, str, str, str, str, int]]:
    """Rows for fit_forest from a table of labelled findings: text, start and length in bytes, rule, path, label (1: a secret). At most `limit` rows, by a hash of the row."""
    rows = labelled.select("text", "start", "length", "rule", F.coalesce("path", F.lit("")).alias("path"), "label").orderBy(F.xxhash64("text", "start", "length")).limit(limit)
    out = []
    for r in rows.toLocalIterator():
        b, s, e = r["text"].encode(), r["start"], r["start"] + r["length"]
        part = lambda x: x.decode(errors="replace")
        out.append((r["rule"], part(b[s:e]), part(b[max(0, s - SPAN - 8) : s]), part(b[e : e + SPAN + 8]), r["path"], int(r["label"])))
    return out


class Describer:
    def __init__(self, words: list[str] = ()):
        every = sorted({*WORDS, *words})
        self.model, self.words = bigram_model([w for w in every if w.isascii()]), {w for w in every if len(w) > 2}
        self.longest = max(map(len, self.words))

    def covered(self, low: str) -> int:
        """Characters under dictionary words, taken from the left, the longest first."""
        at = n = 0
        while at < len(low):
            size = next((k for k in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + k] in self.words), 0)
            n += size
            at += size or 1
        return n

    def __call__(self, rule: str, value: str, before: str, after: str, path: str) -> list[float]:
        n = max(1, len(value))
        low = value.lower()
        codes = [min(ord(c), 127) for c in low]
        pairs = list(zip(codes, codes[1:]))
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
        counts = [value.count(c) / n for c in set(value)]
        near = (before[-SPAN:] + " " + after[:SPAN]).lower()
        return [
            n, -sum(self.model[a, b] for a, b in pairs) / max(1, len(pairs)), kind.count("d") / n, kind.count("u") / n, kind.count("o") / n,
            sum(a != b for a, b in zip(kind, kind[1:])) / n, -sum(p * math.log2(p) for p in counts), self.covered(low) / n, max(counts, default=0),
            sum(w in near for w in CONTEXT), sum(w in near for w in DOUBT), sum(w in low for w in DOUBT), sum(w in path.lower() for w in (*DOUBT, "spec", "docs", "fixture")),
            float(rule not in ("assignment", "opaque")), value.count("-") / n,
        ]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, str, int]]:
    """(rule, value, before, after, path, 1 if a secret), made by rule: n rows."""
    r = random.Random(seed)
    hexa, b62, up = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    out = []
    for _ in range(n):
        path = r.choice(["src/app.py", "config/prod.env", "src3/12", "notes.txt", "tests/test_auth.py", "docs/example.md"])
        before, after = prose(6) + " ", " " + prose(5)
        key = r.choice(["token", "secret", "password", "api_key", "access_key", "auth"])
        kind = r.randrange(12)
        if kind < 3:
            row = ("assignment", some(r.choice([hexa, b62]), r.choice([20, 24, 32, 40, 64])), before + key + ' = "', '"' + after, 1)
        elif kind == 3:
            row = ("aws_key_id", r.choice(["AKIA", "ASIA"]) + some(up, 16), before, after, 1)
        elif kind == 4:
            row = ("github_token", "ghp_" + some(b62, 36), before, after, 1)
        elif kind == 5:
            row = ("assignment", some(b62, 8) + r.choice("!#$%") + some(b62, 4), before + "password: ", after, 1)
        elif kind == 6:
            row = ("assignment", r.choice(["changeme", "your_token_here", "example_password", "xxxxxxxxxxxxxxxx", "default_value", "password123", "test_secret_key"]), before + key + " = ", after, 0)
        elif kind == 7:
            row = ("assignment", "".join(r.choice(WORDS) for _ in range(r.randrange(3, 6)))[:30].ljust(8, "a"), before + key + ": ", after, 0)
        elif kind == 8:
            row = ("opaque", some(hexa, r.choice([32, 40, 64])), before + r.choice(["commit ", "sha256:", "md5 ", "checksum ", "digest "]), after, 0)
        elif kind == 9:
            row = ("opaque", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), before + r.choice(["uuid ", "id ", "request "]), after, 0)
        elif kind == 10:
            row = ("opaque", r.choice(["/", "_", "-"]).join(r.choice(WORDS) for _ in range(9)) + "1", before, after, 0)
        else:
            row = ("aws_key_id", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEEXAMPLE12"]), before, after, 0)
        out.append((row[0], row[1], row[2], row[3], path, row[4]))
    return out


class Forest:
    """Random forest: bootstrap rows, random features at each split, Gini."""

    def __init__(self, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 1):
        self.n, self.depth, self.least, self.seed, self.trees = trees, depth, least, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.trees = [self._grow(x[(b := rng.integers(0, len(x), len(x)))], y[b], rng, 0) for _ in range(self.n)]
        return self

    def _grow(self, x, y, rng, depth):
        p = float(y.mean())
        if depth == self.depth or len(y) < 2 * self.least or p in (0.0, 1.0):
            return p
        best = (p * (1 - p) * len(y) - 1e-9, None, None)
        for j in rng.permutation(x.shape[1])[: max(2, int(math.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[:, j], kind="stable")
            v, ones = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            cut = cut[(cut >= self.least) & (len(v) - cut >= self.least)]
            if len(cut):
                left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
                gini = left * (1 - left / cut) + right * (1 - right / (len(v) - cut))
                i = int(np.argmin(gini))
                if gini[i] < best[0]:
                    best = (gini[i], j, (v[cut[i] - 1] + v[cut[i]]) / 2)
        if best[1] is None:
            return p
        side = x[:, best[1]] <= best[2]
        return (int(best[1]), float(best[2]), self._grow(x[side], y[side], rng, depth + 1), self._grow(x[~side], y[~side], rng, depth + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if not isinstance(node, tuple):
                    out[at] += node
                elif len(at):
                    side = x[at, node[0]] <= node[1]
                    todo += [(node[2], at[side]), (node[3], at[~side])]
        return out / max(1, len(self.trees))


def fit_forest(findings=None, seed: int = 1, words: list[str] = ()) -> Forest:
    """findings: rows as labelled_findings makes them; words: the dictionary."""
    findings = findings if findings is not None else labelled_findings()
    describe = Describer(words)
    return Forest(seed=seed).fit(np.array([describe(*f[:5]) for f in findings]), np.array([f[5] for f in findings], dtype=float))


#: What a match of the rule must hold; texts without it needn't be searched. `opaque` needs a long run, found with array operations.
NEEDED = {
    "private_key": (b"PRIVATE KEY-----",), "aws_key_id": (b"AKIA", b"ASIA"), "github_token": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), "slack_token": (b"xox",),
    "google_key": (b"AIza",), "stripe_key": (b"k_live_",), "jwt": (b"eyJ",), "assignment": (b"=", b":"),
}
RUN = A.byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/+_-")


def candidates(text: bytes, long_run: bool = True):
    """(rule, start, end) in order; of matches that overlap the first pattern's counts. long_run: whether the text has 32 RUN bytes in a row."""
    taken, found = bytearray(len(text)), []
    for rule, pattern in COMPILED:
        if not (any(x in text for x in NEEDED[rule]) if rule in NEEDED else long_run):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(1) if pattern.groups else m.span()
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                found.append((rule, s, e))
    return sorted(found, key=lambda f: f[1])


COMPILED = [(rule, re.compile(p)) for rule, p in PATTERNS]
SCHEMA = "id long, start long, length long, rule string, score double"


def scan(forest: Forest, words: list[str]):
    """mapInArrow: (id, text, path) to SCHEMA; start and length count bytes."""

    def work(batches):
        describe = Describer(words)
        for batch in batches:
            rows, x = [], []
            data, offsets = A.text_bytes(batch.column(1))
            run = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi in A.chunks(offsets):
                starts, ends, at = A.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], RUN)
                run[lo:hi] = np.bincount(A.rows_of(at), ends - starts >= 32, hi - lo) > 0
            for j, (i, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = data[offsets[j] : offsets[j + 1]].tobytes()
                for rule, s, e in candidates(text, bool(run[j])):
                    part = lambda a, b: text[max(0, a) : b].decode(errors="replace")  # noqa: B023, E731
                    rows.append((i, s, e - s, rule))
                    x.append(describe(rule, part(s, e), part(s - SPAN - 8, s), part(e, e + SPAN + 8), path))
            if rows:
                ids, starts, lengths, rules = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(starts, type=pa.int64()), pa.array(lengths, type=pa.int64()), pa.array(rules), pa.array(forest.score(np.array(x)))], names=["id", "start", "length", "rule", "score"])

    return work


def secret_scan(docs: DataFrame, forest: Forest | None = None, path: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """One row a candidate: id, start, length, rule, score (share of trees' votes that it is a secret).

    words: the dictionary, by default that of docs; labelled: a table of findings to learn from (findings_of).
    """
    row_batches(docs.sparkSession)
    words = dictionary(docs, id_col=id_col, text_col=text_col) if words is None else words
    forest = forest or fit_forest(findings_of(labelled) if labelled is not None else None, words=words)
    where = F.coalesce(path.cast("string"), F.lit("")) if path is not None else F.lit("")
    return docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"), where.alias("path")).mapInArrow(scan(forest, words), SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = secret_scan(docs, path=F.concat_ws("/", "source", "doc_id"))
    return out.select(real_id("id").alias("doc_id"), "start", "length", "rule", "score", (F.col("score") >= 0.5).alias("is_secret"))
