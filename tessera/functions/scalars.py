"""Scalar functions of the knowledge base as column expressions: tokenizers, estimates, parsers, hashes, grades.

All are built-in expressions, so they stay in the JVM and are pruned and pushed like any other column.
"""

from __future__ import annotations

import re
import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that the tokenizer keeps whole, by length; the order among equals is that of the list.
TECH_TERMS = ["错误处理", "异步编程", "并发控制", "生命周期", "状态管理", "分支管理", "错误传播", "流式处理", "代码分析", "响应式", "组件化", "背压", "双工", "管道"]
# Query expansions by first word.
EXPANSIONS = {
    "promise": ["Promise", "async", "await", "then", "catch"],
    "async": ["async", "await", "Promise", "异步"],
    "vue": ["Vue", "Composition API", "setup", "reactive", "ref"],
    "setup": ["setup", "Composition API", "script setup"],
    "stream": ["stream", "Readable", "Writable", "pipe", "pipeline"],
    "git": ["Git", "GitFlow", "GitHub Flow", "分支", "merge"],
    "error": ["error", "错误处理", "catch", "try/catch"],
    "ref": ["ref", "reactive", "computed", "watch"],
}
# Relation weights.
EDGE_WEIGHTS = {
    "contains_EXTRACTED": 1.0, "method_EXTRACTED": 0.9, "imports_EXTRACTED": 0.8, "imports_from_EXTRACTED": 0.8, "calls_EXTRACTED": 0.7, "calls_INFERRED": 0.5,
}
# Languages by file extension.
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "md": "markdown",
}
# Keys whose values logs don't show.
SENSITIVE_KEYS = ["password", "token", "secret", "apikey", "api_key", "authorization", "cookie", "access_token", "refresh_token", "private_key"]
NODE_BUILTINS = ["fs", "path", "os", "http", "https", "crypto", "util", "events", "stream", "url", "child_process", "buffer", "assert", "net", "zlib"]
# Fixed value: the characters that count as Chinese.
CJK = "一-龥"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def mapping(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def js_round(x, digits: int = 0) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(_c(x) * 10.0**digits + 0.5) / 10.0**digits


def latin_tokens(text) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda x: F.length(x) > 1)


def bm25_tokens(text) -> Column:
    """Latin runs of two characters or more; then the CJK characters of the text glued together: terms kept whole, bigrams of the rest."""
    glued = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), f"[^{CJK}]", "")
    terms, rest = [], glued
    for t in TECH_TERMS:
        terms.append(F.array_repeat(F.lit(t), F.regexp_count(rest, F.lit(t))))
        rest = F.regexp_replace(rest, t, "")
    bigrams = F.when(F.length(rest) > 1, F.transform(F.sequence(F.lit(1), F.length(rest) - 1), lambda i: F.substring(rest, i, F.lit(2)))).otherwise(lits([]))
    return F.when(has_cjk(text), F.concat(latin_tokens(text), *terms, bigrams)).otherwise(latin_tokens(text))


def has_cjk(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return (F.octet_length(t) != F.char_length(t)) & t.rlike(f"[{CJK}]")


def bm25_length(text) -> Column:
    """The number of bm25_tokens; no array is made for texts without CJK characters."""
    plain = F.regexp_count(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]{2,}"))
    return F.when(has_cjk(text), F.size(bm25_tokens(text))).otherwise(plain)


def bm25_count(text, term: str) -> Column:
    """How often a term is among the bm25_tokens. Latin terms are counted in place."""
    if re.fullmatch("[a-z0-9]{2,}", term):
        low = F.lower(F.coalesce(_c(text), F.lit("")))
        return F.when(low.contains(term), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)
    return F.size(F.filter(bm25_tokens(text), lambda x: x == term))


def trie_tokens(text) -> Column:
    """Index words: markup and punctuation blanked, split at blanks, two characters or more, with the pieces around _ and -."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    # what stays between blanks are the longest runs of these characters
    words = F.regexp_extract_all(low, F.lit(f"[A-Za-z0-9{CJK}-]{{2,}}"), F.lit(0))
    pieces = F.flatten(F.transform(F.filter(words, lambda w: w.contains("-")), lambda w: F.split(w, "-+")))
    return F.array_distinct(F.when(low.contains("-"), F.filter(F.concat(words, pieces), lambda x: F.length(x) >= 2)).otherwise(words))


def eval_terms(text, stop_words=()) -> Column:
    """Distinct terms for coverage: stop words go before lower-casing."""
    words = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^一-鿿㐀-䶿a-zA-Z0-9_\-\s]", " "), r"\s+")
    kept = F.filter(words, lambda t: (F.length(t) >= 2) & (~t.isin(list(stop_words)) if stop_words else F.lit(True)))
    return F.array_distinct(F.transform(kept, F.lower))


def estimate_tokens(text) -> Column:
    """A quarter token a character, 1.5 a CJK or kana character, rounded up."""
    t = F.coalesce(_c(text), F.lit(""))
    wide = F.regexp_count(t, F.lit("[一-鿿぀-ゟ゠-ヿ]"))
    return F.ceil((F.length(t) - wide) / 4 + wide * 1.5).cast("long")


def estimate_tokens_by_code_point(text) -> Column:
    """Half a token above U+2FFF, a quarter below, rounded up."""
    t = F.coalesce(_c(text), F.lit(""))
    wide = F.regexp_count(t, F.lit(r"[^\x{0}-\x{2FFF}]"))
    return F.ceil(F.length(t) * 0.25 + wide * 0.25).cast("long")


# Fixed value: the syntax of links.
LINK = r"(!?)\[\[(.+?)(?:/(.+?))?(?:\|(.+?))?\]\]"


def wiki_links(text) -> Column:
    """[[target]], [[entity/target|label]], ![[embed]] as array<struct<target, entity_id, label, is_embed>>."""
    t = F.coalesce(_c(text), F.lit(""))
    group = lambda i: F.regexp_extract_all(t, F.lit(LINK), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("bang"), group(2).alias("a"), group(3).alias("b"), group(4).alias("label"))
    some = lambda x: F.nullif(x, F.lit(""))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.coalesce(some(z["b"]), z["a"]).alias("target"), F.when(some(z["b"]).isNotNull(), z["a"]).alias("entity_id"), some(z["label"]).alias("label"), (z["bang"] == "!").alias("is_embed")
        ),
    )


def link_targets(text) -> Column:
    """What stands between [[ and the next | or ]], trimmed."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\[\[([^\]|]+)"), 1), lambda x: F.trim(x))


def start_line(location) -> Column:
    one = F.regexp_extract(_c(location), r"^L(\d+)$", 1)
    many = F.regexp_extract(_c(location), r"^LL(\d+)-(\d+)$", 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(many, F.lit(""))).cast("int")


def end_line(location) -> Column:
    return F.nullif(F.regexp_extract(_c(location), r"^LL(\d+)-(\d+)$", 2), F.lit("")).cast("int")


def atom_type(label) -> Column:
    x = _c(label)
    return F.when(x.endswith("()"), "function").when(x.rlike("^[A-Z]") & ~x.contains("("), "class").otherwise("function")


def language(path, sources_only: bool = False) -> Column:
    """The language of a file by its ending; sources_only knows .mts and .cts and leaves out .md and .jsx."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    known = {k: v for k, v in LANGUAGES.items() if k not in ("md", "jsx")} | {"mts": "typescript", "cts": "typescript"} if sources_only else LANGUAGES
    return F.coalesce(F.try_element_at(mapping(known), ext), F.lit("unknown"))


def edge_weight(relation, confidence) -> Column:
    key = F.concat_ws("_", _c(relation), F.coalesce(_c(confidence), F.lit("EXTRACTED")))
    return F.coalesce(F.try_element_at(mapping(EDGE_WEIGHTS), key), F.lit(0.5))


def short_hash(text) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def node_hash(label, source_file, source_location, file_type, community, norm_label) -> Column:
    """Hash of a graph node's fields; absent label and file read as 'undefined', other absent fields as ''."""
    parts = [F.coalesce(_c(x).cast("string"), F.lit(d)) for x, d in ((label, "undefined"), (source_file, "undefined"), (source_location, ""), (file_type, ""), (community, ""), (norm_label, ""))]
    return short_hash(F.concat_ws("|", *parts))


def symbols_hash(names) -> Column:
    return F.when(F.size(_c(names)) > 0, short_hash(F.array_join(F.array_sort(_c(names)), ","))).otherwise("empty")


def normalised_tags(tags) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(tags), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def metadata(text) -> Column:
    """**Tags**, **Type** and **Project** lines as struct<tags, type, project>."""
    t = F.coalesce(_c(text), F.lit(""))
    get = lambda p: F.nullif(F.lower(F.trim(F.regexp_extract(t, p, 1))), F.lit(""))
    tags = F.filter(F.transform(F.split(F.coalesce(get(r"(?i)\*\*Tags\*\*:\s*([^\n]+)"), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(tags.alias("tags"), F.coalesce(get(r"(?i)\*\*Type\*\*:\s*(\w+)"), F.lit("general")).alias("type"), F.coalesce(get(r"(?i)\*\*Project\*\*:\s*([^\n]+)"), F.lit("global")).alias("project"))


def metadata_keywords(text) -> Column:
    """The words that metadata lines add to an index: tags, the type, and the index words of the project, two characters or more. A word that is named twice comes twice; absent lines add none."""
    t = F.coalesce(_c(text), F.lit(""))
    get = lambda p: F.regexp_extract(t, p, 1)
    tags = F.transform(F.split(F.lower(get(r"(?i)\*\*Tags\*\*:\s*([^\n]+)")), "[,;]"), lambda x: F.trim(x))
    words = F.concat(tags, F.array(F.lower(get(r"(?i)\*\*Type\*\*:\s*(\w+)"))), trie_tokens(get(r"(?i)\*\*Project\*\*:\s*([^\n]+)")))
    return F.filter(words, lambda x: F.length(x) >= 2)


def rewritten_query(query, mode) -> Column:
    q, cjk = _c(query), F.regexp_replace(_c(query), f"[^{CJK}]", "")
    spaced = F.trim(F.regexp_replace(cjk, "(.)", "$1 "))
    latin = F.regexp_extract_all(q, F.lit("[a-zA-Z0-9._]+"), 0)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), lits(v))])
    more = F.try_element_at(table, F.lower(F.get(words, 0)))
    wide = F.when(more.isNotNull(), F.array_join(F.array_distinct(F.concat(words, more)), " ")).otherwise(q)
    return (
        F.when(_c(mode) == "vector", q)
        .when(F.length(cjk) > 0, F.when(F.size(latin) > 0, F.concat_ws(" ", F.array_join(latin, " "), spaced)).otherwise(spaced))
        .when((_c(mode) == "keyword") | (F.size(words) >= 3), q)
        .otherwise(wide)
    )


def project_of_git_url(url) -> Column:
    m = lambda i: F.regexp_extract(_c(url), r"[/:]([^/:]+)/([^/]+?)(?:\.git)?/?$", i)
    return F.when(m(1) != "", F.concat(F.lit("@"), m(1), F.lit("/"), m(2)))


def project_of_path(path) -> Column:
    return F.concat(F.element_at(F.split(F.rtrim(_c(path), F.lit("/")), "/"), -1), F.lit("-"), F.substring(F.md5(_c(path)), 1, 8))


def project_id(config=None, git_url=None, package=None, path=None, mapped=None) -> Column:
    """The first that there is of: the configured id, the remote's, the package's name, the path's, the folder's own name, a mapping's."""
    none = F.lit(None).cast("string")
    at = lambda x: none if x is None else F.nullif(_c(x), F.lit(""))
    own = none if path is None else F.element_at(F.split(F.rtrim(_c(path), F.lit("/")), "/"), -1)
    # Folders whose names say nothing.
    own = F.when(~own.isin("src", "dist", "build", "test", "docs"), own)
    return F.coalesce(at(config), none if git_url is None else project_of_git_url(git_url), at(package), none if path is None else F.when(at(path).isNotNull(), project_of_path(path)), own, at(mapped))


def one_line(text) -> Column:
    """Abstract and overview of an entry's text on one line, joined by ` | `; without either the text itself, without frontmatter."""
    body = strip_frontmatter(F.coalesce(_c(text), F.lit("")))
    a, o = (F.regexp_replace(section(body, n), "\n", " ") for n in ("Abstract", "Overview"))
    both = F.concat_ws(" | ", F.nullif(a, F.lit("")), F.nullif(o, F.lit("")))
    return F.when(both != "", both).otherwise(F.trim(F.regexp_replace(body, "\n", " ")))


def redacted(fields) -> Column:
    return F.transform_values(_c(fields), lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(v))


def date_of_path(path) -> Column:
    part = lambda i: F.regexp_extract(_c(path), r"timeline/(\d{4})/(\d{2})/(\d{2})/", i)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(1), part(2), part(3))))


def health_grade(score) -> Column:
    s = _c(score)
    return F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def file_grade(score) -> Column:
    s = _c(score)
    return F.when(s >= 90, "A").when(s >= 70, "B").when(s >= 50, "C").otherwise("D")


def dependency_kind(module, language=None) -> Column:
    """builtin, internal or external. Without a language, and for JavaScript, by Node's modules; else by the rules of the language's standard library."""
    m = _c(module)
    node = m.startswith("node:") | m.isin(NODE_BUILTINS)
    plain = F.when(node, "builtin").when(m.startswith(".") | m.startswith("/"), "internal").otherwise("external")
    if language is None:
        return plain
    first = lambda mark: F.substring_index(m, mark, 1)
    lang = _c(language)
    standard = (
        F.when(lang == "python", first(".").isin(sorted(sys.stdlib_module_names)) & ~m.startswith(".")).when(lang == "go", ~m.startswith(".") & ~first("/").contains("."))
        .when(lang == "rust", first("::").isin("std", "core", "alloc")).when(lang == "java", first(".").isin("java", "javax", "javafx")).otherwise(False)
    )
    other = F.when(standard, "builtin").when(m.startswith(".") | m.contains("/"), "internal").otherwise("external")
    return F.when(lang.isin("javascript", "typescript", "unknown"), plain).otherwise(other)


def cron_interval_ms(cron) -> Column:
    """*/m in the minutes or */h in the hours; anything else is a day."""
    p = F.split(F.trim(_c(cron)), r"\s+")
    n = lambda i: F.nullif(F.regexp_extract(F.get(p, i), r"^\*/(\d+)$", 1), F.lit("")).cast("long")
    return F.when(F.size(p) < 5, F.lit(86_400_000)).otherwise(F.coalesce(n(0) * 60_000, n(1) * 3_600_000, F.lit(86_400_000))).cast("long")


# Fixed value: the alphabet of sortable ids.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def sortable_id(millis, *row) -> Column:
    """26 characters: ten for the time and sixteen from a hash of the row, so that a retry gives the same id."""
    digit = lambda x, n: F.substring(F.lit(BASE32), (F.shiftrightunsigned(x, n).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    time = [digit(_c(millis).cast("long"), 5 * i) for i in range(9, -1, -1)]
    tail = [digit(h, 5 * i) for h in (F.xxhash64(*row), F.xxhash64(F.lit(1), *row)) for i in range(8)]
    return F.concat(*time, *tail)


def retry_delay(attempt, base: float, draw) -> Column:
    """2^attempt x base x a number of 0.5 to 1; draw is uniform from 0 to 1."""
    return F.pow(F.lit(2.0), _c(attempt)) * base * (0.5 + 0.5 * _c(draw))


def reconnect_delay(attempt, base: float, most: float, draw) -> Column:
    """At most `most`, and up to a second more."""
    return F.least(base * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(float(most))) + 1000 * _c(draw)


def line_of_offset(text, offset) -> Column:
    return F.regexp_count(F.substring(_c(text), F.lit(1), _c(offset)), F.lit("\n")) + 1


def column_of_offset(text, offset) -> Column:
    return F.length(F.substring_index(F.substring(_c(text), F.lit(1), _c(offset)), "\n", -1))


def word_overlap(a, b) -> Column:
    """The share of a's words (two characters or more) that are among b's."""
    wa, wb = (F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: F.length(w) > 1) for x in (a, b))
    return F.when(F.size(wa) > 0, F.size(F.filter(wa, lambda w: F.array_contains(wb, w))) / F.size(wa)).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(_c(a), _c(b)) / F.sqrt(dot(_c(a), _c(a)) * dot(_c(b), _c(b)))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def frontmatter(text) -> Column:
    """key: value lines between the first two --- lines; split at the first colon; lines without one are passed over."""
    block = F.regexp_extract(_c(text), r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def strip_frontmatter(text) -> Column:
    return F.regexp_replace(_c(text), r"(?s)^---\n.*?\n---\n*", "")


def section(text, name: str) -> Column:
    """The fenced section under the heading `# ≡≡≡ name ≡≡≡`, trimmed; '' if absent. Atoms are fenced as json."""
    fence = "```json" if name == "Atoms" else "```"
    return F.trim(F.regexp_extract(_c(text), rf"(?s)# ≡≡≡ {name} ≡≡≡\n{fence}\n(.*?)\n?```", 1))


def markdown_entry(row: dict[str, Column]) -> Column:
    """An entry's file: frontmatter and sections."""
    get = lambda k, d: F.coalesce(row[k].cast("string"), F.lit(d)) if k in row else F.lit(d)
    fields = [("id", ""), ("date", ""), ("type", ""), ("tags", ""), ("project", ""), ("memory_id", "pending"), ("source_id", ""), ("synced", "false"), ("synced_at", "null"), ("meta", "[]")]
    lines = [F.concat(F.lit(f"{k}: " + ("[" if k == "tags" else "")), get(k, d), F.lit("]" if k == "tags" else "")) for k, d in fields]
    parts = [F.concat(F.lit(f"\n# ≡≡≡ {title} ≡≡≡\n```\n"), get(k, ""), F.lit("\n```")) for title, k in (("Abstract", "abstract"), ("Overview", "overview"), ("Contents", "content"))]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), *parts, F.lit("\n---\n"))


def fractional_index(previous: str | None, following: str | None) -> str:
    """A sort key between two others."""
    if previous is None and following is None:
        return "a0"
    if following is None:
        return previous + "0"
    if previous is None:
        half = ord(following[0]) // 2
        return "a0" if half < 32 or half == 127 else chr(half) + "0"
    same = next((i for i, (x, y) in enumerate(zip(previous, following)) if x != y), None)
    if same is not None:
        half = (ord(previous[same]) + ord(following[same])) // 2
        return previous + "V" if half == ord(previous[same]) else previous[:same] + chr(half)
    if len(previous) < len(following) and (half := (97 + ord(following[len(previous)])) // 2) > 97:
        return previous + chr(half)
    return previous + "V"
