"""Source-code analytics (C1-C14): symbols, calls, imports, complexity and nesting of Python and C-like sources.

Parsing has no column expression, so files go through mapInPandas, one row a file; everything after that is DataFrame work.
Python is parsed by its own grammar. JavaScript, TypeScript, Go, Rust and Java are scanned line by line by rules of their own, with
strings and comments blanked; a file that can't be parsed gives a row without symbols and complexity 1.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import retrieval as R
from tessera.shipping import ship

ship(__name__)

SYMBOLS = "array<struct<name:string,kind:string,start_line:int,end_line:int,complexity:int,nesting:int,super_class:string,implements:array<string>,signature:string>>"
SCHEMA = f"path string, language string, lines int, symbols {SYMBOLS}, calls array<struct<caller:string,target:string,line:int>>, imports array<string>, complexity int, nesting int"

# Calls that say nothing about a project.
BUILTIN_CALLS = [
    "console.log", "console.error", "console.warn", "console.info", "console.debug", "Array.isArray", "Array.from", "Array.of", "Object.keys", "Object.values", "Object.entries", "Object.assign",
    "Object.create", "Object.freeze", "Object.seal", "Math.max", "Math.min", "Math.random", "Math.floor", "Math.ceil", "Math.round", "Math.abs", "Math.pow", "Math.sqrt", "String.fromCharCode",
    "String.raw", "Number.parseInt", "Number.parseFloat", "Number.isNaN", "Number.isFinite", "Number.isInteger", "Promise.all", "Promise.allSettled", "Promise.race", "Promise.resolve",
    "Promise.reject", "JSON.parse", "JSON.stringify",
]
DEEPER = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def python_complexity(node) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case)):
            n += 1 + (1 if isinstance(x, ast.Try) and x.finalbody else 0)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def python_nesting(node, depth: int = 0) -> int:
    return max([depth, *(python_nesting(c, depth + isinstance(c, DEEPER)) for c in ast.iter_child_nodes(node))])


def dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def python_file(text: str):
    tree = ast.parse(text)
    symbols, calls, imports = [], [], []

    def visit(node, owner):
        for c in ast.iter_child_nodes(node):
            name = owner
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = c.name
                sign = f"{c.name}({', '.join(a.arg for a in c.args.args)})"
                symbols.append((c.name, "function", c.lineno, c.end_lineno, python_complexity(c), python_nesting(c), None, [], sign))
            elif isinstance(c, ast.ClassDef):
                name = c.name
                bases = [b for b in map(dotted, c.bases) if b]
                symbols.append((c.name, "class", c.lineno, c.end_lineno, 1, 0, bases[0] if bases else None, bases[1:], c.name))
            elif isinstance(c, ast.Import):
                imports.extend(a.name for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                imports.append("." * c.level + (c.module or ""))
            elif isinstance(c, ast.Call) and (t := dotted(c.func)):
                calls.append((owner, t, c.lineno))
            visit(c, name)

    visit(tree, "<module>")
    return symbols, calls, imports, python_complexity(tree), python_nesting(tree)


NAME = r"([A-Za-z_$][\w$]*)"
BASES = r"(?:\s*<[^>{]*>)?(?:\s+extends\s+([\w.$]+)(?:<[^>{]*>)?)?(?:\s+implements\s+([\w.$,\s<>]+?))?\s*(?:\{|$)"
METHOD = rf"^\s*(?:(?:public|private|protected|static|async|final|abstract|override|synchronized|get|set|readonly)\s+)*(?:<[^>]*>\s+)?(?!(?:if|for|while|switch|catch|return|else|new|do|try)\b)(?:[\w<>\[\],.?]+\s+)?{NAME}\s*(?:<[^>(]*>)?\(([^)]*)\)\s*(?::\s*[\w<>\[\]|., ]+\s*)?(?:throws\s+[\w,\s.]+)?\{{"
ARROW = rf"\b(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"
#: What begins a class and a function, line by line, and what imports, by language. Classes: (word, name, base, interfaces); functions: (name, arguments).
SCRIPT = (
    [re.compile(rf"\b(class|interface)\s+{NAME}{BASES}")], [re.compile(rf"\bfunction\s*\*?\s*{NAME}\s*(?:<[^>(]*>)?\(([^)]*)"), re.compile(ARROW), re.compile(METHOD)],
    re.compile(r"""\b(?:import|export)\b[^'"\n;]*?\bfrom\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]|\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)""", re.M),
)
RULES = {
    "go": ([re.compile(rf"^\s*(?P<name>type\s+)?{NAME}\s+(struct|interface)\b")], [re.compile(rf"^func\s+(?:\([^)]*\)\s*)?{NAME}\s*(?:\[[^\]]*\])?\(([^)]*)")], re.compile(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""", re.M)),
    "rust": ([re.compile(rf"\b(struct|enum|trait)\s+{NAME}")], [re.compile(rf"\bfn\s+{NAME}\s*(?:<[^>(]*>)?\(([^)]*)")], re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)", re.M)),
    "java": ([re.compile(rf"\b(class|interface|enum|record)\s+{NAME}{BASES}")], [re.compile(METHOD)], re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)", re.M)),
}
BRANCH = re.compile(r"\b(?:if|for|while|catch|case)\b|\?(?![.?:])|&&|\|\|")
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)!?\s*\(")
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "super", "import", "require", "typeof", "await", "new", "match", "do", "else", "try", "sizeof", "struct", "interface", "type", "var", "const", "let"}
BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def class_of(line: str, patterns: list, n: int):
    """[name, kind, line, base, interfaces, signature, complexity] of a class that begins in the line."""
    for pattern in patterns:
        if not (m := pattern.search(line)):
            continue
        if pattern.groupindex:  # the word follows the name
            word, name, base, more = m[3], m[2], None, None
            if not m["name"]:
                continue
        else:
            word, name, base, more = m[1], m[2], *((m[3], m[4]) if pattern.groups > 2 else (None, None))
        kind = "interface" if word in ("interface", "trait") else "class"
        return [name, kind, n, base, [re.sub(r"<.*", "", x).strip() for x in (more or "").split(",") if x.strip()], name, 1]
    return None


def braced_file(text: str, language: str = "javascript"):
    classes, functions, importing = RULES.get(language, SCRIPT)
    imports = [next(g for g in (m if isinstance(m, tuple) else (m,)) if g) for m in importing.findall(text)]
    code = BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    symbols, calls, open_, depth, deepest, total = [], [], [], 0, 0, 1
    for n, line in enumerate(code.split("\n"), 1):
        started = class_of(line, classes, n)
        if not started and (m := next((m for f in functions if (m := f.search(line))), None)):
            started = [m[1], "function", n, None, [], f"{m[1]}({(m[2] or '').strip()})", 1]
        branches = len(BRANCH.findall(line))
        total += branches
        owner = next((o for o, _, _ in reversed(open_) if o[1] == "function"), None)
        for m in CALL.finditer(line):
            if m[1] not in NOT_CALLS and not (started and m[1] == started[0]):
                calls.append(((started if started and started[1] == "function" else owner or ["<module>"])[0], m[1], n))
        if started:
            open_.append((started, depth, [0]))
        for o, _, _ in open_:
            o[6] += branches if o[1] == "function" else 0
        for ch in line:
            if ch == "{":
                depth += 1
                deepest = max(deepest, depth)
                for _, at, low in open_:
                    low[0] = max(low[0], depth - at - 1)
            elif ch == "}":
                depth = max(0, depth - 1)
                while open_ and depth <= open_[-1][1]:
                    o, _, low = open_.pop()
                    symbols.append((o[0], o[1], o[2], n, o[6], low[0], o[3], o[4], o[5]))
    for o, _, low in open_:
        symbols.append((o[0], o[1], o[2], o[2], o[6], low[0], o[3], o[4], o[5]))
    return sorted(symbols, key=lambda s: s[2]), calls, imports, total, deepest


def analyse(path: str, language: str, text: str) -> tuple:
    lines = text.count("\n") + 1
    try:
        s, c, i, x, d = python_file(text) if language == "python" else braced_file(text, language)
    except (SyntaxError, ValueError, RecursionError):
        s, c, i, x, d = [], [], [], 1, 0
    builtins = set(BUILTIN_CALLS)
    seen, first = set(), []
    for y in s:
        if (y[0], y[2]) not in seen:
            seen.add((y[0], y[2]))
            first.append(y)
    names = ["name", "kind", "start_line", "end_line", "complexity", "nesting", "super_class", "implements", "signature"]
    return path, language, lines, [dict(zip(names, y)) for y in first], [dict(zip(("caller", "target", "line"), y)) for y in c if y[1] not in builtins], i, x, d


def analysed(files: DataFrame) -> DataFrame:
    """files: path, text. One row a file."""

    def work(frames):
        for f in frames:
            rows = [analyse(p, lang, t) for p, lang, t in zip(f["path"], f["language"], f["text"])]
            yield pd.DataFrame(rows, columns=["path", "language", "lines", "symbols", "calls", "imports", "complexity", "nesting"])

    return files.select("path", S.language("path").alias("language"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(work, SCHEMA)


def symbols(analysis: DataFrame) -> DataFrame:
    return analysis.select("path", F.inline("symbols")).withColumn("id", F.concat_ws("#", "path", "name", "start_line"))


def distinct_definitions(found: DataFrame, order: list[str]) -> DataFrame:
    """found: path, name, start_line and more, of several passes over a file: of one name and line the first in the order counts."""
    return R.keep_first(found, ["path", "name", "start_line"], order)


def calls(analysis: DataFrame) -> DataFrame:
    return analysis.select("path", F.inline("calls"))


def imports(analysis: DataFrame) -> DataFrame:
    found = analysis.select(F.col("path").alias("from_path"), "language", F.explode("imports").alias("module"))
    return found.select("from_path", "module", S.dependency_kind("module", "language").alias("kind"))


def rollup(analysis: DataFrame) -> DataFrame:
    """Per file: rounded mean and greatest complexity of functions, mean and greatest nesting."""
    f = symbols(analysis).where("kind = 'function'")
    return f.groupBy("path").agg(S.js_round(F.avg("complexity")).cast("int").alias("cyclomatic"), F.max("complexity").alias("max_function_complexity"), S.js_round(F.avg("nesting"), 1).alias("avg_nesting"), F.max("nesting").alias("max_nesting_depth"), F.count("*").alias("functions"))


def overview(analysis: DataFrame) -> DataFrame:
    """Abstract and overview texts of a file."""
    names = F.transform("symbols", lambda s: s["name"])
    return analysis.select("path", F.format_string("%s file %s: %d symbols, %d lines", "language", "path", F.size("symbols"), "lines").alias("abstract"), F.array_join(F.slice(names, 1, 10), ", ").alias("overview"))


# Patterns of the declarative mode, by language and capture.
PATTERNS = {
    "python": {"function": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "class": r"(?m)^\s*class\s+(\w+)", "import": r"(?m)^\s*(?:from|import)\s+([\w.]+)"},
    "go": {"function": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"(?m)^type\s+(\w+)\s+struct", "import": r'(?m)^\s*(?:import\s+)?"([\w./-]+)"'},
    "rust": {"function": r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "class": r"(?m)^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", "import": r"(?m)^\s*use\s+([\w:]+)"},
    "java": {"function": r"(?m)^\s*(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\]]+\s+(\w+)\s*\(", "class": r"(?m)\b(?:class|interface|enum)\s+(\w+)", "import": r"(?m)^\s*import\s+([\w.]+)"},
    "javascript": {"function": r"(?m)\bfunction\s+(\w+)", "class": r"(?m)\bclass\s+(\w+)", "import": r"""(?m)\bfrom\s+['"]([^'"]+)['"]"""},
}


def captured(files: DataFrame, languages: dict | None = None) -> DataFrame:
    """(path, capture, name) by patterns alone, in the JVM: no parse, and any language that has patterns."""
    f = files.withColumn("language", S.language("path"))
    none = F.array().cast("array<struct<capture:string,name:string>>")
    found = none
    for lang, patterns in (languages or PATTERNS).items():
        own = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), _named(capture)) for capture, p in patterns.items()])
        found = F.when(F.col("language") == lang, own).otherwise(found)
    return f.select("path", F.inline(found))


def _named(capture: str):
    return lambda x: F.struct(F.lit(capture).alias("capture"), x.alias("name"))


def import_names(text) -> F.Column:
    """The imports of a script as array<struct<source, names, namespace, is_default>>: `import a, { b, c as d } from 'x'`, `import * as n from 'y'`."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = r"""import\s+(?:type\s+)?([\w$*{][^'";]*?)\s+from\s*['"]([^'"]+)['"]"""
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("what"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("source"))
    some = lambda what, p: F.nullif(F.regexp_extract(what, p, 1), F.lit(""))
    listed = lambda what: F.filter(F.transform(F.split(F.coalesce(some(what, r"\{([^}]*)\}"), F.lit("")), ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+.*$", ""))), lambda n: n != "")
    return F.transform(pairs, lambda p: F.struct(p["source"].alias("source"), listed(p["what"]).alias("names"), some(p["what"], r"\*\s+as\s+([\w$]+)").alias("namespace"), some(p["what"], r"^([\w$]+)").isNotNull().alias("is_default")))


def jsdoc(text) -> F.Column:
    """The first /** */ block: description, params and what it returns."""
    t = F.col(text) if isinstance(text, str) else text
    block = F.regexp_replace(F.regexp_extract(t, r"(?s)/\*\*(.*?)\*/", 1), r"(?m)^\s*\*\s?", "")
    about = F.trim(F.regexp_replace(F.regexp_extract(block, r"(?s)^(.*?)(?:@|$)", 1), r"\s+", " "))
    names = F.regexp_extract_all(block, F.lit(r"@param\s+(?:\{[^}]*\}\s+)?\[?(\w+)"), 1)
    back = F.nullif(F.trim(F.regexp_extract(block, r"@returns?\s+(?:\{[^}]*\}\s*)?([^\n@]*)", 1)), F.lit(""))
    return F.struct(about.alias("description"), names.alias("params"), back.alias("returns"))
