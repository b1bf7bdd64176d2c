"""A project's code as knowledge: symbol tables, entries, atoms and references of analysed files, whole-project load and report.

Everything starts from operators.code.analysed, one row a file; all that follows are joins on names and paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import code as C
from tessera.operators import graph as G
from tessera.operators import quality as Q


def symbol_table(analysis: DataFrame) -> DataFrame:
    """(name, path, kind, start_line, id): the first definition of a name, by path and line."""
    first = F.min(F.struct("path", "start_line", "kind", "id")).alias("m")
    return C.symbols(analysis).groupBy("name").agg(first).select("name", "m.path", "m.kind", "m.start_line", "m.id")


def merged(table: DataFrame, new: DataFrame) -> DataFrame:
    """Names that the table holds stay as they are; others come from new."""
    return table.unionByName(new.join(table.select("name"), "name", "left_anti").select(*table.columns))


def replaced(table: DataFrame, new: DataFrame) -> DataFrame:
    """The last write wins: new replaces names that the table holds."""
    return table.join(new.select("name"), "name", "left_anti").select(*new.columns).unionByName(new)


def invalidated(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the symbols of changed files (path)."""
    return table.join(paths.select("path"), "path", "left_anti").select(*table.columns)


def lookup(table: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(table, "name", "left")


def of_batch(rows: DataFrame, batch: DataFrame, path: str = "path") -> DataFrame:
    """Symbols or relations of the files of one batch (path)."""
    return rows.join(batch.select(F.col("path").alias(path)), path, "left_semi")


def aliased(imports: DataFrame, alias: str = "@/", folder: str = "src") -> DataFrame:
    """imports (from_path, module), in which modules under an alias are paths relative to the importer."""
    up = F.repeat(F.lit("../"), F.size(F.split("from_path", "/")) - 1)
    tail = F.substring("module", len(alias) + 1, 1 << 20)
    return imports.withColumn("module", F.when(F.col("module").startswith(alias), F.concat(F.lit("./"), up, F.lit(f"{folder}/"), tail)).otherwise(F.col("module")))


def aliased_by(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """(from_path, module, target): modules under an alias as paths from the root. patterns: n, alias, target; of several that fit the least n counts.

    An alias that ends in `/*` stands for what is below it, any other for itself and what is below it. A module meets the patterns by its own
    beginnings, cut at slashes, so patterns may be many.
    """
    wild = F.col("alias").endswith("/*")
    p = patterns.select("n", wild.alias("wild"), F.regexp_replace("alias", r"/\*$", "").alias("beginning"), F.when(wild, F.regexp_replace("target", r"/\*$", "")).otherwise(F.col("target")).alias("base"))
    parts = F.split("module", "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    m = imports.select("from_path", "module").distinct().withColumn("beginning", F.explode(cuts))
    rest = F.substring(F.col("module"), F.length("beginning") + 1, F.length("module"))
    met = m.join(p, "beginning").where(~F.col("wild") | (rest != ""))
    return met.groupBy("from_path", "module").agg(F.min_by(F.concat("base", rest), "n").alias("target"))


def resolved_modules(imports: DataFrame, patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, module, to_path): relative modules against the importer's folder, aliased ones by their patterns; the first ending that exists."""
    tries = aliased_by(imports, patterns).select("from_path", "module", F.posexplode(F.array(*[F.concat("target", F.lit(s)) for s in G.SUFFIXES])).alias("n", "path"))
    far = tries.join(files.select("path").distinct(), "path").groupBy("from_path", "module").agg(F.min_by("path", "n").alias("to_path"))
    return G.resolved_imports(imports, files).unionByName(far)


def records(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities: id, language, abstract, overview; atoms: id, entity_id, name, type, start_line, end_line) of files."""
    entities = analysis.select("path", "language").join(C.overview(analysis), "path").select(F.col("path").alias("id"), "language", "abstract", "overview")
    atoms = C.symbols(analysis).select("id", F.col("path").alias("entity_id"), "name", F.col("kind").alias("type"), "start_line", "end_line")
    return entities, atoms


def upload_rows(analysis: DataFrame) -> DataFrame:
    """What is uploaded of a file: path, language, lines, functions, classes, imports, complexity; a file that couldn't be parsed has none and complexity 1."""
    count = lambda kind: F.size(F.filter("symbols", lambda s: s["kind"] == kind))
    return analysis.select("path", "language", "lines", count("function").alias("functions"), count("class").alias("classes"), F.size("imports").alias("imports"), "complexity")


def references(analysis: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Edges of files: contains, calls between symbols, extends and implements, depends_on. Callers and targets are symbols by name; those of a file come before the table's."""
    symbols = C.symbols(analysis)
    table = table if table is not None else symbol_table(analysis)
    contains = symbols.select(F.col("path").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    own = symbols.groupBy("path", "name").agg(F.min_by("id", "start_line").alias("own_id"))
    calls = C.calls(analysis).join(own.select("path", F.col("name").alias("caller"), F.col("own_id").alias("from_id")), ["path", "caller"])
    target = F.element_at(F.split("target", r"\.|::"), -1)
    near = calls.withColumn("name", target).join(own, ["path", "name"], "left").join(table.select("name", F.col("id").alias("far_id")), "name", "left")
    called = near.select("from_id", F.coalesce("own_id", "far_id").alias("to_id"), F.lit("calls").alias("type"), F.lit(0.7).alias("weight")).where("to_id IS NOT NULL").distinct()
    classes = symbols.where("kind IN ('class', 'interface')").select("id", "name", "super_class", "implements")
    resolved = G.resolved_imports(C.imports(analysis).where("kind = 'internal'"), analysis.select("path"))
    none = analysis.select(F.lit("").alias("from_id"), F.lit("").alias("to_id"), F.lit("").alias("type")).limit(0)
    return contains.unionByName(called).unionByName(G.inheritance(classes)).unionByName(G.depends_on(resolved, none))


def loaded(files: DataFrame, analysed=C.analysed) -> dict[str, DataFrame]:
    """A whole project from its files (path, text): analysis, symbols, entities, atoms, references. analysed: code.analysed, or structure.analysed for braced languages."""
    analysis = G.stored(analysed(files))  # files are parsed once for all that is made of them
    entities, atoms = records(analysis)
    return {"analysis": analysis, "symbols": symbol_table(analysis), "entities": entities, "atoms": atoms, "references": references(analysis)}


def file_measures(analysis: DataFrame) -> DataFrame:
    """(path, language, lines, functions, complexity, nesting, worst) of files."""
    per = C.rollup(analysis).select("path", "functions", F.col("cyclomatic").alias("complexity"), F.col("max_nesting_depth").alias("nesting"), F.col("max_function_complexity").alias("worst"))
    filled = per.columns[1:]
    return analysis.select("path", "language", "lines").join(per, "path", "left").fillna(0, filled)


def report(analysis: DataFrame) -> DataFrame:
    """Totals and grade of a project."""
    return Q.project_metrics(file_measures(analysis))


def incremental_import(nodes: DataFrame, links: DataFrame, old_nodes: DataFrame, old_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after an incremental import: (nodes: id, hash; links: source, target, relation).

    Removed nodes go with every link that touches them; added and changed nodes are made anew, and links that touch a changed node
    are taken from the new graph; others stay as they were.
    """
    from tessera.operators import sync as Y

    change = Y.node_diff(old_nodes, nodes)
    kept = old_nodes.join(change.where("change = 'unchanged'"), "id", "left_semi").select("id", "hash")
    now = kept.unionByName(nodes.join(change.where("change IN ('added', 'changed')"), "id", "left_semi").select("id", "hash"))
    keys = ["source", "target", "relation"]
    lost = change.where("change IN ('removed', 'changed')").select("id")
    stay = old_links.join(lost.withColumnRenamed("id", "source"), "source", "left_anti").join(lost.withColumnRenamed("id", "target"), "target", "left_anti").select(*keys)
    gone = Y.link_diff(old_links, links).where("change = 'removed'").select(*keys)
    stay = stay.join(gone, keys, "left_anti")
    made = Y.remappable(links.select(*keys), change.where("change = 'changed'").select("id")).unionByName(Y.link_diff(old_links, links).where("change = 'added'").select(*keys))
    ends = now.select(F.col("id").alias("source"))
    all_ = stay.unionByName(made).distinct().join(ends, "source", "left_semi").join(ends.withColumnRenamed("source", "target"), "target", "left_semi").select(*keys)
    return now, all_
