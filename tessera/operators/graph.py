"""Property graph: edges (from_id, to_id, type, weight), neighbours, traversal, components, degrees, import."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# Relation types that count as valid.
VALID_TYPES = ["depends_on", "blocks", "calls", "imports", "implements", "relates_to", "wiki_link", "part_of", "related", "contains"]

#: Rows of a partition that are dealt by key.
TASK_ROWS = 500_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a compressed table in the checkpoint folder, of which later readers take the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many partitions as hold about TASK_ROWS each, which stay as many: what a task keeps doesn't grow with the input.

    Rows of a few numbers are so well compressed in a shuffle that partitions merged by its bytes hold millions of them.
    """
    return rows.repartition(rows.count() // TASK_ROWS + 1, *keys)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge a (from, to, type): the heaviest."""
    return edges.groupBy("from_id", "to_id", "type").agg(F.max("weight").alias("weight"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    known = edges.select("from_id", "to_id", "type")
    return edges.unionByName(distinct_edges(new).join(known, ["from_id", "to_id", "type"], "left_anti"))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those whose columns of gone equal a row of gone; edges are dealt by key to tasks of a bounded number of rows."""
    return dealt(edges, *gone.columns).join(gone, gone.columns, "left_anti")


def neighbours(edges: DataFrame, node, direction: str = "both", type_: str | None = None) -> DataFrame:
    e = edges if type_ is None else edges.where(F.col("type") == type_)
    out = e.where(F.col("from_id") == node).select(F.col("to_id").alias("id"), "type", "weight", F.lit("out").alias("direction"))
    into = e.where(F.col("to_id") == node).select(F.col("from_id").alias("id"), "type", "weight", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def references_of(edges: DataFrame, node, direction: str = "in", limit: int = 50) -> DataFrame:
    """The strongest call references to a node, or dependencies of it: (id, type, weight)."""
    return neighbours(edges, node, direction).drop("direction").orderBy(F.desc("weight"), "id", "type").limit(limit)


def references_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct out-edges of many nodes (id) in one pass: (id, type, weight), id being the edge's start."""
    return edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("id"), "type", "weight").distinct()


def traverse(edges: DataFrame, start: DataFrame, depth: int = 2, directed: bool = True) -> DataFrame:
    """(id, depth): nodes reached within `depth` hops (at most 5) at their least depth. A frontier round joins edges with new nodes only; frontiers are checkpointed."""
    e = edges.select("from_id", "to_id")
    if not directed:
        e = e.union(edges.select("to_id", "from_id"))
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen.select("id")
    for d in range(1, max(1, min(depth, 5)) + 1):
        new = e.join(front, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id")).distinct()
        front = checkpointed(new.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges between nodes reach.

    Rounds of contraction: a node goes to its smallest neighbour, if that is smaller; pointers are doubled until all name the root of their tree; and
    edges become edges of roots, each once. Roots at least halve and most edges fall together in the first round, so all later ones are small.
    Lineage is cut by checkpoint().
    """
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")).distinct())
    left = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b")
    near = checkpointed(_smallest(left))
    if not near.join(labels, "id", "left_anti").isEmpty():  # edges of unknown nodes lead nowhere
        for end in ("a", "b"):
            left = left.join(labels.select(F.col("id").alias(end)), end, "left_semi")
        left = checkpointed(left)
        near = checkpointed(_smallest(left))
    while not near.isEmpty():
        roots = _roots(near.select("id", F.least("id", "m").alias("up")))
        for end in ("a", "b"):
            up = roots.select(F.col("id").alias(end), F.col("up").alias("__up"))
            left = left.join(up, end).drop(end).withColumnRenamed("__up", end).where("a <> b").distinct()
        left = checkpointed(left)
        up = roots.select(F.col("id").alias("component"), "up")
        labels = checkpointed(labels.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        near = checkpointed(_smallest(left))
    return labels


def _smallest(edges: DataFrame) -> DataFrame:
    """(id, m): the smallest neighbour of each end of edges (a, b)."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("m")), F.struct(F.col("b").alias("id"), F.col("a").alias("m"))))
    return edges.select(ends).groupBy("id").agg(F.min("m").alias("m"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, up) with up the root of id's tree, by doubling. pointers: id, up; roots point to themselves."""
    while True:
        far = pointers.select(F.col("id").alias("up"), F.col("up").alias("far"))
        new = checkpointed(pointers.join(far, "up").select("id", F.col("up").alias("old"), F.col("far").alias("up")))
        pointers = new.select("id", "up")
        if new.where("old <> up").isEmpty():
            return pointers


def component_summary(labels: DataFrame, small: int = 3) -> DataFrame:
    """labels: (id, component). Sizes of components: component, size, is_largest (the first of equals), is_small (fewer than `small` nodes)."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    most = sizes.agg(F.max("size").alias("most"))
    first = sizes.join(F.broadcast(most)).where("size = most").agg(F.min("component").alias("largest"))
    return sizes.join(F.broadcast(first)).select("component", "size", (F.col("component") == F.col("largest")).alias("is_largest"), (F.col("size") < small).alias("is_small"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, sigmas: float = 2) -> DataFrame:
    d = degrees(edges)
    s = d.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("s"))
    return d.join(F.broadcast(s)).where(F.col("degree") > F.col("m") + sigmas * F.col("s")).select("id", "degree")


# Below the first a node has too few edges, above the second too many.
FEW, MANY = 2, 20


def linkage_flags(edges: DataFrame, nodes: DataFrame, few: int = FEW, many: int = MANY) -> DataFrame:
    d = nodes.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.withColumn("flag", F.when(F.col("degree") < few, "under").when(F.col("degree") > many, "over").otherwise("ok"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_anti")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("to_id").alias("id")), "id", "left_anti")


def without_out_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("from_id").alias("id")).distinct(), "id", "left_anti")


def density(n, r) -> Column:
    """r edges of the n (n - 1) / 2 possible ones."""
    return F.when(n < 2, 0.0).otherwise(r / (n * (n - 1) / 2.0))


def weight_band(weight) -> Column:
    w = F.col(weight)
    return F.when(w >= 0.8, "strong").when(w >= 0.5, "medium").when(w >= 0.3, "weak").otherwise("none")


def modelled_weight(frequency, strength) -> Column:
    """Base 0.5, frequency up to 0.3, strength up to 0.2, within 0.3 and 1."""
    return F.least(F.greatest(0.5 + 0.3 * F.least(F.col(frequency), F.lit(1.0)) + 0.2 * F.least(F.col(strength), F.lit(1.0)), F.lit(0.3)), F.lit(1.0))


def validated(edges: DataFrame) -> DataFrame:
    """Edges with the reasons against them: weight out of [0.3, 1], unknown type, repeated (from, to, type)."""
    n = F.count("*").over(Window.partitionBy("from_id", "to_id", "type"))
    return edges.withColumn("issues", F.array_compact(F.array(F.when(~F.col("weight").between(0.3, 1.0), "weight"), F.when(~F.col("type").isin(VALID_TYPES), "type"), F.when(n > 1, "duplicate"))))


def classified_nodes(nodes: DataFrame) -> DataFrame:
    """kind = entity for nodes without a location or named like a file, else atom."""
    # Endings of file names.
    file = F.col("label").rlike(r"(?i)\.(js|mjs|cjs|ts|tsx|py|go|rs|java|md|json|yaml|yml|toml)$")
    return nodes.withColumn("kind", F.when(F.coalesce("source_location", F.lit("")).eqNullSafe("") | file, "entity").otherwise("atom"))


def imported(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, atoms, references, skipped links) of an external graph. Ids are the nodes'; an atom belongs to its file's last entity node by id."""
    c = classified_nodes(nodes)
    entity = c.where("kind = 'entity'").select(F.col("id").alias("entity_id"), "label", "source_file", S.language("source_file").alias("language"), F.concat(F.lit("community:"), F.col("community").cast("string")).alias("tag"), F.lit("code").alias("type"))
    owner = entity.groupBy("source_file").agg(F.max("entity_id").alias("entity_id"))
    atom = c.where("kind = 'atom'").join(owner, "source_file").select(
        F.col("id").alias("atom_id"), "entity_id", F.regexp_replace("label", r"\(\)$", "").alias("name"), S.atom_type("label").alias("type"), S.start_line("source_location").alias("start_line"), S.end_line("source_location").alias("end_line")
    )
    known = atom.select(F.col("atom_id").alias("id")).union(entity.select("entity_id")).distinct()
    src = known.select(F.col("id").alias("s"))
    dst = known.select(F.col("id").alias("t"))
    tried = links.join(src, F.col("source") == F.col("s"), "left").join(dst, F.col("target") == F.col("t"), "left")
    found = tried.where("s IS NOT NULL AND t IS NOT NULL").select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.col("relation").alias("type"), S.edge_weight("relation", "confidence").alias("weight"))
    return entity, atom, found, tried.where("s IS NULL OR t IS NULL").drop("s", "t")


def cascade_delete(entities: DataFrame, atoms: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the entities of gone (entity_id), their atoms and every edge that touches either."""
    lost = gone.select(F.col("entity_id").alias("id")).union(atoms.join(gone, "entity_id", "left_semi").select("atom_id")).distinct()
    e = edges.join(lost.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(lost.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), atoms.join(gone, "entity_id", "left_anti"), e


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (caller, target) to symbols (name, id): by the full name, else by the last dotted part. Names count once, by smallest id."""
    one = symbols.groupBy("name").agg(F.min("id").alias("id"))
    last = F.element_at(F.split("target", r"\."), -1)
    full = one.select(F.col("name").alias("n1"), F.col("id").alias("id1"))
    part = one.select(F.col("name").alias("n2"), F.col("id").alias("id2"))
    return calls.join(full, F.col("target") == F.col("n1"), "left").join(part, last == F.col("n2"), "left").select("caller", "target", F.coalesce("id1", "id2").alias("symbol_id")).where("symbol_id IS NOT NULL")


def inheritance(classes: DataFrame) -> DataFrame:
    """extends (0.9) and implements (0.8) edges of classes (id, name, super_class, implements)."""
    named = classes.groupBy("name").agg(F.min("id").alias("to_id"))
    up = classes.select(F.col("id").alias("from_id"), F.col("super_class").alias("name"), F.lit("extends").alias("type"), F.lit(0.9).alias("weight"))
    impl = classes.select(F.col("id").alias("from_id"), F.explode("implements").alias("name"), F.lit("implements").alias("type"), F.lit(0.8).alias("weight"))
    return up.unionByName(impl).join(named, "name").select("from_id", "to_id", "type", "weight")


# What is tried after an import's path, in this order.
SUFFIXES = ["", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", "/index.js"]


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (from_path, module) to files (path): relative modules against the importer's folder, first suffix that exists."""
    folder = F.regexp_replace("from_path", r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("module", r"^\./", ""))
    up = joined
    for _ in range(4):
        up = F.regexp_replace(up, r"(^|/)[^/.][^/]*/\.\./", "$1")
    tries = imports.where(F.col("module").startswith(".")).select("from_path", "module", F.posexplode(F.array(*[F.concat(up, F.lit(s)) for s in SUFFIXES])).alias("n", "path"))
    return tries.join(files.select("path").distinct(), "path").groupBy("from_path", "module").agg(F.min_by("path", "n").alias("to_path"))


def depends_on(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    e = resolved.select(F.col("from_path").alias("from_id"), F.col("to_path").alias("to_id")).distinct().where("from_id <> to_id")
    return e.join(existing.where("type = 'depends_on'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").withColumns({"type": F.lit("depends_on"), "weight": F.lit(0.8)})
