"""Trees of atoms: paths, descendants, levels, cycles, links, rendering and tree quality.

Trees are adjacency tables (local_id, parent_id, ...). Trees of at most LAZY levels are one lazy plan of equi-joins with the last
level. Whatever may be deeper is found by pointer doubling: a round replaces every row's pointer by its pointer's pointer, so a
chain of n rows takes log n rounds, each checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.graph import checkpointed

LAZY = 5


def roots(atoms: DataFrame) -> DataFrame:
    """Rows without a parent, and those whose parent doesn't exist."""
    ids = atoms.select(F.col("local_id").alias("__p")).distinct()
    return atoms.join(ids, F.col("parent_id") == F.col("__p"), "left").where("__p IS NULL").drop("__p")


def doubled(rows: DataFrame, **merged: Column) -> tuple[DataFrame, DataFrame]:
    """rows: (local_id, up, ...), each local_id once. Follows `up` to its end for all rows at once.

    merged says how a column's value over the pointer so far (the column) and over the next stretch (__column) become one. Returns
    the rows whose chain ends, and those that never come to an end, which stand on or below a cycle.
    """
    left = None
    while True:
        ahead = rows.select(*[F.col(c).alias(f"__{c}") for c in rows.columns])
        met = rows.join(ahead, F.col("up") == F.col("__local_id"), "left")
        on = F.col("__local_id").isNotNull()
        rows = checkpointed(met.select("local_id", F.col("__up").alias("up"), *[F.when(on, f).otherwise(F.col(c)).alias(c) for c, f in merged.items()]))
        open_ = rows.where("up IS NOT NULL").count()
        # In an acyclic rest each round ends some chain.
        if open_ in (0, left):
            return rows.where("up IS NULL"), rows.where("up IS NOT NULL")
        left = open_


def linked(atoms: DataFrame) -> DataFrame:
    """atoms with `up`: the parent, where it exists."""
    ids = atoms.select(F.col("local_id").alias("up")).distinct()
    return atoms.join(ids, F.col("parent_id") == F.col("up"), "left")


def tree_paths(atoms: DataFrame, max_depth: int | None = None, separator: str = " > ", max_level: int | None = None) -> DataFrame:
    """local_id, parent_id, depth (root 1), path of names. Rows on a cycle are reached from no root and left out.

    max_depth: the depth of the trees where it is known. max_level: rows below the level are left out.
    """
    base = atoms.select("local_id", "parent_id", "name")
    if max_depth is None or max_depth > LAZY:
        start = linked(base).select("local_id", "up", F.lit(1).alias("depth"), F.coalesce("name", F.lit("")).alias("path"))
        done, _ = doubled(start, depth=F.col("depth") + F.col("__depth"), path=F.concat_ws(separator, "__path", "path"))
        deepest = min(x for x in (max_depth, max_level, 1 << 30) if x)
        return base.select("local_id", "parent_id").join(done.select("local_id", "depth", "path"), "local_id").where(F.col("depth") <= deepest)
    level = roots(base).select("local_id", "parent_id", F.lit(1).alias("depth"), F.col("name").alias("path"))
    out = level
    for d in range(2, (min(max_depth, max_level) if max_level else max_depth) + 1):
        up = level.select(F.col("local_id").alias("__p"), F.col("path").alias("__path"))
        level = base.join(up, F.col("parent_id") == F.col("__p")).select("local_id", "parent_id", F.lit(d).alias("depth"), F.concat_ws(separator, "__path", "name").alias("path"))
        out = out.unionByName(level)
    return out


def in_order(atoms: DataFrame) -> DataFrame:
    """Adds `position`: the place of a row among its parent's children by `order`, as a reader's alphabet has it; a missing order is the empty one."""
    w = Window.partitionBy("parent_id").orderBy(F.collate(F.coalesce("order", F.lit("")), "UNICODE"), "local_id")
    return atoms.withColumn("position", F.row_number().over(w))


def found_node(atoms: DataFrame, local_id) -> DataFrame:
    return atoms.where(F.col("local_id") == local_id)


def flattened(trees: DataFrame, key: str = "entity_id", column: str = "tree") -> DataFrame:
    """Nested trees as JSON arrays of {local_id, name, parent_id, children} in adjacency rows: key, position (preorder), local_id, parent_id, name. An own parent_id wins over the place."""
    import json

    import pandas as pd

    def work(frames):
        for f in frames:
            out = []
            for k, text in zip(f[key], f[column]):
                todo, n = [(x, None) for x in reversed(json.loads(text or "[]"))], 0
                while todo:
                    node, above = todo.pop()
                    own = node.get("parent_id")
                    out.append((k, n, node.get("local_id"), above if own is None else own, node.get("name")))
                    n += 1
                    todo += [(c, node.get("local_id")) for c in reversed(node.get("children") or [])]
            yield pd.DataFrame(out, columns=[key, "position", "local_id", "parent_id", "name"])

    kind = trees.schema[key].dataType.simpleString()
    return trees.select(key, column).mapInPandas(work, f"{key} {kind}, position long, local_id string, parent_id string, name string")


def synthesised(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, text): abstract, overview, and every atom with its id, indented by depth. entities: id, abstract, overview; paths: entity_id, local_id, name, content, depth (root 0), position (preorder)."""
    indent = F.repeat(F.lit("  "), F.col("depth").cast("int"))
    text = F.concat(indent, F.lit("[["), F.col("local_id").cast("string"), F.lit("]] "), "name", F.lit("\n\n"), indent, "content", F.lit("\n\n"))
    body = paths.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("t")))), lambda x: x["t"]), "").alias("body"))
    return entities.join(body, "id", "left").select("id", F.concat("abstract", F.lit("\n\n"), "overview", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def descendants(atoms: DataFrame, root_id, max_depth: int = 20) -> DataFrame:
    base = atoms.select("local_id", "parent_id")
    level = base.where(F.col("parent_id") == root_id).withColumn("depth", F.lit(1))
    out = level
    for d in range(2, max_depth + 1):
        level = base.join(level.select(F.col("local_id").alias("__p")), F.col("parent_id") == F.col("__p")).select("local_id", "parent_id", F.lit(d).alias("depth"))
        if max_depth > LAZY and (level := checkpointed(level)).isEmpty():
            break
        out = out.unionByName(level)
    return out


def cyclic(atoms: DataFrame) -> DataFrame:
    """Rows whose chain of parents never ends, i.e. on or below a cycle."""
    return doubled(linked(atoms.select("local_id", "parent_id")).select("local_id", "up"))[1].select("local_id")


def on_cycles(atoms: DataFrame) -> DataFrame:
    """(local_id, cycle, parent_id): the rows that a chain of parents leads back to; cycle is the smallest id of the cycle."""
    lost = cyclic(atoms)
    ring = checkpointed(atoms.select("local_id", "parent_id").join(lost, "local_id", "left_semi"))
    # After more steps than there are rows below a cycle, pointers stand on cycles only, and reach every row of them.
    steps = max(1, ring.count()).bit_length()
    far = ring.select("local_id", F.col("parent_id").alias("up"))
    for _ in range(steps):
        ahead = far.select(F.col("local_id").alias("__id"), F.col("up").alias("__up"))
        far = checkpointed(far.join(ahead, F.col("up") == F.col("__id")).select("local_id", F.col("__up").alias("up")))
    round_ = checkpointed(ring.join(far.select(F.col("up").alias("local_id")).distinct(), "local_id", "left_semi"))
    # The smallest id around the cycle, by doubling windows of it.
    least = round_.select("local_id", F.col("parent_id").alias("up"), F.col("local_id").alias("cycle"))
    for _ in range(steps):
        ahead = least.select(F.col("local_id").alias("__id"), F.col("up").alias("__up"), F.col("cycle").alias("__cycle"))
        least = checkpointed(least.join(ahead, F.col("up") == F.col("__id")).select("local_id", F.col("__up").alias("up"), F.least("cycle", "__cycle").alias("cycle")))
    return round_.join(least.select("local_id", "cycle"), "local_id").select("local_id", "cycle", "parent_id")


def heading_levels(atoms: DataFrame) -> DataFrame:
    """heading_level = the parent's + 1, 1 for a root."""
    up = atoms.select(F.col("local_id").alias("__p"), F.col("heading_level").alias("__l"))
    return atoms.join(up, F.col("parent_id") == F.col("__p"), "left").withColumn("derived_level", F.coalesce(F.col("__l") + 1, F.lit(1))).drop("__p", "__l")


def level_filter(atoms: DataFrame, max_level: int, max_depth: int | None = None) -> DataFrame:
    """Rows up to the level by heading_level; a row at the level hides all below it, whatever their levels. max_depth: as for tree_paths."""
    base = atoms.select("local_id", "parent_id", "name", "heading_level")
    keep = base.where(F.col("heading_level") <= max_level)
    if max_depth is None or max_depth > LAZY:
        stop = F.coalesce(F.col("heading_level") >= max_level, F.lit(True))
        ended, _ = doubled(linked(base).select("local_id", "up", stop.alias("stop")), stop=F.col("stop") | F.col("__stop"))
        above = ended.select(F.col("local_id").alias("__p"), F.col("stop").alias("hidden"))
        return keep.join(ended.select("local_id"), "local_id", "left_semi").join(above, F.col("parent_id") == F.col("__p"), "left").where("NOT coalesce(hidden, false)").select(*base.columns)
    level = roots(atoms).where(F.col("heading_level") <= max_level).select(*base.columns)
    out = level
    for _ in range(max_depth - 1):
        up = level.where(F.col("heading_level") < max_level).select(F.col("local_id").alias("__p"))
        level = keep.join(up, F.col("parent_id") == F.col("__p")).drop("__p")
        out = out.unionByName(level)
    return out


def level_load(atoms: DataFrame, max_level: int, max_depth: int | None = None) -> DataFrame:
    """(local_id, parent_id, name, heading_level, breadcrumb, shown, total): the rows up to a level with their paths, and how many of all they are."""
    kept = level_filter(atoms, max_level, max_depth)
    paths = tree_paths(atoms, max_depth).select("local_id", F.col("path").alias("breadcrumb"))
    counts = kept.agg(F.count("*").alias("shown")).join(F.broadcast(atoms.agg(F.count("*").alias("total"))))
    return kept.join(paths, "local_id").join(F.broadcast(counts))


def with_links(atoms: DataFrame) -> DataFrame:
    return atoms.select(F.col("local_id").alias("source"), F.explode(S.wiki_links("content")).alias("l")).select("source", "l.target", "l.entity_id", "l.label", "l.is_embed")


def dangling_links(atoms: DataFrame) -> DataFrame:
    """Links within the entity to rows that don't exist; links to other entities are not checked."""
    ids = atoms.select(F.col("local_id").alias("target"))
    return with_links(atoms).where("entity_id IS NULL").join(ids, "target", "left_anti").select("source", "target")


def cross_entity_links(atoms: DataFrame) -> DataFrame:
    return with_links(atoms).where("entity_id IS NOT NULL").select("source", "entity_id", "target")


def dangling_parents(atoms: DataFrame) -> DataFrame:
    ids = atoms.select(F.col("local_id").alias("parent_id"))
    return atoms.where("parent_id IS NOT NULL").join(ids, "parent_id", "left_anti").select("local_id", "parent_id")


def backlinks(atoms: DataFrame, target) -> DataFrame:
    return with_links(atoms).where(F.col("entity_id").isNull() & (F.col("target") == target)).select("source", "label")


def mark_dead_links(atoms: DataFrame) -> DataFrame:
    dead = dangling_links(atoms).groupBy(F.col("source").alias("local_id")).agg(F.array_sort(F.collect_set("target")).alias("dead_links"))
    return atoms.join(dead, "local_id", "left")


def rendered(paths: DataFrame, content: DataFrame, cap: int = 6) -> DataFrame:
    """A heading of the row's depth (at most cap) and its content."""
    return paths.join(content, "local_id").select("local_id", F.concat(F.repeat(F.lit("#"), F.least("depth", F.lit(cap))), F.lit(" "), "name", F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("markdown"))


def applied_operations(atoms: DataFrame, operations: DataFrame) -> DataFrame:
    """A log of (seq, op, local_id, parent_id, name): add and update replace a row, remove drops it and all below it, however deep; the last of a row counts.

    Rows that the log would put on or below a cycle are kept as they are; `cyclic` of the result names them.
    """
    last = operations.withColumn("__n", F.row_number().over(Window.partitionBy("local_id").orderBy(F.desc("seq")))).where("__n = 1").drop("__n")
    kept = atoms.join(last.select("local_id"), "local_id", "left_anti").select("local_id", "parent_id", "name")
    now = kept.unionByName(last.where("op <> 'remove'").select("local_id", "parent_id", "name"))
    now = checkpointed(now)
    gone = last.where("op = 'remove'").select("local_id", F.lit(None).cast(atoms.schema["parent_id"].dataType).alias("parent_id"), F.lit(True).alias("dead"))
    all_ = linked(now.select("local_id", "parent_id", F.lit(False).alias("dead")).unionByName(gone))
    ended, endless = doubled(all_.select("local_id", "up", "dead"), dead=F.col("dead") | F.col("__dead"))
    stays = ended.where("NOT dead").select("local_id").unionByName(endless.select("local_id"))
    return now.join(stays, "local_id", "left_semi")


def tree_metrics(atoms: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Mean depth, population deviation of content lengths, links a row, share of rows that nothing links to and that link to nothing."""
    depth = tree_paths(atoms, max_depth).agg(F.avg("depth").alias("avg_depth"))
    per = atoms.select("local_id", F.length(F.coalesce("content", F.lit(""))).alias("n"), S.link_targets("content").alias("links"))
    shape = per.agg(F.stddev_pop("n").alias("content_std"), F.avg(F.size("links")).alias("link_density"), F.count("*").alias("n"))
    linked = per.select(F.explode("links").alias("local_id")).unionByName(per.where("size(links) > 0").select("local_id")).distinct()
    orphans = per.join(linked, "local_id", "left_anti").agg(F.count("*").alias("orphans"))
    return depth.join(shape).join(orphans).select("avg_depth", "content_std", "link_density", (F.col("orphans") / F.col("n")).alias("orphan_rate"))


def faithfulness(atoms: DataFrame, entity: DataFrame, stop_words=()) -> DataFrame:
    """Per entity: coverage of atoms' terms by the entity's content, validity of links and of the hierarchy.

    atoms: entity_id, local_id, parent_id, name, content, heading_level; entity: entity_id, content, abstract.
    """
    terms = entity.select("entity_id", S.eval_terms("content", stop_words).alias("whole"), S.eval_terms("abstract", stop_words).alias("short"))
    a = atoms.join(terms, "entity_id").withColumn("own", S.eval_terms("content", stop_words)).withColumn("title", S.eval_terms("name", stop_words))
    share = F.when(F.size("own") > 0, F.size(F.array_intersect("own", "whole")) / F.size("own"))
    fit = F.size(F.array_intersect("title", "short")).cast("double")
    cover = a.groupBy("entity_id").agg(F.avg(share).alias("coverage"), F.avg(fit).alias("consistency"), F.count("*").alias("n"))
    ids = atoms.select("entity_id", F.col("local_id").alias("target"), F.lit(1).alias("ok"))
    links = atoms.select("entity_id", F.explode(S.link_targets("content")).alias("target")).join(ids, ["entity_id", "target"], "left")
    valid = links.groupBy("entity_id").agg((F.count("ok") / F.count("*")).alias("link_validity"))
    up = atoms.select("entity_id", F.col("local_id").alias("parent_id"), F.col("heading_level").alias("up"))
    h = atoms.join(up.withColumn("found", F.lit(True)), ["entity_id", "parent_id"], "left")
    checks = F.lit(1) + F.when(F.col("heading_level").isNotNull(), 1).otherwise(0)
    passed = F.when(F.col("parent_id").isNull() | F.col("found").isNotNull(), 1).otherwise(0) + F.when(F.col("heading_level").isNull(), 0).when(
        F.col("parent_id").isNull(), (F.col("heading_level") == 1).cast("int")
    ).when(F.col("up").isNull(), 1).otherwise((F.col("heading_level") > F.col("up")).cast("int"))
    order = h.groupBy("entity_id").agg((F.sum(passed) / F.sum(checks)).alias("hierarchy"))
    r = lambda c: S.js_round(c, 3)
    out = cover.join(valid, "entity_id", "left").join(order, "entity_id").select("entity_id", r(F.coalesce("coverage", F.lit(1.0))).alias("coverage"), r("consistency").alias("consistency"), r(F.coalesce("link_validity", F.lit(1.0))).alias("link_validity"), r("hierarchy").alias("hierarchy"))
    return out.withColumn("overall", r(0.3 * F.col("coverage") + 0.2 * F.col("consistency") + 0.3 * F.col("link_validity") + 0.2 * F.col("hierarchy")))
