"""Quality: metrics, health scores, warnings, trends, targets, diagnosis and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph as G

# Targets, and whether less is better.
TARGETS = {"entity_count": (200, False), "relationship_count": (300, False), "network_density": (0.05, False), "isolated_entities": (0, True), "search_latency": (200, True), "search_accuracy": (0.9, False), "health_score": (85, False)}


def network_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("entity_count"))
    r = edges.agg(F.count("*").alias("relationship_count"))
    i = G.isolated(nodes, edges).agg(F.count("*").alias("isolated_entities"))
    m = n.join(r).join(i)
    return m.withColumns({"network_density": G.density(F.col("entity_count"), F.col("relationship_count")), "avg_relations": F.when(F.col("entity_count") > 0, F.col("relationship_count") / F.col("entity_count")).otherwise(0.0)})


def health_scores(m: DataFrame, accuracy: Column) -> DataFrame:
    """coverage, relation and search scores, their rounded mean and its grade."""
    m = m.withColumns({"coverage_score": F.least(F.lit(100.0), 0.5 * F.col("entity_count")), "relation_score": F.least(F.lit(100.0), 2000 * F.col("network_density")), "search_score": F.least(F.lit(100.0), 100 * accuracy)})
    m = m.withColumn("health_score", S.js_round((F.col("coverage_score") + F.col("relation_score") + F.col("search_score")) / 3))
    return m.withColumn("grade", S.health_grade("health_score"))


def light_health(m: DataFrame) -> Column:
    c, r = F.least(F.lit(100.0), 0.5 * F.col("entity_count")), F.least(F.lit(100.0), 2000 * F.col("network_density"))
    return F.greatest(S.js_round((c + r) / 2 - F.least(F.lit(30.0), 2.0 * F.col("isolated_entities"))), F.lit(0.0))


def orphan_rate() -> Column:
    return F.when(F.col("entity_count") > 0, S.js_round(F.col("isolated_entities") / F.col("entity_count"), 4)).otherwise(0.0)


def warnings_of(health="health_score", density="network_density", orphans="orphan_rate", least_health=80, least_density=0.02, most_orphans=0.2) -> Column:
    return F.array_compact(F.array(F.when(F.col(health) < least_health, "health_score"), F.when(F.col(density) < least_density, "network_density"), F.when(F.col(orphans) > most_orphans, "orphan_rate")))


def health_check(entities: DataFrame, edges: DataFrame, accuracy: Column | None = None, **limits) -> DataFrame:
    """One run of the health check, a row: the report's columns and `warnings`, an array of (type, message, suggestion). limits: those of warnings_of."""
    accuracy = F.lit(0.0) if accuracy is None else accuracy
    m = health_scores(network_metrics(entities.select("id"), edges), accuracy).withColumn("orphan_rate", orphan_rate())
    least = {"least_health": 80, "least_density": 0.02, "most_orphans": 0.2} | limits
    message = (
        F.when(F.col("w") == "health_score", F.format_string("Health score %d is below threshold %s", F.col("health_score").cast("int"), F.lit(str(least["least_health"]))))
        .when(F.col("w") == "network_density", F.format_string("Network density %.4f is below threshold %s", "network_density", F.lit(str(least["least_density"]))))
        .otherwise(F.format_string("Orphan rate %.1f%% exceeds threshold %.1f%% (%d isolated entities)", 100 * F.col("orphan_rate"), F.lit(100.0 * least["most_orphans"]), "isolated_entities"))
    )
    suggestion = F.when(F.col("w") == "health_score", "Run quality check to identify issues").when(F.col("w") == "network_density", "Run relation recommendation to improve network density").otherwise("Review isolated entities and create relations")
    # a row of metrics: at most three warnings come of it
    found = m.select("*", F.explode_outer(warnings_of(**least)).alias("w"))
    listed = F.collect_list(F.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("type"), message.alias("message"), suggestion.alias("suggestion"))))
    return found.groupBy(*m.columns).agg(F.array_sort(listed).alias("warnings"))


def issue_levels() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("isolated_entities") > 10, "critical:isolated").when(F.col("isolated_entities") > 5, "warning:isolated"),
        F.when(F.col("network_density") < 0.01, "warning:density"), F.when(F.col("search_latency") > 500, "warning:latency"),
    ))


def recommendations() -> Column:
    return F.array_compact(F.array(F.when(F.col("entity_count") < 50, "add entities"), F.when(F.col("isolated_entities") > 0, "link isolated entities"), F.when(F.col("health_score") < 70, "improve health")))


def daily_latest(metrics: DataFrame, at: str = "ts", tie: str | None = None) -> DataFrame:
    """One row a day: the latest."""
    w = Window.partitionBy("day").orderBy(F.desc(at), *([F.desc(tie)] if tie else []))
    return metrics.withColumn("day", F.to_date(at)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def retained(metrics: DataFrame, as_of: Column, days: int = 90, at: str = "ts") -> DataFrame:
    return metrics.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def trend(metrics: DataFrame, value: str, at: str = "ts", by: list[str] | None = None) -> DataFrame:
    """first, last, change, percent (2 dp) and direction (beyond 10 %)."""
    m = metrics.groupBy(*(by or [])).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    pct = F.when(F.col("first") != 0, S.js_round((F.col("last") - F.col("first")) / F.abs("first") * 100, 2)).otherwise(0.0)
    m = m.withColumns({"change": F.col("last") - F.col("first"), "percent": pct})
    return m.withColumn("direction", F.when(F.col("percent") > 10, "up").when(F.col("percent") < -10, "down").otherwise("flat"))


def trend_stats(metrics: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    r = lambda c: S.js_round(c, 2)
    return metrics.groupBy(*(by or [])).agg(F.min(value).alias("min"), F.max(value).alias("max"), r(F.avg(value)).alias("avg"), r(F.stddev_pop(value)).alias("std"))


def exact_percentiles(rows: DataFrame, by: str, value: str, points: dict[str, float], slack: float = 0.002) -> DataFrame:
    """(by, a column a point): percentiles with linear interpolation, exact.

    A sketch of bounded size gives values a little below and above each point; rows below are counted, and only the few between
    are sorted, so no group is gathered in one task. Null values don't count.
    """
    names = list(points)
    some = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    edges = [x for p in points.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    around = some.groupBy(by).agg(F.percentile_approx("v", edges, int(10 / slack)).alias("q"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") * slack < 4  # the neighbourhood would be less than a few rows: all are taken
    lo, hi = (lambda i: F.when(few, F.col("least")).otherwise(F.get("q", 2 * i))), (lambda i: F.when(few, F.col("most")).otherwise(F.get("q", 2 * i + 1)))
    spans = F.array(*[F.struct(F.lit(k).alias("name"), lo(i).alias("lo"), hi(i).alias("hi"), ((F.col("n") - 1) * F.lit(p)).alias("at")) for i, (k, p) in enumerate(points.items())])
    wide = around.select(F.col(by).alias("__by"), F.inline(spans))
    near = some.join(wide, F.col(by).eqNullSafe(F.col("__by")))
    below = near.groupBy("__by", "name").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    inside = near.where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("__by", "name", "at", "v").agg(F.count("*").alias("k"))
    order = Window.partitionBy("__by", "name").orderBy("v")
    placed = inside.withColumn("last", F.sum("k").over(order)).join(below.withColumnsRenamed({"__by": "__b", "name": "__name"}), F.col("__by").eqNullSafe(F.col("__b")) & (F.col("name") == F.col("__name")))
    first, end = F.col("below") + F.col("last") - F.col("k"), F.col("below") + F.col("last")
    holds = lambda rank: F.when((first <= rank) & (rank < end), F.col("v"))
    low, share = F.floor("at"), F.col("at") - F.floor("at")
    found = placed.groupBy("__by", "name").agg(F.max(holds(low)).alias("a"), F.max(holds(low + 1)).alias("b"), F.max(share).alias("share"))
    out = found.withColumn("x", F.col("a") + F.when(F.col("share") > 0, F.col("share") * (F.col("b") - F.col("a"))).otherwise(0.0))
    return out.groupBy(F.col("__by").alias(by)).agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in names])


def week_over_week(daily: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Means of the last seven rows and of the seven before. daily has a row a day."""
    last = daily.orderBy(F.desc(day)).limit(14).withColumn("n", F.row_number().over(Window.orderBy(F.desc(day))))
    return last.agg(F.avg(F.when(F.col("n") <= 7, F.col(value))).alias("this_week"), F.avg(F.when(F.col("n") > 7, F.col(value))).alias("last_week"))


def progress(value, target, lower) -> Column:
    up = F.when(target == 0, 100.0).otherwise(value / target * 100)
    down = F.when(target == 0, F.when(value == 0, 100.0).otherwise(0.0)).otherwise((2 * target - value) / (2 * target) * 100)
    return F.greatest(F.least(F.when(lower, down).otherwise(up), F.lit(100.0)), F.lit(0.0))


def against_targets(values: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """values: metric, value and the columns to keep. Adds target, gap, progress (0 to 100) and on_target."""
    spark = values.sparkSession
    t = spark.createDataFrame([(k, float(v), lower) for k, (v, lower) in TARGETS.items()], "metric string, target double, lower boolean")
    j = values.join(F.broadcast(t), "metric")
    on = F.when(F.col("lower"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return j.select(*(keep or []), "metric", "value", "target", (F.col("target") - F.col("value")).alias("gap"), S.js_round(progress(F.col("value"), F.col("target"), F.col("lower")), 2).alias("progress"), on.alias("on_target"))


def days_to_target(value, target, per_day) -> Column:
    """Null when flat or moving away."""
    d = (target - value) / F.nullif(per_day, F.lit(0.0))
    return F.when(value == target, 0).when(d > 0, F.ceil(d)).cast("long")


def duplicate_classes(entities: DataFrame, text: str = "abstract") -> DataFrame:
    """(member, representative, size, pairs): entities with equal, non-empty texts. representative is the smallest id; a class stands for size (size - 1) / 2 pairs, which are not listed."""
    e = entities.where(F.col(text) != "").select(F.col("id").alias("member"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("t"))
    classes = e.groupBy("h", "t").agg(F.min("member").alias("representative"), F.count("*").alias("size")).where("size > 1")
    return e.join(classes, ["h", "t"]).select("member", "representative", "size", F.expr("size * (size - 1) DIV 2").alias("pairs"))


def diagnosed(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, issue, severity, action) of isolated and unlinked entities, missing abstracts, weak edges and repeated abstracts."""
    nodes = entities.select("id")
    row = lambda df, issue, severity, action: df.select(F.col("id").cast("string").alias("id"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(action).alias("action"))
    repeated = duplicate_classes(entities).withColumnRenamed("member", "id")
    weak = edges.where("weight < 0.5").select(F.concat_ws(">", "from_id", "to_id").alias("id"))
    out = row(G.isolated(nodes, edges), "isolated", "high", "suggest_relations")
    for df, *rest in (
        (G.without_out_edges(nodes, edges), "missing_relations", "medium", "suggest_relations"), (entities.where("coalesce(abstract, '') = ''"), "missing_fields", "low", "fill_missing_fields"),
        (weak, "low_weight", "medium", "recalculate_weight"), (repeated, "duplicate", "high", "merge_entities"),
    ):
        out = out.unionByName(row(df, *rest))
    return out


def applied_fixes(issues: DataFrame, weights: Column | None = None) -> DataFrame:
    status = F.when(F.col("action").isin("suggest_relations", "recalculate_weight"), "applied").otherwise("skipped")
    return issues.withColumn("status", status)


def fix_history(history: DataFrame, batch: DataFrame, keep: int = 10, at: str = "ts", id_col: str = "fix_id") -> DataFrame:
    """The newest fixes of the history and a batch, newest first."""
    return history.unionByName(batch.select(*history.columns)).orderBy(F.desc(at), F.desc(id_col)).limit(keep)


def undo_of(history: DataFrame, fix_id) -> DataFrame:
    """The record of a fix; nothing is reverted."""
    return history.where(F.col("fix_id") == fix_id)


def fixed_weight(weight) -> Column:
    return F.greatest(F.lit(0.5), F.coalesce(F.col(weight), F.lit(0.0)) + 0.2)


def file_quality(cyclomatic, worst, nesting, lines, functions) -> Column:
    """100 less deductions; see file_issues for the reasons."""
    two = lambda c, a, x, b, y: F.when(F.col(c) > a, x).when(F.col(c) > b, y).otherwise(0)
    less = two(cyclomatic, 10, 20, 5, 10) + two(worst, 20, 20, 10, 10) + two(nesting, 5, 15, 3, 5) + two(lines, 500, 15, 300, 5) + F.when(F.col(functions) > 20, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - less))


def file_issues(cyclomatic, worst, nesting, lines, functions) -> Column:
    two = lambda c, a, x, b, y: F.when(F.col(c) > a, x).when(F.col(c) > b, y)
    return F.array_compact(F.array(
        two(cyclomatic, 10, "complexity too high", 5, "complexity high"), two(worst, 20, "very complex function", 10, "complex function"),
        two(nesting, 5, "nesting too deep", 3, "nesting deep"), two(lines, 500, "file too large", 300, "file large"), F.when(F.col(functions) > 20, "too many functions"),
    ))


# What is recommended for each issue.
ADVICE = {
    "complexity too high": "split complex functions", "complexity high": "split complex functions", "very complex function": "refactor complex functions", "complex function": "refactor complex functions",
    "nesting too deep": "return early or extract functions", "nesting deep": "return early or extract functions", "file too large": "split the file", "file large": "split the file", "too many functions": "group functions into modules",
}


def advice(issues) -> Column:
    return F.transform(issues, lambda x: F.element_at(S.mapping(ADVICE), x))


def project_grade(avg, risky, large) -> Column:
    a, r, big = F.col(avg), F.col(risky), F.col(large)
    return F.when((a < 5) & (r == 0) & (big == 0), "A").when((a < 8) & (r < 5) & (big < 5), "B").when((a < 12) & (r < 10) & (big < 10), "C").otherwise("D")


def project_metrics(files: DataFrame) -> DataFrame:
    """files: lines, functions, classes, complexity. Totals, mean complexity of files that have any, risky and large files, grade."""
    m = files.agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("functions").alias("functions"),
        F.coalesce(S.js_round(F.avg(F.when(F.col("complexity") > 0, F.col("complexity"))), 2), F.lit(0.0)).alias("avg_complexity"),
        F.count_if(F.col("complexity") > 10).alias("high_risk"), F.count_if(F.col("lines") > 500).alias("large"),
    )
    return m.withColumn("grade", project_grade("avg_complexity", "high_risk", "large"))


def risk_files(files: DataFrame) -> DataFrame:
    return files.where("complexity > 10 OR lines > 500").withColumn("risk", F.when(F.col("complexity") > 10, "high").otherwise("medium"))


def language_distribution(files: DataFrame, language: str = "language") -> DataFrame:
    c = files.groupBy(language).agg(F.count("*").alias("files"))
    return c.withColumn("percent", S.js_round(F.col("files") * 100.0 / F.sum("files").over(Window.partitionBy()), 1))


def completeness(functions: DataFrame, edges: DataFrame) -> DataFrame:
    left = G.unreferenced(functions, edges).agg(F.count("*").alias("unreferenced"))
    return left.withColumn("status", F.when(F.col("unreferenced") == 0, "PASS").otherwise("INCOMPLETE"))
