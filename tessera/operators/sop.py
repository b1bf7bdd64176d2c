"""Standard procedures: steps of named checks over entities and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import quality as Q
from tessera.operators.numbering import numbered

ACTIONS = {
    "detect_isolated": lambda n, e: G.isolated(n.select("id"), e).agg(F.count("*").alias("found")),
    "detect_low_weight": lambda n, e: e.where("weight < 0.5").agg(F.count("*").alias("found")),
    "detect_missing_relations": lambda n, e: G.without_out_edges(n.select("id"), e).agg(F.count("*").alias("found")),
    "detect_duplicates": lambda n, e: n.where("abstract <> ''").groupBy("abstract").count().where("count > 1").agg(F.count("*").alias("found")),
    "verify": lambda n, e: Q.network_metrics(n.select("id"), e).select(F.col("isolated_entities").alias("found")),
}


def parse(text: str) -> dict:
    """A subset of YAML: scalars, lists of scalars, lists of maps, one level deep."""
    out, steps, key = {}, None, None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        scalar = lambda v: v.strip().strip("\"'")
        if m := re.match(r"^(\w+):\s*(.*)$", line):
            key, steps = m[1], None
            out[key] = scalar(m[2]) if m[2] else []
        elif m := re.match(r"^\s*-\s+(\w+):\s*(.*)$", line):
            steps = {m[1]: scalar(m[2])}
            out[key].append(steps)
        elif m := re.match(r"^\s*-\s+(.*)$", line):
            out[key].append(scalar(m[1]))
        elif (m := re.match(r"^\s+(\w+):\s*(.*)$", line)) and steps is not None:
            steps[m[1]] = scalar(m[2])
    return out


def _field(name: str) -> Column:
    """A top-level scalar of a procedure's text; null where it is missing or empty."""
    value = F.regexp_extract(F.coalesce("text", F.lit("")), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*(?: #.*)?$", 1)
    return F.nullif(F.regexp_replace(F.trim(value), r"^[\"']|[\"']$", ""), F.lit(""))


def listed(files: DataFrame, runs: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(name, description, category, last_run, position) of procedures by name, as a reader's alphabet has them.

    files: path, text; those without a name have none to be listed by. runs: name, at. category: of this one only, where `general` is that of files without.
    """
    found = files.select(_field("name").alias("name"), _field("description").alias("description"), F.coalesce(_field("category"), F.lit("general")).alias("category"), "path").where("name IS NOT NULL")
    if category is not None:
        found = found.where(F.col("category") == category)
    last = runs.groupBy("name").agg(F.max("at").alias("last_run")) if runs is not None else files.select(F.lit("").alias("name"), F.lit(None).cast("timestamp").alias("last_run")).limit(0)
    rows = found.join(last, "name", "left")
    return numbered(rows.withColumn("__key", F.collate("name", "UNICODE")), "__key", "name", "path", name="position").select("name", "description", "category", "last_run", "position")


def executed(steps: DataFrame, by: list[str]) -> DataFrame:
    """The steps that ran: up to the first one of a run that failed, unless it says `continue`. steps: by, n, status, on_failure.

    A run has as many steps as its procedure, which is written by hand, so a window over a run is small.
    """
    stops = (F.col("status") == "failed") & ~F.col("on_failure").eqNullSafe("continue")
    before = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("__stopped", F.coalesce(F.max(stops.cast("int")).over(before), F.lit(0))).where("__stopped = 0").drop("__stopped")


def reports(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, executed, success, failed, duration_ms, report) of runs. steps: by, n, action, status, on_failure, duration_ms, affected, error."""
    line = F.concat(
        F.lit("### "), "action", F.lit("\n- Status: "), "status", F.lit("\n- Duration: "), F.col("duration_ms").cast("string"), F.lit("ms"),
        F.when(F.col("affected").isNotNull(), F.concat(F.lit("\n- Affected: "), F.col("affected").cast("string"))).otherwise(""),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("\n- Error: "), "error")).otherwise(""),
    )
    ran = executed(steps, by).withColumn("__line", line)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "__line"))), lambda x: x["__line"])
    counts = [F.count("*").alias("executed"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("duration_ms")]
    out = ran.groupBy(*by).agg(*counts, in_order.alias("__lines"))
    head = F.format_string("**Steps**: %d executed, %d success, %d failed\n\n", "executed", "success", "failed")
    return out.withColumn("report", F.concat(head, F.array_join("__lines", "\n\n"))).drop("__lines")


def run(sop: dict, entities: DataFrame, edges: DataFrame, first: int = 1, last: int | None = None, skip: tuple[int, ...] = ()) -> list[dict]:
    """Steps in order with a number, a range and skips; an action that isn't known counts as done, with a note."""
    out = []
    for n, step in enumerate(sop.get("steps", []), 1):
        if n < first or (last is not None and n > last) or n in skip:
            out.append({"step": n, "status": "skipped"})
        elif step.get("action") in ACTIONS:
            out.append({"step": n, "status": "done", "found": ACTIONS[step["action"]](entities, edges).first()["found"]})
        else:
            out.append({"step": n, "status": "done", "note": f"no action {step.get('action')}"})
    return out


def tally(results: list[dict]) -> dict[str, int]:
    return {s: sum(r["status"] == s for r in results) for s in ("done", "skipped", "failed")}
