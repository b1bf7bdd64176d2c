"""Text output of small results: tables, bars, lines, progress, trees, reports (K7, K13-K16). Takes rows that are small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(rows: DataFrame, limit: int = 20) -> str:
    got = [[("" if v is None else str(v)) for v in r] for r in rows.limit(limit).collect()]
    widths = [max([len(c), *(len(r[i]) for r in got)]) for i, c in enumerate(rows.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(rows.columns), "-+-".join("-" * w for w in widths), *map(line, got)])


def bars(values: dict[str, float], width: int = 40) -> str:
    top, name = max(values.values(), default=0) or 1, max(map(len, values), default=0)
    return "\n".join(f"{k.ljust(name)} {'█' * round(v / top * width)} {v:g}" for k, v in values.items())


def line(series: list[float], height: int = 8) -> str:
    """A line chart of a few values: a row a level, the greatest on top."""
    low, high = min(series, default=0), max(series, default=0)
    level = [round((x - low) / ((high - low) or 1) * (height - 1)) for x in series]
    rows = ["".join("●" if v == k else " " for v in level).rstrip() for k in range(height - 1, -1, -1)]
    return "\n".join(f"{low + (high - low) * k / max(1, height - 1):>10.2f} ┤{r}" for k, r in zip(range(height - 1, -1, -1), rows))


def box(title: str, lines: list[str]) -> str:
    width = max(map(len, [title, *lines]))
    return "\n".join([f"┌─{'─' * width}─┐", f"│ {title.ljust(width)} │", f"├─{'─' * width}─┤", *[f"│ {x.ljust(width)} │" for x in lines], f"└─{'─' * width}─┘"])


def as_json(rows: DataFrame, limit: int = 1000) -> str:
    import json

    return json.dumps([r.asDict(recursive=True) for r in rows.limit(limit).collect()], ensure_ascii=False, default=str, indent=2)


def dashboard(metrics: DataFrame, issues: DataFrame, daily: list[float], top: int = 3) -> str:
    """One row of metrics, the most frequent issues, and the trend of the last seven days."""
    m = metrics.first().asDict()
    worst = issues.groupBy("issue", "severity").count().orderBy(F.desc("count"), "issue").limit(top)
    parts = [box("Quality", [f"{k}: {v}" for k, v in m.items()]), f"Issues\n{table(worst)}", f"Trend {sparkline(daily[-7:])}"]
    return "\n\n".join(parts)


def project_report(measures: DataFrame, totals: DataFrame, worst: int = 10) -> str:
    """Totals of a project and its most complex files."""
    files = measures.orderBy(F.desc("complexity"), F.desc("lines"), "path").limit(worst).select("path", "language", "lines", "functions", "complexity")
    return f"{table(totals)}\n\n{table(files, worst)}"


def sparkline(series: list[float]) -> str:
    marks, low = "▁▂▃▄▅▆▇█", min(series, default=0)
    span = (max(series, default=0) - low) or 1
    return "".join(marks[int((x - low) / span * 7)] for x in series)


def progress(value: float, target: float, width: int = 20) -> str:
    share = min(max(value / target if target else 1, 0), 1)
    return f"[{'█' * round(share * width)}{'░' * (width - round(share * width))}] {share:.0%}"


def arrow(direction: str) -> str:
    return {"up": "↑", "down": "↓"}.get(direction, "→")


def tree(paths: DataFrame, limit: int = 200, separator: str = " > ") -> str:
    """paths: depth, path."""
    rows = paths.orderBy("path").limit(limit).collect()
    return "\n".join("  " * (r["depth"] - 1) + r["path"].split(separator)[-1] for r in rows)


def memory_index(entries: DataFrame, recent: int = 20) -> str:
    """Counts by type, by day (the newest seven), and the newest entries."""
    by_type = entries.groupBy("type").count().orderBy(F.desc("count"), "type")
    by_day = entries.groupBy(F.to_date("date").alias("day")).count().orderBy(F.desc("day")).limit(7)
    last = entries.orderBy(F.desc("date"), F.desc("id")).limit(recent).select("date", "type", "id")
    return "\n\n".join(f"## {title}\n{table(df, 100)}" for title, df in (("By type", by_type), ("By day", by_day), ("Recent", last)))
