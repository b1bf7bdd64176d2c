"""Queries: counts, listings, trends, targets, file and project quality, code analysis, Spark-native extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import browse as B
from tessera.operators import quality as Q
from tessera.plans.registry import ENTITY, Tables, query, rounded


@query("SELECT coalesce(source, 'unknown') AS type, count(*) AS n FROM documents GROUP BY 1")
def type_distribution(t: Tables):
    return B.count_by(t.entities(), "type")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def date_top7(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(7)


@query("SELECT topic, count(*) AS n FROM (SELECT unnest([source, lang, source]) AS topic FROM documents) x GROUP BY topic HAVING count(*) >= 2")
def topic_counts(t: Tables):
    return B.topic_counts(t.entities(), 2)


@query("SELECT lang AS language, count(*) AS files, round(floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 10, 6)::DOUBLE AS percent FROM documents GROUP BY lang")
def lang_distribution(t: Tables):
    return Q.language_distribution(t.documents.select(F.col("lang").alias("language")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_entries(t: Tables):
    return B.recent(t.events, 20, "ts", "event_id").select("event_id", "ts")


@query("SELECT CAST(ts AS DATE) AS day, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n <= 10")
def timeline_days(t: Tables):
    return B.per_day(t.events).select("day", "event_id", "n")


@query("SELECT day, count(*) AS entries, '# ' || day || ' (' || count(*) || ')' || chr(10) || string_agg(strftime(ts, '%H:%M') || ' ' || event_type, chr(10) ORDER BY n) AS overview FROM (SELECT CAST(ts AS DATE) AS day, ts, event_type, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n <= 100 GROUP BY day")
def day_overview(t: Tables):
    return B.day_overview(t.events)


@query(f"WITH e AS ({ENTITY}) SELECT id, abstract, overview, NULL::VARCHAR AS content FROM e")
def level_projection(t: Tables):
    return t.entities().select("id", *B.at_level(1))


@query(f"WITH e AS ({ENTITY}) SELECT id, type FROM e WHERE type = 'src1' AND contains(lower(abstract), 'the')")
def entity_listing(t: Tables):
    return B.listed(t.entities(), contains={"abstract": "the"}, type="src1").select("id", "type")


@query("""SELECT doc_id AS id, concat_ws(',', CASE WHEN text = '' THEN 'content missing' WHEN length(text) > 5000 THEN 'content too long' END, CASE WHEN doc_id % 7 = 0 THEN 'type missing' END,
  CASE WHEN least(length(text), 80 + doc_id % 40) > 100 THEN 'abstract long' END, CASE WHEN least(length(text), 480 + doc_id % 40) > 500 THEN 'overview long' END) AS problems FROM documents""")
def write_validation(t: Tables):
    cut = lambda n: f"substr(text, 1, CAST({n} + doc_id % 40 AS INT))"
    e = t.documents.selectExpr("doc_id AS id", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS type", f"{cut(80)} AS abstract", f"{cut(480)} AS overview", "text AS content")
    return e.select("id", F.array_join(B.entry_problems(5000), ",").alias("problems"))


@query("SELECT day, event_id, value FROM (SELECT CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1")
def daily_latest(t: Tables):
    return Q.daily_latest(t.events, tie="event_id").select("day", "event_id", "value")


@query("SELECT count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAYS")
def retention_90d(t: Tables):
    return Q.retained(t.events, F.lit("2024-04-10 00:00:00").cast("timestamp_ntz")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


TREND = "f AS (SELECT event_type, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY event_type), p AS (SELECT *, CASE WHEN first <> 0 THEN floor((last - first) / abs(first) * 100 * 100 + 0.5) / 100 ELSE 0 END AS percent FROM f)"


@query(f"WITH {TREND} SELECT event_type, first, last, round(last - first, 6) AS change, round(percent, 2) AS percent, CASE WHEN percent > 10 THEN 'up' WHEN percent < -10 THEN 'down' ELSE 'flat' END AS direction FROM p")
def trend_change(t: Tables):
    return rounded(Q.trend(t.events, "value", by=["event_type"]), "change").withColumn("percent", F.round("percent", 2))


@query("SELECT event_type, min(value) AS min, max(value) AS max, floor(avg(value) * 100 + 0.5) / 100 AS avg, floor(stddev_pop(value) * 100 + 0.5) / 100 AS std FROM events GROUP BY event_type")
def trend_stats(t: Tables):
    return Q.trend_stats(t.events, "value", ["event_type"])


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY day DESC) AS n FROM d) SELECT round(avg(v) FILTER (WHERE n <= 7), 4) AS this_week, round(avg(v) FILTER (WHERE n > 7 AND n <= 14), 4) AS last_week FROM r")
def week_over_week(t: Tables):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return rounded(Q.week_over_week(d, "v"), "this_week", "last_week", digits=4)


FILES = "SELECT doc_id, lang AS language, CAST(n_chars / 20 AS BIGINT) AS lines, CAST(doc_id % 25 AS INTEGER) AS functions, CAST(doc_id % 23 AS INTEGER) AS complexity, CAST(doc_id % 8 AS INTEGER) AS nesting, CAST(doc_id % 31 AS INTEGER) AS worst FROM (SELECT doc_id, lang, n_chars - n_chars % 20 AS n_chars FROM documents) d"


def _files(t: Tables):
    c = lambda n: (F.col("doc_id") % n).cast("int")
    return t.documents.select("doc_id", F.col("lang").alias("language"), F.floor(F.col("n_chars") / 20).cast("long").alias("lines"), c(25).alias("functions"), c(23).alias("complexity"), c(8).alias("nesting"), c(31).alias("worst"))


LESS = "(CASE WHEN complexity > 10 THEN 20 WHEN complexity > 5 THEN 10 ELSE 0 END + CASE WHEN worst > 20 THEN 20 WHEN worst > 10 THEN 10 ELSE 0 END + CASE WHEN nesting > 5 THEN 15 WHEN nesting > 3 THEN 5 ELSE 0 END + CASE WHEN lines > 500 THEN 15 WHEN lines > 300 THEN 5 ELSE 0 END + CASE WHEN functions > 20 THEN 10 ELSE 0 END)"


@query(f"WITH f AS ({FILES}), s AS (SELECT doc_id, greatest(0, least(100, 100 - {LESS})) AS score FROM f) SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s")
def file_quality_score(t: Tables):
    return _files(t).select("doc_id", Q.file_quality("complexity", "worst", "nesting", "lines", "functions").alias("score")).withColumn("grade", S.file_grade("score"))


@query(f"WITH f AS ({FILES}) SELECT doc_id, (CASE WHEN complexity > 5 THEN 1 ELSE 0 END + CASE WHEN worst > 10 THEN 1 ELSE 0 END + CASE WHEN nesting > 3 THEN 1 ELSE 0 END + CASE WHEN lines > 300 THEN 1 ELSE 0 END + CASE WHEN functions > 20 THEN 1 ELSE 0 END) AS n FROM f")
def file_recommendations(t: Tables):
    i = _files(t).select("doc_id", Q.file_issues("complexity", "worst", "nesting", "lines", "functions").alias("i"))
    return i.select("doc_id", F.size(Q.advice("i")).alias("n"))


PROJECT = f"WITH f AS ({FILES}), m AS (SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(functions) AS BIGINT) AS functions, floor(avg(complexity) FILTER (WHERE complexity > 0) * 100 + 0.5) / 100 AS avg_complexity, count(*) FILTER (WHERE complexity > 10) AS high_risk, count(*) FILTER (WHERE lines > 500) AS large FROM f)"


@query(f"{PROJECT} SELECT *, CASE WHEN avg_complexity < 5 AND high_risk = 0 AND large = 0 THEN 'A' WHEN avg_complexity < 8 AND high_risk < 5 AND large < 5 THEN 'B' WHEN avg_complexity < 12 AND high_risk < 10 AND large < 10 THEN 'C' ELSE 'D' END AS grade FROM m")
def project_metrics(t: Tables):
    return Q.project_metrics(_files(t))


@query(f"WITH f AS ({FILES}) SELECT doc_id, complexity, lines, CASE WHEN complexity > 10 THEN 'high' ELSE 'medium' END AS risk FROM f WHERE complexity > 10 OR lines > 500")
def risk_files(t: Tables):
    return Q.risk_files(_files(t)).select("doc_id", "complexity", "lines", "risk")


# Beyond the reference: what Spark offers over the same tables.


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def extra_rollup(t: Tables):
    e = t.events.withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'purchase') AS last_purchase FROM events e WHERE event_type = 'view'")
def extra_asof(t: Tables):
    """As-of join by a window over the union of both sides, so that a user's rows are sorted once."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t.events.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'view'").select("event_id", "last_purchase")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def extra_pricing_summary(t: Tables):
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def extra_orders_by_nation(t: Tables):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(t: Tables):
    p = Q.exact_percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rounded(p, "p50", "p95", "p99")
