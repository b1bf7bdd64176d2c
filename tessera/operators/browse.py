"""Listings, counts and predicates over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# Paths that are never indexed.
EXCLUDED = [
    r"[\\/]\.env$", r"[\\/]\.env\.\w+$", r"[\\/]\.git[\\/]", r"[\\/]node_modules[\\/]", r"[\\/]\.DS_Store$", r"config.*\.json$", r"[\\/]\.pem$", r"[\\/]\.key$", r"[\\/]\.p12$",
    r"[\\/]\.pfx$", r"[\\/]\.crt$", r"[\\/]\.cer$", r"[\\/]id_rsa$", r"[\\/]id_dsa$", r"[\\/]id_ecdsa$", r"[\\/]id_ed25519$", r"[\\/]\.htpasswd$", r"[\\/]\.netrc$", r"[\\/]\.npmrc$",
    r"[\\/]\.yarnrc$", r"[\\/]credentials$", r"[\\/]secret$", r"[\\/]secrets$", r"[\\/]password$", r"[\\/]passwords$",
]
# Sensitive content by type.
SENSITIVE = {
    "password": r"""(?i)password\s*[:=]\s*["'][^"']{4,}["']""", "api_key": r"""(?i)api[_-]?key\s*[:=]\s*["'][^"']{4,}["']""", "secret": r"""(?i)secret\s*[:=]\s*["'][^"']{4,}["']""",
    "token": r"""(?i)token\s*[:=]\s*["'][^"']{4,}["']""", "private_key": r"(?i)private[_-]?key\s*[:=]\s*", "aws_key": r"""(?i)aws_access_key_id\s*[:=]\s*["'][^"']{4,}["']""",
    "aws_secret": r"""(?i)aws_secret_access_key\s*[:=]\s*["'][^"']{4,}["']""", "database_url": r"""(?i)database[_-]?url\s*[:=]\s*["'][^"']{4,}["']""",
    "connection_string": r"""(?i)connection[_-]?string\s*[:=]\s*["'][^"']{4,}["']""", "bearer_token": r"(?i)bearer\s+[a-zA-Z0-9_\-.]{10,}", "service_url": r"(?i)MONGO_URI|REDIS_URL|GITHUB_TOKEN|SLACK_WEBHOOK",
    "base64_secret": r"eyJ[A-Za-z0-9_-]{20,}",
}
ENTRY_BYTES, FILE_BYTES = 102_400, 1_048_576


def excluded(path) -> Column:
    return F.regexp_replace(F.col(path), r"\\", "/").rlike("|".join(EXCLUDED))


def sensitive_types(text) -> Column:
    """The types found; each counts once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in SENSITIVE.items()]))


def skip_reason(path, text) -> Column:
    return F.when(excluded(path), "excluded").when(F.size(sensitive_types(text)) > 0, "sensitive")


def size_status(text, limit: int = ENTRY_BYTES) -> Column:
    b = F.octet_length(F.col(text))
    return F.when(b > limit, "error").when(b >= 0.9 * limit, "warn").otherwise("ok")


def at_level(level: int) -> list[Column]:
    cols = ["abstract", "overview", "content"]
    return [F.col(c) if i <= level else F.lit(None).cast("string").alias(c) for i, c in enumerate(cols)]


def entry_problems(max_chars: int = 100_000) -> Column:
    """Reasons why an entry can't be written, and warnings, by field."""
    return F.array_compact(F.array(
        F.when(F.coalesce("content", F.lit("")) == "", "content missing").when(F.length("content") > max_chars, "content too long"), F.when(F.coalesce("type", F.lit("")) == "", "type missing"),
        F.when(F.length("abstract") > 100, "abstract long"), F.when(F.length("overview") > 500, "overview long"),
    ))


def listed(rows: DataFrame, limit: int | None = None, contains: dict | None = None, **equal) -> DataFrame:
    """Conjunction of the given equalities and case-insensitive substrings; arguments that are None don't count."""
    for k, v in equal.items():
        rows = rows if v is None else rows.where(F.col(k) == v)
    for k, v in (contains or {}).items():
        rows = rows if v is None else rows.where(F.lower(k).contains(v.lower()))
    return rows if limit is None else rows.orderBy(rows.columns[0]).limit(limit)


def projected_size(text, atoms, limit: int = FILE_BYTES) -> Column:
    """current, projected (two bytes a character of the atoms as JSON) and ok: whether an entry still fits with more atoms (an array of structs)."""
    now = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    then = now + 2 * F.char_length(F.to_json(atoms))
    return F.struct(now.alias("current"), then.cast("long").alias("projected"), (then <= limit).alias("ok"))


def complete(rows: DataFrame) -> DataFrame:
    """Rows with an id and an abstract."""
    return rows.where("coalesce(CAST(id AS STRING), '') <> '' AND coalesce(abstract, '') <> ''")


def unsynced(rows: DataFrame) -> DataFrame:
    return rows.where("NOT coalesce(synced, false)")


def between_days(rows: DataFrame, first: str, last: str, at: str = "ts") -> DataFrame:
    """Both days included."""
    return rows.where(F.to_date(at).between(first, last))


def by_key(entities: DataFrame, atoms: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key): an entity's id, `entity/atom`, or an atom's id alone. (key, kind, id, content); an atom's id alone counts where no entity has it."""
    e = keys.join(entities.select(F.col("id").alias("key"), "content"), "key").select("key", F.lit("entity").alias("kind"), F.col("key").alias("id"), "content")
    parts = keys.select("key", F.substring_index("key", "/", 1).alias("entity_id"), F.expr("substr(key, instr(key, '/') + 1)").alias("local_id")).where("instr(key, '/') > 0")
    a = parts.join(atoms, ["entity_id", "local_id"]).select("key", F.lit("atom").alias("kind"), F.col("local_id").alias("id"), "content")
    alone = keys.where("instr(key, '/') = 0").join(entities.select(F.col("id").alias("key")), "key", "left_anti")
    b = alone.join(atoms.select(F.col("local_id").alias("key"), "content"), "key").select("key", F.lit("atom").alias("kind"), F.col("key").alias("id"), "content")
    return e.unionByName(a).unionByName(b)


def mapping_check(mappings: DataFrame) -> DataFrame:
    """mappings: path, source_id, memory_id. (valid, invalid) counts; mappings lacking either id are listed by missing_ids."""
    ok = (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("memory_id", F.lit("")) != "")
    return mappings.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def missing_ids(mappings: DataFrame) -> DataFrame:
    return mappings.where("coalesce(source_id, '') = '' OR coalesce(memory_id, '') = ''").select("path")


def recent(entries: DataFrame, limit: int = 20, at: str = "date", id_col: str = "id") -> DataFrame:
    return entries.orderBy(F.desc(at), F.desc(id_col)).limit(limit)


def topic_counts(entries: DataFrame, least: int = 1) -> DataFrame:
    """The type and every tag count; a tag equal to the type counts again."""
    t = entries.select(F.explode(F.concat(F.array(F.coalesce("type", F.lit("general"))), F.coalesce("tags", S.lits([])))).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def per_day(entries: DataFrame, most: int = 10, at: str = "ts", id_col: str = "event_id") -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.desc(at), F.desc(id_col))
    return entries.withColumn("day", F.to_date(at)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def count_by(rows: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(key, F.lit(default)).alias(key)).agg(F.count("*").alias("n"))


def day_overview(entries: DataFrame, most: int = 100) -> DataFrame:
    """A text a day: a header with the number of lines that are left, and the newest entries first."""
    p = per_day(entries, most).select("day", F.struct("n", F.concat_ws(" ", F.date_format("ts", "HH:mm"), "event_type").alias("line")).alias("x"))
    g = p.groupBy("day").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("day", F.size("xs").cast("long").alias("entries"), F.concat_ws("\n", F.concat(F.lit("# "), F.col("day").cast("string"), F.lit(" ("), F.size("xs"), F.lit(")")), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("overview"))
