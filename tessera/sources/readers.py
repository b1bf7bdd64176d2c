"""Sources (S1-S22): entry files, catalogs, graph files, state files, logs, project trees. All read by Spark's own readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = "nodes array<struct<id:string,label:string,source_file:string,source_location:string,file_type:string,community:int,norm_label:string>>, links array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,source_location:string>>"
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|coverage|__pycache__|\.next|vendor|target)/"
CODE = r"\.(js|mjs|cjs|jsx|ts|tsx|py|go|rs|java)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of whole files below path."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return f.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed_entries(files: DataFrame) -> DataFrame:
    """Entry files (path, text) as rows: frontmatter fields, sections, date from the path."""
    f = files.withColumn("fm", S.frontmatter("text"))
    get = lambda k: F.try_element_at("fm", F.lit(k)).alias(k)
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.try_element_at("fm", F.lit("tags")), F.lit("")), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return f.select(
        "path", *[get(k) for k in ("id", "date", "type", "project", "memory_id", "source_id", "meta")], (F.try_element_at("fm", F.lit("synced")) == "true").alias("synced"), tags.alias("tags"), S.date_of_path("path").alias("day"),
        S.section("text", "Abstract").alias("abstract"), S.section("text", "Overview").alias("overview"), S.section("text", "Contents").alias("content"),
        F.from_json(F.nullif(S.section("text", "Atoms"), F.lit("")), "array<struct<local_id:string,parent_id:string,type:string,name:string,content:string,heading_level:int>>").alias("atoms"),
    )


def entries(spark: SparkSession, path: str) -> DataFrame:
    return parsed_entries(text_files(spark, path))


def catalogued(catalog: DataFrame, files: DataFrame, key: str = "path", fields=("type", "abstract", "overview")) -> DataFrame:
    """Catalog rows whose file exists; a file's field overrides the catalog's if it isn't empty."""
    f = files.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    j = catalog.join(f, key)
    return j.select(*[c for c in catalog.columns if c not in fields], *[F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) for c in fields])


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links); a file without both arrays is refused."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    if g.where("nodes IS NULL OR links IS NULL").limit(1).count():
        raise ValueError(f"{path} has no nodes or no links")
    return g.select(F.inline("nodes")), g.select(F.inline("links"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON state file; missing or corrupt ones are empty."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def log_entries(files: DataFrame, least: int = 0) -> DataFrame:
    """Logs split at '## ' headings, with their **Date**, **Type**, **Tags**, **Project** fields; entries without a date are dropped."""
    parts = files.select("path", F.posexplode(F.split("text", r"(?:^|\n)## ")).alias("n", "body"))
    get = lambda k: F.nullif(F.trim(F.regexp_extract("body", rf"\*\*{k}\*\*:\s*([^\n]+)", 1)), F.lit(""))
    e = parts.where(~F.col("body").startswith("# ") & (F.length("body") >= least))
    return e.select("path", "n", "body", get("Date").alias("date"), get("Type").alias("type"), get("Tags").alias("tags"), get("Project").alias("project"), get("Memory ID").alias("memory_id")).where("date IS NOT NULL")


def project_files(files: DataFrame, max_lines: int | None = 1000) -> DataFrame:
    """Code files of a tree: skipped folders and other extensions left out, long files too."""
    f = files.where(~F.col("path").rlike(SKIPPED) & F.col("path").rlike(CODE))
    return f if max_lines is None else f.where(F.regexp_count("text", F.lit("\n")) < max_lines)


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def by_atom(entries_: DataFrame, local_id: str) -> DataFrame:
    return entries_.where(F.exists("atoms", lambda a: a["local_id"] == local_id))


def json_field(column: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(column), path, kind)
