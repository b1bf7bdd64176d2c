"""The knowledge base as one object: twenty tools over DataFrames of entries, atoms and edges.

Every tool returns a DataFrame (or a new KnowledgeBase for writes). Most run when they are read; search, recommend, the graph and the
trees look at the data while they plan. Writes make a new version, as Parquet has no MERGE: tables are immutable, and save() publishes them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import browse as B
from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.operators import quality as Q
from tessera.operators import recommend as C
from tessera.operators import retrieval as R
from tessera.operators import sync as Y
from tessera.sources import versions as V

ENTITY = "id string, type string, tags array<string>, project string, abstract string, overview string, content string, date timestamp, synced boolean, pinned boolean"
ATOM = "entity_id string, local_id string, parent_id string, name string, content string, heading_level int, `order` string"
EDGE = "from_id string, to_id string, type string, weight double"

TABLES = ("entities", "atoms", "edges")


@dataclass(frozen=True)
class KnowledgeBase:
    spark: SparkSession
    entities: DataFrame
    atoms: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> KnowledgeBase:
        return cls(spark, *(spark.createDataFrame([], s) for s in (ENTITY, ATOM, EDGE)))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> KnowledgeBase:
        """The last version that save() published at path, or the one that is named."""
        number, tables = V.read(spark, path, version)
        if not number:
            raise FileNotFoundError(f"no knowledge base is published at {path}")
        return cls(spark, *(spark.read.parquet(f"{path}/{tables[t]}") for t in TABLES))

    def save(self, path: str) -> int:
        """Publishes the tables as one version, and returns its number. They may have been loaded from the same path.

        Tables go to folders of their own first; a reader sees all of the new ones or all of the old ones. Versions before the last two are deleted.
        """
        last, _ = V.read(self.spark, path)
        tables = {}
        for name in TABLES:
            tables[name] = V.folder(path, name).removeprefix(f"{path}/")
            getattr(self, name).write.parquet(f"{path}/{tables[name]}")
        number = V.publish(self.spark, path, tables, last)
        V.removed_before(self.spark, path, number - 1)
        return number

    # Entries
    def write(self, entries: DataFrame) -> KnowledgeBase:
        """Adds or replaces entries; those with a reason against them are left out (see problems)."""
        good = entries.where(F.size(F.filter(B.entry_problems(), lambda p: ~p.endswith("long"))) == 0)
        return replace(self, entities=Y.upsert(self.entities, good.select(*self.entities.columns), ["id"]))

    def problems(self, entries: DataFrame) -> DataFrame:
        return entries.select("id", B.entry_problems().alias("problems"))

    def pin(self, id_: str, pinned: bool = True) -> KnowledgeBase:
        return replace(self, entities=self.entities.withColumn("pinned", F.when(F.col("id") == id_, F.lit(pinned)).otherwise(F.col("pinned"))))

    def read(self, id_: str, level: int = 2) -> DataFrame:
        """An entry, or an atom by `entity/atom`."""
        if "/" in id_:
            entity, atom = id_.split("/", 1)
            return self.atoms.where((F.col("entity_id") == entity) & (F.col("local_id") == atom))
        return self.entities.where(F.col("id") == id_).select("id", "type", *B.at_level(level))

    def entity_update(self, entity_id: str, operations: DataFrame) -> DataFrame:
        return H.applied_operations(self.atoms.where(F.col("entity_id") == entity_id), operations)

    def entity_atoms(self, entity_id: str) -> DataFrame:
        return H.tree_paths(self.atoms.where(F.col("entity_id") == entity_id))

    # Context
    def context_budget(self, query: str, max_tokens: int, strategy: str = "relevance") -> DataFrame:
        """For every entity the atoms that fit the budget."""
        terms = _terms(self.spark, query)
        scored = R.bm25_within(self.atoms, terms) if terms else self.atoms.select("entity_id", F.col("local_id").alias("id"), F.lit(0.0).alias("score"))
        a = self.atoms.join(scored.withColumnRenamed("id", "local_id"), ["entity_id", "local_id"])
        a = a.withColumns({"relevance": R.relevance("score", "name", query, "heading_level"), "tokens": S.estimate_tokens("content")})
        return R.budget_select(a, max_tokens, strategy)

    def context_level(self, entity_id: str, max_level: int) -> DataFrame:
        return H.level_filter(self.atoms.where(F.col("entity_id") == entity_id), max_level)

    # Search
    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Keyword search; weighted substrings where no keyword matches, which takes a look at the hits."""
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        hits = R.bm25_batch(self.entities, asked, limit, id_col="id", text_col="content").select("id", "score")
        return hits if not hits.isEmpty() else R.weighted_search(self.entities, query, limit).select("id", "score")

    def suggest(self, word: str, limit: int = 10) -> DataFrame:
        return R.suggestions(self.entities, word, limit)

    def index_status(self) -> DataFrame:
        """Documents, terms and lengths of the text index, and the entries that wait for sync."""
        return R.corpus_stats(self.entities, "content").join(F.broadcast(B.unsynced(self.entities).agg(F.count("*").alias("pending"))))

    # Graph
    def relate(self, edges: DataFrame) -> KnowledgeBase:
        return replace(self, edges=G.add_edges(self.edges, edges.fillna(0.5, ["weight"])))

    def graph(self, start: str, depth: int = 2) -> DataFrame:
        return G.traverse(self.edges, self.spark.createDataFrame([(start,)], "id string"), depth)

    def recommend(self, k: int = 3) -> DataFrame:
        return C.same_type(self.entities, self.edges, k)

    # Browsing
    def timeline(self, per_day: int = 10) -> DataFrame:
        return B.per_day(self.entities, per_day, "date", "id")

    def topics(self, least: int = 1) -> DataFrame:
        return B.topic_counts(self.entities, least)

    def recent(self, limit: int = 20) -> DataFrame:
        return B.recent(self.entities, limit)

    # Sync
    def status(self) -> DataFrame:
        return self.entities.agg(F.count("*").alias("entries"), F.count_if("synced").alias("synced"), F.count_if(~F.coalesce("synced", F.lit(False))).alias("pending"))

    def fingerprints(self) -> DataFrame:
        return self.entities.select(F.col("id").alias("source_id"), S.short_hash("content").alias("hash"))

    def sync_preview(self, server: DataFrame) -> DataFrame:
        return Y.sync_preview(self.fingerprints(), server)

    def full_sync(self, server: DataFrame) -> KnowledgeBase:
        """Marks what the server holds in the same version as synced."""
        same = self.sync_preview(server).where("action = 'same'").select(F.col("source_id").alias("id"), F.lit(True).alias("__s"))
        return replace(self, entities=self.entities.join(same, "id", "left").withColumn("synced", F.coalesce("__s", F.lit(False))).drop("__s").select(*self.entities.columns))

    def incremental_sync(self, server: DataFrame, files: DataFrame | None = None, accepted: DataFrame | None = None) -> tuple[KnowledgeBase, DataFrame]:
        """(the base after it, the run: source_id, action, status). Entries that the server took or holds as they are count as synced; a dry run (accepted None) changes nothing.

        server: source_id, hash; files: source_id of the entries whose file is there; accepted: source_id of what the server took.
        """
        run = Y.synced_incrementally(self.fingerprints(), server, files, accepted)
        if accepted is None:
            return self, run
        now = run.select(F.col("source_id").alias("id"), F.when(F.col("status").isin("uploaded", "unchanged"), True).when(F.col("status") == "failed", False).alias("__s"))
        entities = self.entities.join(now, "id", "left").withColumn("synced", F.coalesce("__s", "synced", F.lit(False))).select(*self.entities.columns)
        return replace(self, entities=entities), run

    def conflicts(self, server: DataFrame) -> DataFrame:
        return self.sync_preview(server).where("action = 'conflict'")

    def rebuild_index(self, accepted: DataFrame | None = None) -> DataFrame:
        """What pushing all unsynced entries did, or would do: accepted holds the ids that the server took."""
        return Y.rebuilt(self.entities, accepted)

    def conflict_resolve(self, server: DataFrame, policy: str) -> DataFrame:
        """server: source_id, hash, content. (source_id, local, server, resolved) of entries that differ."""
        local = self.entities.select(F.col("id").alias("source_id"), F.col("content").alias("local"))
        both = self.conflicts(server.select("source_id", "hash")).select("source_id").join(local, "source_id").join(server.select("source_id", F.col("content").alias("server")), "source_id")
        return Y.resolved_conflicts(both, policy)

    def sync_checkpoint(self, server: DataFrame, limit: int = 20) -> DataFrame:
        return Y.checkpoints(server, limit)

    # Atoms
    def add_atoms(self, atoms: DataFrame) -> KnowledgeBase:
        return replace(self, atoms=Y.upsert(self.atoms, atoms.select(*self.atoms.columns), ["entity_id", "local_id"]))

    def remove_atoms(self, keys: DataFrame) -> KnowledgeBase:
        """keys: entity_id, local_id."""
        return replace(self, atoms=self.atoms.join(keys, ["entity_id", "local_id"], "left_anti").select(*self.atoms.columns))

    # Quality
    def quality(self, accuracy: float = 1.0) -> DataFrame:
        return Q.health_scores(Q.network_metrics(self.entities.select("id"), self.edges), F.lit(accuracy)).withColumn("orphan_rate", Q.orphan_rate()).withColumn("warnings", Q.warnings_of())

    def health_check(self, accuracy: float = 1.0, **limits) -> DataFrame:
        return Q.health_check(self.entities, self.edges, F.lit(accuracy), **limits)

    def diagnose(self) -> DataFrame:
        return Q.diagnosed(self.entities.select("id", "abstract"), self.edges)


def _terms(spark: SparkSession, query: str) -> list[str]:
    """The terms that a search of the same query has."""
    return spark.range(1).select(S.bm25_tokens(F.lit(query)).alias("t")).first()["t"]
