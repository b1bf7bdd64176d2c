"""A stored text index: postings and lengths as tables, with upserts and deletes (X2, X6-X8), and the search router over entries and atoms.

Tables are immutable, so an upsert or a delete gives the next version. Postings are written sorted by term; a query reads the row
groups of its terms, and no text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import retrieval as R
from tessera.operators.graph import checkpointed


@dataclass(frozen=True)
class TextIndex:
    """postings: id, term, tf, dl; lengths: id, dl for every document, also those without terms.

    parts: what the postings are made of, as (postings, ids that are hidden in them); a search leaves other terms out before it hides any.
    """

    postings: DataFrame
    lengths: DataFrame
    parts: tuple[tuple[DataFrame, DataFrame | None], ...] = ()

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        return cls(R.postings(docs, id_col, text_col), docs.select(F.col(id_col).alias("id"), S.bm25_length(text_col).cast("int").alias("dl")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    def delete(self, ids: DataFrame) -> TextIndex:
        """Without the ids (id), whose postings and lengths leave the statistics too."""
        gone = ids.select("id")
        parts = tuple((p, gone if hidden is None else hidden.unionByName(gone)) for p, hidden in self._parts())
        return TextIndex(_living(parts), self.lengths.join(gone, "id", "left_anti").select("id", "dl"), parts)

    def _parts(self) -> tuple[tuple[DataFrame, DataFrame | None], ...]:
        return self.parts or ((self.postings, None),)

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """docs replace what the index holds under their ids, so a document that comes again counts once."""
        new, rest = TextIndex.of(docs, id_col, text_col), self.delete(docs.select(F.col(id_col).alias("id")))
        parts = rest._parts() + new._parts()
        return TextIndex(_living(parts), rest.lengths.unionByName(new.lengths), parts)

    def stats(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total_length"), F.avg("dl").alias("avgdl"))

    def search(self, queries: DataFrame, limit: int = 10, min_score: float = 0.1) -> DataFrame:
        """queries: query_id, text. (query_id, id, score, rank)."""
        wanted = R.query_terms(queries)
        terms = R.few(wanted.select("term").distinct())
        return R.scored_terms(_living(tuple((p.join(terms, "term", "left_semi"), hidden) for p, hidden in self._parts())), self.stats(), wanted, limit, min_score)


def _living(parts: tuple[tuple[DataFrame, DataFrame | None], ...]) -> DataFrame:
    """The postings of all parts without those of hidden ids."""
    rows = [p if hidden is None else p.join(hidden, "id", "left_anti") for p, hidden in parts]
    return reduce(DataFrame.unionByName, [r.select("id", "dl", "term", "tf") for r in rows])


def searchable(entities: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, scope, type, text) of entries, and of atoms as `entity/atom`. entities: id, type, content; atoms: entity_id, local_id, type, name, content."""
    e = entities.select(F.col("id").cast("string").alias("id"), F.lit("entity").alias("scope"), "type", F.coalesce("content", F.lit("")).alias("text"))
    a = atoms.select(F.concat_ws("/", "entity_id", "local_id").alias("id"), F.lit("atom").alias("scope"), "type", F.concat_ws(" ", "name", "content").alias("text"))
    return e.unionByName(a)


def routed_search(entities: DataFrame, atoms: DataFrame, query: str, scope: str = "all", atom_types: list[str] | None = None, limit: int = 10, min_score: float = 0.1) -> DataFrame:
    """(id, scope, type, score, rank). scope: all, entity or atom; a search among atoms without a hit goes on among all.

    atom_types: the types of atoms that count. Terms are the tokenizer's, so they may be Chinese as well.
    """
    if scope not in ("all", "entity", "atom"):
        raise ValueError(f"scope is 'all', 'entity' or 'atom', not {scope!r}")
    rows = searchable(entities, atoms)
    if atom_types is not None:
        rows = rows.where((F.col("scope") == "entity") | F.col("type").isin(atom_types))
    asked = entities.sparkSession.createDataFrame([(0, query)], "query_id int, text string")

    def hits(wanted: DataFrame) -> DataFrame:
        found = R.bm25_batch(wanted, asked, limit, min_score, "id")
        return found.join(wanted.select("id", "scope", "type"), "id").select("id", "scope", "type", "score", "rank")

    if scope == "all":
        return hits(rows)
    found = hits(rows.where(F.col("scope") == scope))
    return hits(rows) if scope == "atom" and found.isEmpty() else found


def routed(
    entities: DataFrame, atoms: DataFrame, query: str, mode: str = "hybrid", scope: str = "all", atom_types: list[str] | None = None, limit: int = 10, level: int = 0, threshold: float | None = None,
    vectors: DataFrame | None = None, query_vector: list[float] | None = None,
) -> DataFrame:
    """The whole router: (id, scope, type, score, rank, shown).

    mode: keyword, vector, or hybrid, which sums both and is a keyword search where there is no vector. scope, atom_types: as routed_search has them;
    atoms without a hit are searched again among all, of every type. threshold: the least score, else the default of mode and scope.
    Of results with one local id (an atom in several entities) the best stays. level: how much of a result's text is shown (0 abstract or
    name, 1 and 2 more of the overview or content). entities: id, type, abstract, overview, content; vectors: id (as in the result), embedding.
    """
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"mode is 'keyword', 'vector' or 'hybrid', not {mode!r}")
    if scope not in ("all", "entity", "atom"):
        raise ValueError(f"scope is 'all', 'entity' or 'atom', not {scope!r}")
    near = vectors is not None and query_vector is not None
    if mode == "vector" and not near:
        raise ValueError("a vector search takes vectors and a query_vector")
    least = R.default_threshold(mode, scope) if threshold is None else threshold
    rows = searchable(entities, atoms)
    asked = R.terms_of(entities.sparkSession, query)
    every = 1 << 30

    def hits(wanted: DataFrame) -> DataFrame:
        # all hits of one query: unranked, since one ranking of them would be one task's
        words = R.bm25_search(wanted, asked, None, 0.0, "id") if mode != "vector" else None
        some = R.vector_search(vectors.join(wanted.select("id"), "id", "left_semi"), query_vector, None, -1.0 if mode == "hybrid" else least, "id") if near and mode != "keyword" else None
        if words is None:
            found = some
        elif some is None:
            found = words
        else:
            found = R.hybrid(some.where(F.col("score") >= R.default_threshold("vector", scope)), words, limit=every)
        local = F.element_at(F.split("id", "/"), -1)
        best = R.keep_first(found.where(F.col("score") >= least).withColumn("__local", local), ["__local"], [F.round("score", 6).desc(), F.col("id")]).drop("__local")
        top = best.orderBy(F.round("score", 6).desc(), "id").limit(limit)
        return R.ranked(top).join(wanted.select("id", "scope", "type"), "id").select("id", "scope", "type", "score", "rank")

    chosen = rows if scope == "all" else rows.where(F.col("scope") == scope)
    if atom_types:
        chosen = chosen.where((F.col("scope") == "entity") | F.col("type").isin(atom_types))
    found = checkpointed(hits(chosen))
    if scope == "atom" and found.isEmpty():
        found = checkpointed(hits(rows))
    label = entities.select(F.col("id").cast("string").alias("id"), "abstract", "overview").unionByName(atoms.select(F.concat_ws("/", "entity_id", "local_id").alias("id"), F.col("name").alias("abstract"), F.col("content").alias("overview")))
    # found has at most `limit` rows
    return label.join(F.broadcast(found), "id").select("id", "scope", "type", "score", "rank", R.display_text("abstract", "overview", level, True).alias("shown"))


def names_and_abstracts(entities: DataFrame, atoms: DataFrame, query: str, limit: int = 10, width: int = 50) -> DataFrame:
    """Suggestions by keyword search: distinct beginnings of the abstracts and names of what is found."""
    hits = routed_search(entities, atoms, query, limit=limit)
    label = entities.select(F.col("id").cast("string").alias("id"), F.col("abstract").alias("label")).unionByName(atoms.select(F.concat_ws("/", "entity_id", "local_id").alias("id"), F.col("name").alias("label")))
    return hits.join(label, "id").where("label <> ''").select(F.substring("label", 1, width).alias("suggestion")).distinct().orderBy("suggestion").limit(limit)
