"""Change data: graph diffs, fingerprints, conflicts, upserts, retry queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.graph import dealt
from tessera.operators.vectors import VectorLists


def node_diff(old: DataFrame, new: DataFrame, key: str = "id", hash_col: str = "hash") -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by a full outer join."""
    o, n = old.select(key, F.col(hash_col).alias("__o")), new.select(key, F.col(hash_col).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "changed").otherwise("unchanged")
    return o.join(n, key, "full").select(key, change.alias("change"))


def link_diff(old: DataFrame, new: DataFrame, keys=("source", "target", "relation")) -> DataFrame:
    """(keys, change): the links that are in one of two sets only, each once; missing keys are equal.

    Both sides are dealt by key to tasks of a bounded number of rows and folded there at once, without a sort of either.
    """
    side = lambda links, change: links.select(*keys, F.lit(change).alias("change"))
    both = dealt(side(old, "removed").unionByName(side(new, "added")), *keys)
    one = both.groupBy(*keys).agg(F.min("change").alias("change"), F.max("change").alias("__other"))
    return one.where("change = __other").drop("__other")


def remappable(links: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Links that touch a changed node, each once."""
    c = changed.select(key).distinct()
    hit = links.join(c.withColumnRenamed(key, "source"), "source", "left_semi").select(*links.columns)
    return hit.unionByName(links.join(c.withColumnRenamed(key, "target"), "target", "left_semi").select(*links.columns)).distinct()


def sync_preview(local: DataFrame, server: DataFrame, key: str = "source_id") -> DataFrame:
    """upload (local only), delete (server only), conflict (hashes differ) or same. Inputs: key, hash."""
    l, s = local.select(key, F.col("hash").alias("l")), server.select(key, F.col("hash").alias("s"))
    action = F.when(F.col("s").isNull(), "upload").when(F.col("l").isNull(), "delete").when(F.col("l") != F.col("s"), "conflict").otherwise("same")
    return l.join(s, key, "full").select(key, action.alias("action"))


def resolved_conflicts(conflicts: DataFrame, policy: str) -> DataFrame:
    """conflicts: local, server. keep_local, keep_server, or merge (both)."""
    if policy not in ("keep_local", "keep_server", "merge"):
        raise ValueError(policy)
    value = {"keep_local": F.col("local"), "keep_server": F.col("server"), "merge": F.concat_ws("\n", "local", "server")}[policy]
    return conflicts.withColumn("resolved", value)


def fingerprint_status(now: DataFrame, cached: DataFrame) -> DataFrame:
    """new_file, content_changed, symbols_changed or unchanged, in this order. Inputs: path, content_hash, symbols_hash."""
    c = cached.select("path", F.col("content_hash").alias("c"), F.col("symbols_hash").alias("s"))
    status = F.when(F.col("c").isNull(), "new_file").when(F.col("content_hash") != F.col("c"), "content_changed").when(~F.col("symbols_hash").eqNullSafe(F.col("s")), "symbols_changed").otherwise("unchanged")
    return now.join(c, "path", "left").select("path", status.alias("status"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of the same key; a next version of the table."""
    return table.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key (ties: the greatest other values)."""
    others = [c for c in rows.columns if c not in (key, at)]
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in others])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pending(queue: DataFrame, limit: int = 3) -> DataFrame:
    return queue.where(F.col("retry_count") < limit)


def queue_stats(queue: DataFrame, limit: int = 3) -> DataFrame:
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("retry_count") < limit).alias("pending"), F.count_if(F.col("retry_count") >= limit).alias("exhausted"))


def after_attempt(queue: DataFrame, failed: DataFrame, done: DataFrame) -> DataFrame:
    """A queue (id, retry_count, ...) after a round: done ids leave, failed ids count one more try."""
    f = failed.select("id", F.lit(1).alias("__f"))
    return queue.join(done.select("id"), "id", "left_anti").join(f, "id", "left").withColumn("retry_count", F.col("retry_count") + F.coalesce("__f", F.lit(0))).drop("__f")


def unexpired(queue: DataFrame, as_of: Column, days: int = 7, at: str = "added_at") -> DataFrame:
    return queue.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def duplicates_on_upload(new: DataFrame, stored: DataFrame, text_col: str = "text") -> DataFrame:
    """New rows whose text is stored already, by hash."""
    return new.join(stored.select(F.sha2(text_col, 256).alias("__h")), F.sha2(text_col, 256) == F.col("__h"), "left_semi")


def similar_on_upload(new: DataFrame, stored: DataFrame, threshold: float = 0.95, vec_col: str = "embedding", id_col: str = "vec_id", reach: float = 1.0) -> DataFrame:
    """(id, duplicate_of): new vectors that nearly equal a stored one, by the stored ones' lists and the cosine; of several the first id.

    reach 2 finds all, the default nearly all (see vectors.py).
    """
    found = VectorLists.of(stored, id_col, vec_col).near(new, 1, threshold, reach, True, id_col, vec_col)
    return found.select(F.col("from_id").alias("id"), F.col("to_id").alias("duplicate_of"))


def rebuilt(entries: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(to_sync, synced, failed) of pushing every unsynced entry (id, synced); accepted: the ids that the server took, none on a dry run."""
    todo = entries.where("NOT coalesce(synced, false)").select("id")
    if accepted is None:
        return todo.agg(F.count("*").alias("to_sync"), F.lit(0).cast("long").alias("synced"), F.lit(0).cast("long").alias("failed"))
    done = todo.join(accepted.select("id", F.lit(True).alias("__ok")), "id", "left")
    return done.agg(F.count("*").alias("to_sync"), F.count("__ok").alias("synced"), F.count_if(F.col("__ok").isNull()).alias("failed"))


def incremental(local: DataFrame, server: DataFrame, present: DataFrame) -> DataFrame:
    """(source_id, action): what an incremental sync does with entries (source_id, hash): upload, skip (same), missing (no file), delete (server only)."""
    a = sync_preview(local, server).join(present.select("source_id", F.lit(True).alias("__file")), "source_id", "left")
    gone = F.col("__file").isNull() & (F.col("action") != "delete")
    return a.select("source_id", F.when(gone, "missing").when(F.col("action") == "same", "skip").when(F.col("action") == "delete", "delete").otherwise("upload").alias("action"))


def synced_incrementally(entries: DataFrame, server: DataFrame, present: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """(source_id, action, status): one incremental sync of entries (source_id, hash) with the server's (source_id, hash).

    present: source_id of entries whose file is there, all if None; accepted: the ids that the server took, None on a dry run. action as in
    incremental; status: pending (dry run), uploaded or failed of an upload; unchanged, skipped (no file), to_delete (reported, not done) of the rest.
    """
    actions = incremental(entries, server, entries if present is None else present)
    sent = F.lit("pending")
    if accepted is not None:
        actions = actions.join(accepted.select("source_id", F.lit(True).alias("__ok")).distinct(), "source_id", "left")
        sent = F.when(F.col("__ok"), "uploaded").otherwise("failed")
    status = F.when(F.col("action") == "upload", sent).when(F.col("action") == "skip", "unchanged").when(F.col("action") == "missing", "skipped").otherwise("to_delete")
    return actions.select("source_id", "action", status.alias("status"))


def sync_summary(run: DataFrame) -> DataFrame:
    """A row of counts, one column a status, and up_to_date: nothing was to upload or to delete."""
    names = ("uploaded", "failed", "pending", "to_delete", "skipped", "unchanged")
    counts = run.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    return counts.withColumn("up_to_date", sum((F.col(s) for s in names[:4]), F.lit(0)) == 0)


def full(local: DataFrame, server: DataFrame) -> DataFrame:
    """(source_id, action): upload, or duplicate where the server holds the hash under any id."""
    known = server.select("hash").distinct().withColumn("__k", F.lit(True))
    return local.join(known, "hash", "left").select("source_id", F.when(F.col("__k"), "duplicate").otherwise("upload").alias("action"))


def checkpoints(server: DataFrame, limit: int = 20) -> DataFrame:
    """The first fingerprints by id, cut for display, and the number of all."""
    total = server.agg(F.count("*").alias("total"))
    shown = server.orderBy("source_id").limit(limit).select("source_id", F.substring("hash", 1, 12).alias("hash"), F.substring("path", 1, 40).alias("path"))
    return shown.join(F.broadcast(total))


def written_then_synced(table: DataFrame, new: DataFrame, server: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with what the server took, the rows taken back): new rows (id, hash, ...) whose hash the server holds under another id are rolled back."""
    taken = server.select("hash", F.col("id").alias("__other"))
    lost = new.join(taken, "hash").where("id <> __other").select("id").distinct()
    return upsert(table, new.join(lost, "id", "left_anti").select(*table.columns), ["id"]), new.join(lost, "id", "left_semi")


def replayed(buffer: DataFrame, key: str, order: list[str], failed) -> DataFrame:
    """The items of each key that a replay in order sends before its first failure; the failed one and those after it stay buffered."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return buffer.withColumn("__f", F.max(failed.cast("int")).over(w)).where("__f = 0").drop("__f")


def scoped_delete(table: DataFrame, **scope) -> DataFrame:
    """Without the rows of a tenant or project: all given values must agree. Without a scope nothing goes."""
    if not scope:
        return table
    hit = F.lit(True)
    for k, v in scope.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return table.where(~hit)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("path"), S.short_hash(text_col).alias("content_hash"), S.symbols_hash(F.array_distinct(S.latin_tokens(text_col))).alias("symbols_hash"))
