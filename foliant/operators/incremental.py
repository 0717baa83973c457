"""Incremental operators: change detection, upserts, outbox and overlay, retention, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(known: DataFrame, seen: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """(key, change) by a full outer join: new, changed, unchanged or removed; signatures are compared null-safely."""
    a = known.select(key, F.struct(*signature).alias("was"))
    b = seen.select(key, F.struct(*signature).alias("now"))
    same = F.col("was").eqNullSafe(F.col("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def removed(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return known.select(key).join(seen.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; missing columns are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row per key; ranked to one before the shuffle."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def overlay(snapshot: DataFrame, pending: DataFrame, key: str, op: str, columns: list[str]) -> DataFrame:
    """Snapshot with the overlay on top: a delete drops, other operations replace or add."""
    over = pending.select(key, F.col(op).alias("_op"), *[F.col(c).alias(f"_{c}") for c in columns])
    merged = snapshot.join(over, key, "full_outer").where("_op IS NULL OR _op <> 'delete'")
    return merged.select(key, *[F.when(F.col("_op").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def overlay_state(keys: DataFrame, outbox: DataFrame, key: str, conflict: Column, pending: Column) -> DataFrame:
    """(key, state): conflict before pending before awaiting_snapshot."""
    flags = outbox.groupBy(key).agg(F.max(conflict).alias("c"), F.max(pending).alias("p"))
    state = F.when(F.col("c"), "conflict").when(F.col("p"), "pending").otherwise("awaiting_snapshot")
    return keys.join(flags, key, "left").select(key, state.alias("state"))


def retained(generations: DataFrame, component: str, order: list[Column], keep: int = 4) -> DataFrame:
    return generations.withColumn("rank", F.row_number().over(Window.partitionBy(component).orderBy(*order))).where(F.col("rank") <= keep)


def unprotected(cache: DataFrame, protections: list[tuple[DataFrame, str]]) -> DataFrame:
    """Cache rows that no (table, key) protects: an anti join for each."""
    for protected, key in protections:
        cache = cache.join(protected.select(key), key, "left_anti")
    return cache


def idempotency(requests: DataFrame, key: list[str], request_hash: Column) -> DataFrame:
    """(key, requests, verdict): once, replay of one hash, or conflict of several."""
    sums = requests.groupBy(*key).agg(F.count("*").alias("requests"), F.count_distinct(request_hash).alias("hashes"))
    return sums.select(*key, "requests", F.when(F.col("hashes") > 1, "conflict").when(F.col("requests") > 1, "replay").otherwise("once").alias("verdict"))


def numbered(entries: DataFrame, key: str, order: list[Column], start: DataFrame | None = None) -> DataFrame:
    """entries with the next entry_number per key, on from the highest number in start (key, highest)."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if start is None:
        return entries.withColumn("entry_number", at)
    rows = entries.withColumn("_at", at).join(start.select(key, "highest"), key, "left")
    return rows.withColumn("entry_number", F.col("_at") + F.coalesce("highest", F.lit(0))).drop("_at", "highest")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond b's copies with side 'left', and of b beyond a's with side 'right'."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def recent_distinct(history: DataFrame, term: Column, at: Column, limit: int = 20) -> DataFrame:
    """Most recently used terms, equal ones once."""
    return history.groupBy(term.alias("term")).agg(F.max(at).alias("used")).orderBy(F.desc("used"), "term").limit(limit)


def manifest_mismatches(manifest: DataFrame, files: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem) where a listed file is missing or differs, or a file is not listed."""
    a = manifest.select(key, F.struct(*columns).alias("want"))
    b = files.select(key, F.struct(*columns).alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(~F.col("want").eqNullSafe(F.col("have")), "differs")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")
