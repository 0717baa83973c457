"""The life of suggestions: from evidence to candidates, their review, decisions, duplicates and stale ones, as merges of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITIES, DECIDED = ("strong", "review"), ("accepted", "rejected")


def quality_rank(quality: Column) -> Column:
    """0 strong, 1 review, 2 anything else."""
    return F.when(quality == "strong", 0).when(quality == "review", 1).otherwise(2)


def candidate_key(*parts: Column) -> Column:
    """Hash of a JSON array of texts, null as empty."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def canonical_payload(payload: Column) -> Column:
    """JSON of a map of texts in the order of its keys: values trimmed and lower-cased, empty ones, 'id' and 'address_kind' left out."""
    folded = F.transform_values(payload, lambda k, v: F.trim(F.regexp_replace(F.lower(v), r"\s+", " ")))
    kept = F.map_filter(folded, lambda k, v: ~k.isin("id", "address_kind") & (F.coalesce(v, F.lit("")) != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def visible(found: DataFrame, status: str | None = None, groups: bool = True) -> DataFrame:
    """Suggestions (status, lifecycle, superseded_by, kind) to show: none superseded, pending ones only while active, address groups on demand."""
    rows = found.where(F.col("superseded_by").isNull() & ((F.col("status") != "pending") | (F.col("lifecycle") == "active")))
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if groups else rows.where("kind <> 'address_group'")


def upsert(known: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Suggestions (key, quality, sources, status, revision) after evidence (key, quality, source): new ones are pending at revision 1.

    A known one takes the better quality and the greater number of sources, and its revision rises if anything changed;
    decided ones keep their status.
    """
    rank = quality_rank(F.col("quality"))
    fresh = evidence.groupBy(*key).agg(F.min(rank).alias("_rank"), F.count_distinct("source").alias("_sources"))
    both = known.join(fresh, key, "full_outer")
    was = quality_rank(F.col("quality"))
    best = F.when(F.col("quality").isNull(), F.col("_rank")).otherwise(F.least(was, F.coalesce("_rank", was)))
    sources = F.greatest(F.coalesce("sources", F.lit(0)), F.coalesce("_sources", F.lit(0)))
    changed = (best != was) | (sources != F.col("sources"))
    quality = F.when(best == 0, "strong").when(best == 1, "review").otherwise(F.coalesce("quality", F.lit("other")))
    revision = F.when(F.col("revision").isNull(), 1).otherwise(F.col("revision") + F.when(changed, 1).otherwise(0))
    return both.select(*key, quality.alias("quality"), sources.cast("long").alias("sources"), F.coalesce("status", F.lit("pending")).alias("status"), revision.cast("long").alias("revision"))


def unique_match(found: DataFrame, evidence: DataFrame, suggestion: str, on: list[str]) -> DataFrame:
    """(on, suggestion) where active evidence leads to exactly one suggestion."""
    rows = found.join(evidence.where("active"), suggestion).select(*on, suggestion).distinct()
    return rows.groupBy(*on).agg(F.min(suggestion).alias(suggestion), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def finalise(evidence: DataFrame, run: Column, evaluated: DataFrame, existing: DataFrame, suggestion: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(evidence with `active`, stale suggestions) after a run.

    Evidence ends where its source is gone, or where its source was evaluated and the run has not seen it. A suggestion
    without active evidence is stale.
    """
    rows = evidence.join(existing.select(source).distinct().withColumn("_there", F.lit(True)), source, "left")
    rows = rows.join(evaluated.select(source).distinct().withColumn("_read", F.lit(True)), source, "left")
    active = F.col("active") & F.col("_there").isNotNull() & ~(F.col("_read").isNotNull() & ~run)
    rows = rows.withColumn("active", F.coalesce(active, F.lit(False))).drop("_there", "_read")
    return rows, rows.groupBy(suggestion).agg(F.max("active").alias("_any")).where("NOT _any").select(suggestion)


def canonical(found: DataFrame, key: list[str], status: str, number: str) -> DataFrame:
    """found with winner, the number of the one that stands for all of its key: decided ones first, then the smallest number."""
    rank = F.when(F.col(status).isin(*DECIDED), 0).otherwise(1)
    best = found.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), F.col(number).alias("number"))).alias("_best"))
    return found.join(best, key).withColumn("winner", F.col("_best.number")).drop("_best")


def absorb(found: DataFrame, key: list[str], status: str, number: str) -> DataFrame:
    """found with superseded_by: the winner of its key for all others, null for the winner."""
    rows = canonical(found, key, status, number)
    return rows.withColumn("superseded_by", F.when(F.col("winner") != F.col(number), F.col("winner"))).drop("winner")


def decide(found: DataFrame, decisions: DataFrame, number: str) -> DataFrame:
    """Outcome of decisions (number, revision, action, value) on suggestions (number, revision, status, current): one row per decision.

    unknown, stale (another revision), repeated (already so), conflict (accepted while the field holds another value), else applied.
    """
    rows = decisions.withColumnRenamed("revision", "_revision").join(found, number, "left")
    to = F.when(F.col("action") == "accept", "accepted").otherwise("rejected")
    taken = (F.col("action") == "accept") & (F.coalesce("current", F.lit("")) != "") & (F.col("current") != F.col("value"))
    outcome = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == to, "repeated").when(F.col("revision") != F.col("_revision"), "stale").when(taken, "conflict").otherwise("applied")
    return rows.select(number, "action", outcome.alias("outcome"), F.when(outcome == "applied", to).otherwise(F.col("status")).alias("status"))


def revalidate(pending: DataFrame, value: Column) -> DataFrame:
    """Pending suggestions with their value normalised anew, invalid where nothing is left of it."""
    return pending.withColumn("value", value).withColumn("lifecycle", F.when(F.coalesce("value", F.lit("")) == "", "invalid").otherwise(F.col("lifecycle")))


def top_evidence(evidence: DataFrame, suggestion: str, quality: str, number: str, most: int = 50) -> DataFrame:
    """The `most` best pieces of evidence of each suggestion, by quality and number, with their place."""
    place = F.row_number().over(Window.partitionBy(suggestion).orderBy(quality_rank(F.col(quality)), number))
    return evidence.withColumn("place", place).where(F.col("place") <= most)


def case_status(cases: DataFrame, decisions: DataFrame, signature: str, order: list[str]) -> DataFrame:
    """cases with status and conflict: the first decision stands, repeats of it change nothing, other actions are a conflict."""
    first = decisions.groupBy(signature).agg(F.min_by("action", F.struct(*order)).alias("first"), (F.count_distinct("action") > 1).alias("conflict"))
    rows = cases.join(first, signature, "left")
    status = F.when(F.col("first").isNull(), "pending").when(F.col("first") == "reject", "rejected").otherwise("resolved")
    return rows.withColumn("status", status).withColumn("conflict", F.coalesce("conflict", F.lit(False))).drop("first")


def keep_decided(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Cases seen again: (key, status), the known status where it was decided, else the one now seen."""
    rows = seen.join(known.select(key, F.col("status").alias("_was")), key, "left")
    return rows.select(key, F.when(F.col("_was").isin("resolved", "rejected"), F.col("_was")).otherwise(F.col("status")).alias("status"))


def recognition_state(enabled: Column, projects: Column, documents: Column, supported: Column, read: Column, failed: Column, candidates: Column) -> Column:
    """Why a customer has the suggestions it has: the first reason that holds."""
    return (
        F.when(~enabled, "disabled").when(projects == 0, "no_projects").when(documents == 0, "no_documents").when(supported == 0, "unsupported").when(read == 0, "no_text")
        .when(failed > 0, "partial").when(candidates > 0, "review").otherwise("no_candidates")
    )
