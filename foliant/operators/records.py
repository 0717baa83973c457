"""Records with revisions, several columns and children: batches of creates, updates and deletes; tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import staged
from .structure import numbered_in_order


@dataclass
class Applied:
    """records (key, columns, revision) and children by name after a batch, and (key, op, outcome, revision) of each change."""

    records: DataFrame
    children: dict[str, DataFrame]
    outcomes: DataFrame


def apply_changes(known: DataFrame, changes: DataFrame, key: str, columns: list[str], children: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> Applied:
    """Apply changes (key, op, revision, columns) to known (key, columns, revision), at most one change a key.

    `create` needs a key that is not there, `update` and `delete` one that is there with the revision that they name: else the outcome
    is `exists`, `unknown` or `conflict`, and nothing of the change holds. A null column of an update leaves what was there. children
    maps a name to (known rows, given rows), both with key: a created or updated record has the given rows instead of its old ones where any are
    given, and a deleted one has none.
    """
    was = known.select(key, F.struct(*columns).alias("_was"), F.col("revision").alias("_revision"))
    new = changes.select(key, "op", F.struct(*columns).alias("_new"), F.col("revision").alias("_expects"))
    rows = was.join(new, key, "full_outer")
    there, fits = F.col("_revision").isNotNull(), F.col("_expects").eqNullSafe(F.col("_revision"))
    bad = F.when((F.col("op") == "create") & there, "exists").when((F.col("op") != "create") & ~there, "unknown").when((F.col("op") != "create") & ~fits, "conflict")
    good = F.when(F.col("op") == "create", "created").when(F.col("op") == "update", "updated").when(F.col("op") == "delete", "deleted")
    rows = staged(rows.withColumn("outcome", F.when(F.col("op").isNotNull(), F.coalesce(bad, good))))
    set_ = F.coalesce(F.col("outcome").isin("created", "updated"), F.lit(False))
    value = lambda c: F.when(set_, F.coalesce(F.col(f"_new.{c}"), F.col(f"_was.{c}"))).otherwise(F.col(f"_was.{c}")).alias(c)
    revision = F.when(set_, F.coalesce("_revision", F.lit(0)) + 1).otherwise(F.col("_revision")).cast("long").alias("revision")
    stays = (there | set_) & ~F.coalesce(F.col("outcome") == "deleted", F.lit(False))
    records = rows.where(stays).select(key, *[value(c) for c in columns], revision)
    outcomes = rows.where("op IS NOT NULL").select(key, "op", "outcome", revision)
    changed, gone = rows.where(set_).select(key), rows.where("outcome = 'deleted'").select(key)
    out = {}
    for name, (old, given) in (children or {}).items():
        held = given.join(changed, key, "left_semi")
        out[name] = old.join(gone.union(held.select(key)).distinct(), key, "left_anti").unionByName(held)
    return Applied(records, out, outcomes)


def tagged(names: DataFrame, key: str, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, links): tags (id, name) with those that names (key, tag) bring, and links (key, id), each once.

    Tags are told apart without case; the first spelling in order stays. New ones get the next numbers in the order of their names.
    """
    clean = names.select(key, F.trim("tag").alias("tag")).where("tag <> ''").withColumn("_fold", text.ascii_fold(F.col("tag")))
    known = tags.withColumn("_fold", text.ascii_fold(F.col("name")))
    new = clean.groupBy("_fold").agg(F.min("tag").alias("name")).join(known.select("_fold"), "_fold", "left_anti")
    high = tags.agg(F.max("id")).first()[0] or 0
    every = staged(known.select("id", "name", "_fold").unionByName(numbered_in_order(new, ["_fold"], high).select("id", "name", "_fold")))
    return every.select("id", "name"), clean.join(every.select("_fold", "id"), "_fold").select(key, "id").distinct()


def tag_lists(records: DataFrame, key: str, links: DataFrame, tags: DataFrame) -> DataFrame:
    """records (key) with tags, the names of each, sorted without case; an empty array where there are none."""
    fold = F.struct(text.ascii_fold(F.col("name")).alias("f"), "name")
    lists = links.join(tags, "id").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(fold)), lambda t: t["name"]).alias("tags"))
    return records.join(lists, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
