"""Sync of a tree of folders with stable numbers: what stays keeps its number, what is new gets the next ones, what is gone goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import staged


def folders_of(files: DataFrame, path: Column, source: Column | None = None) -> DataFrame:
    """(source, path, name, parent, depth) of all folders above the files, each once; parent is null at the top."""
    source = F.lit("") if source is None else source
    rows = files.select(source.alias("source"), F.explode(paths.ancestors(path)).alias("path")).distinct()
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    return rows.select("source", "path", F.element_at(parts, -1).alias("name"), parent.alias("parent"), F.size(parts).alias("depth"))


def numbered_in_order(rows: DataFrame, order: list[str], high: int, name: str = "id") -> DataFrame:
    """rows with high + 1, high + 2, ... in an order, given out in parallel.

    Rows are sorted by ranges and written with their place in their partition; a partition's numbers begin behind those of the
    partitions before it, of which there is one count each.
    """
    at = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = at.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # one row a partition
    offsets = counts.select("_part", before.alias("_before"))
    numbers = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + high + 1
    return at.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part").select(*rows.columns, numbers.alias(name))


def sync(known: DataFrame | None, seen: DataFrame, high: int = 0) -> DataFrame:
    """(id, source, path, name, parent_id, depth, state) of the tree that is now, and of what is gone from it.

    known is what an earlier sync gave (rows whose state is not `removed`), seen comes from folders_of. A folder is known by (source, path) and keeps its number; new
    ones get numbers above `high` and all known ones, parents before their children and siblings by path. Numbers of removed folders are
    not given again as long as the caller hands on the highest. parent_id is looked up by the parent's path.
    """
    key = ["source", "path"]
    columns = [*key, "name", "parent", "depth"]
    if known is None:
        new, stay, gone = seen.select(*columns), None, None
    else:
        new = seen.join(known.select(*key), key, "left_anti").select(*columns)
        stay = seen.join(known.select(*key, "id"), key).select(*columns, "id")
        gone = known.join(seen.select(*key), key, "left_anti")
        high = max(high, known.agg(F.max("id")).first()[0] or 0)
    now = numbered_in_order(new, ["depth", "source", "path"], high).withColumn("state", F.lit("new"))
    if stay is not None:
        now = staged(now.unionByName(stay.withColumn("state", F.lit("kept"))))
    up = now.select("source", F.col("path").alias("parent"), F.col("id").alias("parent_id"))
    out = now.join(up, ["source", "parent"], "left").select("id", *key, "name", "parent_id", "depth", "state")
    return out if gone is None else out.unionByName(gone.select("id", *key, "name", "parent_id", "depth", F.lit("removed").alias("state")))


def root_ids(rows: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """rows with root_id by natural key; null where there is none. Roots are one row a key."""
    return rows.join(roots.select(*key, F.col("id").alias("root_id")), key, "left")
