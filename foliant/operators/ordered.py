"""Operators on ordered rows: segments, budgets, carried headers, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """rows with segment: runs of equal `same` per key, numbered from 0."""
    w = Window.partitionBy(key).orderBy(order)
    breaks = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)), 0).otherwise(1)
    return rows.withColumn("_break", breaks).withColumn("segment", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_break")


def started_by(rows: DataFrame, key: str, order: list[Column], start: Column) -> DataFrame:
    """rows with segment: the number of starts up to the row; 0 before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(start, 1).otherwise(0)).over(w))


def within_budget(rows: DataFrame, key: str, order: str, text: str, budget: int, separator: int = 1) -> DataFrame:
    """Rows of each key until the budget of characters is used up, the crossing one cut; a separator is counted between rows."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(F.length(text) + separator).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("_room", F.lit(budget) - before).where("_room > 0")
    return cut.withColumn("kept", F.expr(f"substring({text}, 1, least(length({text}), cast(_room as int)))")).drop("_room")


def carried(rows: DataFrame, key: list[str], order: list[Column], label: Column, name: str = "header") -> DataFrame:
    """rows with the last label above them in the same key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(w))


def neighbours(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({f"before_{column}": F.lag(column).over(w), f"after_{column}": F.lead(column).over(w)})


def distinct_in_order(rows: DataFrame, key: str, order: Column, value: str, folded: Column) -> DataFrame:
    """The first spelling of each folded value per key, with the place of its first use."""
    return rows.groupBy(key, folded.alias("folded")).agg(F.min_by(value, order).alias(value), F.min(order).alias("at"))


def rounds_until_found(ranked: DataFrame, key: str, rank: str, found: str, needed: list[str], batch: int = 24) -> DataFrame:
    """Ranked rows up to the batch in which all needed values have been found, or all rows where they never are."""
    rows = ranked.withColumn("round", F.floor((F.col(rank) - 1) / batch).cast("int"))
    first = rows.where(F.col(found).isin(needed)).groupBy(key, found).agg(F.min("round").alias("r"))
    stop = first.groupBy(key).agg(F.count("*").alias("n"), F.max("r").alias("stop")).where(F.col("n") == len(needed))
    return rows.join(stop.select(key, "stop"), key, "left").where("stop IS NULL OR round <= stop").drop("stop")
