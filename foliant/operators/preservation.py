"""Digests of tables that do not depend on order, and what differs between two versions, found by ranges of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that keys are dealt into; a digest has at most so many rows.
RANGES = 4096
_LOW = 0xFFFFFFFF


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row. Nulls are told from empty texts, and a value from the same value in the next column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def digests(df: DataFrame, key: list[str], columns: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(range, rows, low, high, mixed): the number of rows in each range of keys, sums of both halves of their hashes, and all hashes by xor.

    Equal multisets of rows have equal digests, whatever their order and partitions. Tasks add up their own rows first, so what is
    shuffled is at most one row a range and task.
    """
    columns = columns or [c for c in df.columns if c not in key]
    h = df.select(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(ranges)).cast("int").alias("range"), row_hash([*key, *columns]).alias("h"))
    return h.groupBy("range").agg(F.count("*").alias("rows"), F.sum(F.col("h").bitwiseAND(_LOW)).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.bit_xor("h").alias("mixed"))


def table_digest(df: DataFrame, ranges: int = RANGES) -> DataFrame:
    """One row (rows, digest) of a whole table; two tables with the same columns and rows have the same."""
    sums = digests(df, df.columns, [], ranges)
    parts = F.sort_array(F.collect_list(F.concat_ws(":", *sums.columns)))  # at most one a range
    return sums.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(parts, ","), 256).alias("digest"))


def differing_ranges(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """(range) where the digests of two versions differ."""
    names = ["rows", "low", "high", "mixed"]
    a, b = (digests(df, key, columns, ranges).select("range", F.struct(*names).alias(side)) for df, side in ((before, "a"), (after, "b")))
    return a.join(b, "range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("range")


def differences(before: DataFrame, after: DataFrame, key: list[str], columns: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(key, change) of rows that are `lost`, `added` or `changed` between two versions; rows that are the same have none.

    Digests say which ranges of keys differ, and only their rows are joined: what is preserved is read twice and never shuffled.
    Rows that repeat under one key are compared as multisets.
    """
    columns = columns or [c for c in before.columns if c not in key]
    wanted = F.broadcast(differing_ranges(before, after, key, columns, ranges))  # at most `ranges` rows

    def told(df: DataFrame, side: str) -> DataFrame:
        rows = df.withColumn("range", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(ranges)).cast("int")).join(wanted, "range", "left_semi")
        h = row_hash([*key, *columns])
        sums = F.struct(F.count("*"), F.sum(h.bitwiseAND(_LOW)), F.sum(F.shiftrightunsigned(h, 32)), F.bit_xor(h))
        return rows.groupBy(*key).agg(sums.alias(side))

    a = told(before, "_a")
    b = told(after, "_b").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_b")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    change = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").otherwise("changed")
    both = a.join(b, on, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*[F.when(F.col("_a").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(key)], change.alias("change"))
