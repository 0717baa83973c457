"""Search assembly: totals beside pages, sort orders, kind gating, file filters and merged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import page


def sort_order(kind: str, name: str, modified: str, size: str, key: str) -> list[Column]:
    """name: without case, upward; modified and size: downward; ties by name, then key."""
    by_name = [text.ascii_fold(F.col(name)), F.col(key)]
    first = {"name": [], "modified": [F.desc(modified)], "size": [F.desc(size)]}
    if kind not in first:
        raise ValueError(f"unknown sort {kind}")
    return [*first[kind], *by_name]


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the number of all rows beside each of its rows; the total is counted on its own, so that no window holds the table."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, limit, offset).join(F.broadcast(total), how="cross")  # one row


def any_contains(needle: str, *columns: str) -> Column:
    """Whether some column contains the needle, A-Z folded, without wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(text.like_literal(F.col(c), needle), F.lit(False))
    return out


def year_order(value: Column) -> list[Column]:
    """Years first, the latest on top, then other values downward."""
    return [F.desc(value.rlike("^[0-9]+$")), F.desc(value)]


def gated(records: dict[str, DataFrame], asked: dict[str, str | None], gates: dict[str, tuple[str, ...]]) -> DataFrame | None:
    """The union of records by kind, leaving out kinds for which one of their gate filters is set; None if nothing is left."""
    out = None
    for kind, df in records.items():
        if any(asked.get(g) is not None for g in gates.get(kind, ())):
            continue
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def folder_filter(folders: DataFrame, path: str, year: str | None = None, domain: str | None = None) -> DataFrame:
    """Folders with the year as a segment of their path and the domain as a part of it, without case."""
    rows = folders if year is None else folders.where(F.array_contains(F.split(F.col(path), "/"), year))
    return rows if domain is None else rows.where(text.like_literal(F.col(path), domain))


def project_filter(projects: DataFrame, year: str | None = None, customer: str | None = None, domain: str | None = None) -> DataFrame:
    """Projects of a year, with a part of the customer's name, in a domain; the last two without case."""
    rows = projects if year is None else projects.where(F.col("year").cast("string") == year)
    rows = rows if customer is None else rows.where(text.like_literal(F.col("customer"), customer))
    return rows if domain is None else rows.where(text.ascii_fold(F.col("domain")) == text.ascii_fold(F.lit(domain)))


def file_type(kind: Column, name: Column) -> Column:
    """The type in lower case; where it is empty, the name's ending; empty without one."""
    ending = F.regexp_extract(name, r"\.([^./]+)$", 1)
    return F.lower(F.coalesce(F.nullif(kind, F.lit("")), ending))


def filter_files(files: DataFrame, needle: str, kind: str | None, name: str, folder: str, type_col: str) -> DataFrame:
    """Files with the needle in name or folder, of a type."""
    rows = files.where(any_contains(needle, name, folder)) if needle else files
    return rows if kind is None else rows.where(F.lower(F.col(type_col)) == kind.lower())


def merged_files(shown: DataFrame, loaded: DataFrame, path: str) -> DataFrame:
    """Files shown and those loaded later, each normalised path once, the shown ones first."""
    key = F.lower(F.regexp_replace(F.col(path), r"\\", "/"))
    rows = shown.withColumn("_n", F.lit(0)).unionByName(loaded.withColumn("_n", F.lit(1))).withColumn("_key", key)
    first = rows.groupBy("_key").agg(F.min_by(F.struct(*shown.columns), F.struct("_n", path)).alias("x"))
    return first.select("x.*")


def journal_order(number: Column, *ties: Column) -> list[Column]:
    """Entries by number; those without a positive one come last."""
    return [F.when(number > 0, number).otherwise(F.lit(2**31)), *ties]
