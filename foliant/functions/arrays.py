"""Helpers for arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once, however often body and the lambdas inside it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
