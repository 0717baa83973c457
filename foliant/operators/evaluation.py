"""Evaluation of ranked documents in rounds that stop reading where nothing is missing any more."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged


def evaluate_in_rounds(
    ranked: DataFrame, key: str, rank: str, needed: DataFrame, find: Callable[[DataFrame], DataFrame], batch: int = 24, most: int = 500, exhaustive: bool = False
) -> DataFrame:
    """Facts of the documents that had to be read, with their round from 0 on.

    ranked has key, rank from 1 and what identifies a document; needed (key, field) says what each key lacks; find(some rows of ranked)
    reads their texts and gives facts with key and field. All keys have their first round. A key has the next one while
    a field that it needs was not found in those before, up to `most` documents; with exhaustive all of its documents are read. What
    a round does not ask for is not read: its facts are written before the next begins. There are at most most / batch
    rounds, or as many as the longest list has.
    """
    if not exhaustive:
        ranked = ranked.where(F.col(rank) <= most)
    missing, rounds, done = staged(needed.select(key, "field").distinct()), [], 0
    while True:
        wanted = ranked.where((F.col(rank) > done * batch) & (F.col(rank) <= (done + 1) * batch))
        if done and not exhaustive:
            wanted = wanted.join(missing.select(key).distinct(), key, "left_semi")
        wanted = staged(wanted)
        if rounds and wanted.isEmpty():
            break
        rounds.append(staged(find(wanted).withColumn("round", F.lit(done))))
        missing = staged(missing.join(rounds[-1].select(key, "field").distinct(), [key, "field"], "left_anti"))
        done += 1
    return reduce(DataFrame.unionByName, rounds)
