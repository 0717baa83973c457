"""Batches of changes with children, tags, and rounds that stop reading."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation, records


def test_changes_with_children(spark):
    known = spark.createDataFrame([(1, "a", "x", 3), (2, "b", None, 1), (3, "c", "z", 5), (4, "d", "w", 2)], "k long, name string, city string, revision long")
    changes = [(1, "update", 3, "A", None), (2, "update", 9, "B", "q"), (3, "delete", 5, None, None), (4, "create", None, "D", None), (5, "create", None, "e", "v"), (6, "update", 1, "f", None), (7, "delete", None, None, None)]
    given = spark.createDataFrame([(1, "new"), (2, "never"), (3, "never"), (5, "first"), (5, "second")], "k long, child string")
    old = spark.createDataFrame([(1, "old1"), (1, "old2"), (2, "kept"), (3, "gone"), (4, "stays")], "k long, child string")
    done = records.apply_changes(known, spark.createDataFrame(changes, "k long, op string, revision long, name string, city string"), "k", ["name", "city"], {"child": (old, given)})
    assert sorted(map(tuple, done.records.collect())) == [(1, "A", "x", 4), (2, "b", None, 1), (4, "d", "w", 2), (5, "e", "v", 1)]
    assert {r["k"]: r["outcome"] for r in done.outcomes.collect()} == {1: "updated", 2: "conflict", 3: "deleted", 4: "exists", 5: "created", 6: "unknown", 7: "unknown"}
    assert sorted(map(tuple, done.children["child"].collect())) == [(1, "new"), (2, "kept"), (4, "stays"), (5, "first"), (5, "second")]


def test_an_update_without_children_keeps_them(spark):
    known = spark.createDataFrame([(1, "a", 1)], "k long, name string, revision long")
    changes = spark.createDataFrame([(1, "update", 1, "b")], "k long, op string, revision long, name string")
    rows = spark.createDataFrame([(1, "child")], "k long, child string")
    done = records.apply_changes(known, changes, "k", ["name"], {"child": (rows, rows.limit(0))})
    assert [tuple(r) for r in done.children["child"].collect()] == [(1, "child")]
    none = records.apply_changes(known, changes.limit(0), "k", ["name"])
    assert [tuple(r) for r in none.records.collect()] == [(1, "a", 1)] and none.outcomes.count() == 0


def test_tags_are_told_apart_without_case(spark):
    known = spark.createDataFrame([(4, "Alt")], "id long, name string")
    names = spark.createDataFrame([(1, "neu"), (1, "ALT"), (2, "Neu"), (2, " neu "), (3, ""), (3, None), (2, "b")], "k long, tag string")
    tags, links = records.tagged(names, "k", known)
    assert sorted(map(tuple, tags.collect())) == [(4, "Alt"), (5, "b"), (6, "Neu")]
    lists = records.tag_lists(spark.createDataFrame([(1,), (2,), (3,)], "k long"), "k", links, tags)
    assert {r["k"]: r["tags"] for r in lists.collect()} == {1: ["Alt", "Neu"], 2: ["b", "Neu"], 3: []}


@pytest.mark.parametrize(("exhaustive", "most"), [(False, 500), (False, 4), (True, 4)])
def test_rounds_read_what_is_missing_and_no_more(spark, exhaustive, most):
    texts = {("p", i): t for i, t in enumerate(["x", "a", "b", "a b", "c", "c"], 1)} | {("q", i): "x" for i in range(1, 8)} | {("r", 1): "a c"}
    wants = {"p": {"a", "b"}, "q": {"a"}, "s": {"a"}}
    rows = spark.createDataFrame([(k, n, t) for (k, n), t in texts.items()], "k string, rank int, body string")
    needed = spark.createDataFrame([(k, f) for k, fs in wants.items() for f in fs], "k string, field string")
    asked = []

    def find(wanted):
        asked.extend((r["k"], r["rank"]) for r in wanted.collect())
        return wanted.join(rows, ["k", "rank"]).select("k", "rank", F.explode(F.split("body", " ")).alias("field"))

    got = evaluation.evaluate_in_rounds(rows.select("k", "rank"), "k", "rank", needed, find, batch=2, most=most, exhaustive=exhaustive).collect()
    read, found = set(), {k: set() for k in "pqr"}
    for start in range(0, 8, 2):  # round by round in plain words
        now = {(k, n) for (k, n) in texts if start < n <= start + 2 and (exhaustive or n <= most) and (exhaustive or start == 0 or wants.get(k, set()) - found[k])}
        read |= now
        for k, n in now:
            found[k] |= set(texts[k, n].split())
    assert sorted(asked) == sorted(read)
    assert sorted((r["k"], r["rank"], r["field"], r["round"]) for r in got) == sorted((k, n, f, (n - 1) // 2) for k, n in read for f in texts[k, n].split())
