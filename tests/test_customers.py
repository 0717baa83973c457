"""Contacts that keep their identity, and owners of projects."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import customers

KNOWN = "owner long, id long, uid string, name string, role string, email string, phone string"
GIVEN = "owner long, place int, uid string, name string, role string, email string, phone string"
KEPT = [(1, "u1", "Anna", "Chef", "a@x", ""), (2, "u2", "Ben", "", "b@x", "1"), (3, "u3", "Cem", "", "c@x", "")]


def replaced(spark, given, known=KEPT):
    a = spark.createDataFrame([(7, *k) for k in known] + [(8, 50, "v1", "Zoe", "", "", "")], KNOWN)
    b = spark.createDataFrame([(7, i, *g) for i, g in enumerate(given)] + [(9, 0, None, "Neu", "", "", "")], GIVEN)
    rows = customers.replace_contacts(a, b, "owner").collect()
    assert {(r["owner"], r["outcome"], r["valid"]) for r in rows if r["owner"] != 7} == {(8, "removed", True), (9, "new", True)}
    mine = [r for r in rows if r["owner"] == 7]
    assert len({r["valid"] for r in mine}) <= 1
    return all(r["valid"] for r in mine), sorted(((r["place"], r["id"], r["outcome"]) for r in mine), key=repr)


def of(*rows):
    return sorted(rows, key=repr)


CASES = [
    ([("u1", "Anna B", "", "", ""), (None, "ben", "", "B@X", "1"), (None, "Neu", "", "", "")], True, of((0, 1, "matched"), (1, 2, "matched"), (2, None, "new"), (None, 3, "removed"))),
    ([(None, "CEM", "neu", "z", "9")], True, of((0, 3, "matched"), (None, 1, "removed"), (None, 2, "removed"))),  # the name alone is enough
    ([("u9", "Anna", "", "", "")], False, of((0, None, "unknown"), (None, 1, "removed"), (None, 2, "removed"), (None, 3, "removed"))),
    ([("u1", "x", "", "", ""), ("u1", "y", "", "", "")], False, of((0, 1, "matched"), (1, 1, "doubled"), (None, 2, "removed"), (None, 3, "removed"))),
    ([(None, "Anna", "Chef", "a@x", None), ("u1", "Anna", "", "", "")], False, of((0, 1, "matched"), (1, 1, "doubled"), (None, 2, "removed"), (None, 3, "removed"))),
    ([(None, "Anna", "", "", ""), (None, "Anna", "", "", "")], True, of((0, 1, "matched"), (1, None, "new"), (None, 2, "removed"), (None, 3, "removed"))),
    ([(None, "", "", "", "")], True, of((0, None, "new"), (None, 1, "removed"), (None, 2, "removed"), (None, 3, "removed"))),
    ([], True, of((None, 1, "removed"), (None, 2, "removed"), (None, 3, "removed"))),
]


@pytest.mark.parametrize(("given", "valid", "want"), CASES)
def test_contacts_keep_their_identity(spark, given, valid, want):
    assert replaced(spark, given) == (valid, want)


def test_two_of_one_name_are_ambiguous(spark):
    known = [(1, "u1", "Anna", "", "a", ""), (2, "u2", "anna", "", "b", ""), (3, None, "Anna", "", "c", "")]
    assert replaced(spark, [(None, "Anna", "", "", "")], known)[0] is False
    assert replaced(spark, [("u1", "Anna", "", "", ""), (None, "Anna", "", "B", ""), (None, "Anna", "", "x", "")], known) == (True, of((0, 1, "matched"), (1, 2, "matched"), (2, 3, "matched")))


def test_one_root_has_one_owner(spark):
    owners = spark.createDataFrame([(1, 10)], "root long, owner long")
    wanted = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 2), (2, 21, 1), (2, 21, 3), (3, 30, 1)], "root long, owner long, at long")
    rows = customers.assign_owners(owners, wanted, "root", F.col("at")).collect()
    assert sorted((r["root"], r["owner"], r["outcome"]) for r in rows) == [(1, 10, "conflict"), (1, 10, "kept"), (2, 21, "assigned"), (2, 21, "conflict"), (2, 21, "kept"), (3, 30, "assigned")]
