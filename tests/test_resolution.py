"""Groups resolved in parallel equal those taken one after another."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import recognition


def taken_in_turn(groups, customers, alike):
    """{key: (outcome, customer)} by a loop over the groups in order, each seeing the customers made before it."""
    known, out = dict(customers), {}
    for key, name, cities, owners in sorted(groups):
        exact = [i for i, n in known.items() if n.lower() == name.lower()]
        near = [i for i, n in known.items() if frozenset((n, name)) in alike]
        if len(cities) > 1 and not owners and not exact:
            out[key] = ("different_cities", None)
        elif len(owners) > 1:
            out[key] = ("conflicting_project_owners", None)
        elif len(exact) > 1:
            out[key] = ("duplicate_exact_names", None)
        elif owners:
            out[key] = ("assign_owner", owners[0]) if owners[0] in customers else ("missing_project_owner", None)
        elif exact:
            out[key] = ("assign_exact", exact[0])
        elif near:
            out[key] = ("similar_name", None)
        else:
            out[key] = ("create", None)
            known[f"new {key}"] = name
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_in_parallel_equal_groups_in_turn(spark, seed):
    rng = random.Random(seed)
    base = [f"{w} {f}" for w in ("muster bauwesen", "mustar bauwesen", "mustar bauwasen", "nordhaus planung", "nordhaus plamung", "nordhaus plamumg", "sued architekten") for f in ("gmbh", "kg")]
    names = sorted({n[:i] + rng.choice("aeiou") + n[i + 1 :] for n in base for i in (1, 4, 9) for _ in range(2)} | set(base))
    customers = {i: n for i, n in enumerate(rng.sample(names, 5))} | {90: "doppelt gmbh", 91: "doppelt gmbh"}
    names.append("doppelt gmbh")
    groups = [(n, n, rng.sample(["Bonn", "Köln"], rng.choice([0, 1, 1, 2])), rng.sample([0, 1, 77], rng.choice([0] * 8 + [1, 2]))) for n in names]
    rng.shuffle(groups)
    rows = [(k, n, c, o, ["s"], 1) for k, n, c, o in ((k, n, sorted(c), sorted(o)) for k, n, c, o in groups)]
    df = spark.createDataFrame(rows, "key string, name string, cities array<string>, owners array<long>, services array<string>, roots int").repartition(3)
    people = spark.createDataFrame(list(customers.items()), "id long, name string")
    pairs = recognition.similar_names(df.select("name").union(people.select("name")).distinct(), "name").collect()
    want = taken_in_turn([(k, n, c, sorted(o)) for k, n, c, o in groups], customers, {frozenset((p["name"], p["other"])) for p in pairs})
    got = {r["key"]: (r["outcome"], r["customer"]) for r in recognition.resolve_groups(df, people, "key").collect()}
    assert got == want
    assert {"create", "similar_name", "assign_exact", "different_cities"} <= {o for o, _ in want.values()}


def test_roots_are_grouped(spark):
    rows = [("a gmbh", 2020, "x/A", "A GmbH", "Bonn", "s1"), ("a gmbh", 2022, "x/b", "A GMBH", "", "s2"), ("a gmbh", 2022, "x/B2", "a GmbH", "Bonn", "s1"), ("b kg", 2021, "y", "B KG", None, "s1")]
    roots = spark.createDataFrame(rows, "key string, year int, path string, name string, city string, service string")
    owners = spark.createDataFrame([("x/A", 5), ("x/b", 5), ("y", 6)], "path string, owner long")
    got = {r["key"]: tuple(r)[1:] for r in recognition.root_groups(roots, "key", owners).collect()}
    assert got == {"a gmbh": ("A GMBH", ["Bonn"], [5], ["s1", "s2"], 3), "b kg": ("B KG", [], [6], ["s1"], 1)}
    empty = recognition.resolve_groups(recognition.root_groups(roots.limit(0), "key"), spark.createDataFrame([], "id long, name string"), "key")
    assert empty.count() == 0


def test_groups_of_the_tables(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", "p_partkey").limit(60)
    name = F.concat("p_name", F.lit(" GmbH"))
    roots = part.select(text.identity_key(name).alias("key"), F.lit(2024).alias("year"), F.col("p_partkey").cast("string").alias("path"), name.alias("name"), F.lit("").alias("city"), F.lit("s").alias("service"))
    groups = recognition.root_groups(roots, "key")
    outcomes = [r["outcome"] for r in recognition.resolve_groups(groups, spark.createDataFrame([], "id long, name string"), "key").collect()]
    assert len(outcomes) == groups.count() and set(outcomes) <= {"create", "similar_name"}
