"""Every query with an oracle equals DuckDB's result on the same tables."""

import math

import duckdb
import pytest

import foliant.plans  # noqa: F401
from foliant import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, con, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = con.sql(registry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in theirs.fetchall())


def test_similar_names_are_alike(spark, sf_dir):
    rows = registry.queries()["similar_names"](spark, sf_dir).collect()
    assert rows and all(r["name"] != r["other"] and r["ratio"] >= 0.86 for r in rows)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_blocklists_read_the_texts_once(spark, sf_dir):
    for name in ("blocklist_keep", "blocklist_hits"):
        files = registry.queries()[name](spark, sf_dir).inputFiles()
        assert files and not any("documents.parquet" in f for f in files)
