"""Behaviour that the driver's tables do not show: edges, nulls, ties."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import paths, text, values
from foliant.operators import catalog, incremental, ordered, recognition


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def test_ascii_fold_leaves_other_letters(spark):
    assert one(spark, text.ascii_fold(F.col("a")), a="ÄBC") == "Äbc"


def test_like_takes_wildcards_literally(spark):
    assert one(spark, text.like_literal(F.col("a"), "A_B"), a="xa_b") is True
    assert one(spark, text.like_literal(F.col("a"), "A_B"), a="xaab") is False


def test_strict_fold(spark):
    assert one(spark, text.strict_identity_key(F.col("a")), a="Straße  №1") == "strasse no1"


def test_emails_lose_trailing_dots(spark):
    assert one(spark, text.emails(F.col("a")), a="write to a.b@c.example.org. now") == ["a.b@c.example.org"]


def test_column_letters(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702, 703)], "n long").select("n", text.column_letters(F.col("n")).alias("l")).collect()
    assert {r["n"]: r["l"] for r in rows} == {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA"}


def test_portable_paths(spark):
    rows = spark.createDataFrame([("a/b",), ("a/../b",), ("a//b",), ("C:/x",), ("",), ("a/./b",)], "p string").select("p", paths.is_portable(F.col("p")).alias("ok")).collect()
    assert [r["p"] for r in rows if r["ok"]] == ["a/b"]


def test_legacy_paths(spark):
    rows = spark.createDataFrame([("C:\\x\\y",), ("\\\\host\\share\\z",), ("/opt/a",), ("plain/b",)], "p string").select(paths.legacy_path(F.col("p")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["legacy-c/x/y", "unc-host-share/z", "legacy-posix/opt/a", "plain/b"]


def test_classify_root(spark):
    rows = spark.createDataFrame([("svc/2020/Acme, Bonn/x.txt",), ("svc/1999/Old",), ("svc/abcd/No",), ("svc",)], "p string").select(paths.classify_root(F.col("p")).alias("r")).collect()
    assert rows[0]["r"].asDict() == {"service": "svc", "year": "2020", "customer": "Acme", "city": "Bonn"}
    assert [r["r"] for r in rows[1:]] == [None, None, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "En"), (2, "de")], "id long, lang string")
    assert [r["id"] for r in catalog.equal_filters(df, {"lang": "EN"}).collect()] == [1]
    assert catalog.equal_filters(df, {"missing": "x"}).count() == 0
    assert catalog.in_ids(df, "id", []).count() == 0 and catalog.in_ids(df, "id", None).count() == 2
    with pytest.raises(ValueError):
        catalog.page(df, [F.col("id")], 0)


def test_prune_keeps_ancestors(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/hit",), ("c",)], "path string")
    assert sorted(r["path"] for r in catalog.prune_tree(df, "path", F.col("path").contains("hit")).collect()) == ["a", "a/b", "a/b/hit"]


def test_changes_and_overlay(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    seen = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, v string")
    assert {r["k"]: r["change"] for r in incremental.changes(known, seen, "k", ["v"]).collect()} == {1: "removed", 2: "changed", 3: "unchanged", 4: "new"}
    pending = spark.createDataFrame([(1, "delete", None), (2, "upsert", "x"), (9, "upsert", "y")], "k long, op string, v string")
    assert {r["k"]: r["v"] for r in incremental.overlay(known, pending, "k", "op", ["v"]).collect()} == {2: "x", 3: None, 9: "y"}


def test_budget_cuts_the_crossing_row(spark):
    df = spark.createDataFrame([("d", 0, "abc"), ("d", 1, "defgh"), ("d", 2, "ij")], "k string, i long, t string")
    assert [r["kept"] for r in ordered.within_budget(df, "k", "i", "t", 6).orderBy("i").collect()] == ["abc", "de"]


def test_resolution_ladder(spark):
    df = spark.createDataFrame([(2, 0, 0), (1, 2, 0), (1, 0, 2), (1, 1, 0), (1, 0, 1), (1, 0, 0)], "c int, o int, e int")
    got = [r["r"] for r in df.select(recognition.resolution(F.col("c"), F.col("o"), F.col("e")).alias("r")).collect()]
    assert got == ["different_cities", "conflicting_project_owners", "duplicate_exact_names", "assign_owner", "assign_exact", "create"]


FIRMS = [
    "Bergmann Werke", "Bergman Werke", "Bergmann Bau Werke", "Bergmann Baw Werke", "Muster Bau GmbH", "Muster Baum GmbH", "Muster Bau AG", "Mustre Bau GmbH", "Anders Bau GmbH & Co. KG", "Andres Bau GmbH & Co. KG", "Ab GmbH",
    "Planung Nord Sued GmbH", "Planung Nord Süd GmbH", "Xplanung Nord Sued GmbH", "Planung Nord Sued Ost GmbH", "Holz und Stein e.V.", "Holz und Steine e.V.", "Holz u Stein e.V.", "kg kg kg", "Muster Bau  gmbh",
]


def test_similar_names_equal_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    letters = "abcdefghilmnorstu"
    names = set(FIRMS)
    for _ in range(60):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(4, 18))) + rng.choice([" bau", " werk", ""]) + rng.choice([" GmbH", " AG", ""])
        names.add(base)
        for _ in range(2):
            at = rng.randrange(len(base.rsplit(" ", 1)[0]))
            names.add(base[:at] + rng.choice([rng.choice(letters), "", base[at] * 2]) + base[at + 1 :])
    key = lambda n: re.sub(r"[^\w]+", " ", n.lower()).strip()
    forms = lambda n: sorted({key(m) for m in re.findall(values.LEGAL_FORM.replace("(?iuU)", ""), n, re.I)})
    want = set()
    for a in names:
        for b in names:
            x, y = key(a), key(b)
            if x < y and min(len(x), len(y)) >= 6 and forms(a) == forms(b) and len(x.split()) == len(y.split()):
                ends = x.split()[0] == y.split()[0] and x.split()[-1] == y.split()[-1]
                if (forms(a) or ends) and recognition.name_ratio(x, y) >= 0.86:
                    want.add((a, b))
    got = {(r["name"], r["other"]) for r in recognition.similar_names(spark.createDataFrame([(n,) for n in names], "p string"), "p").collect()}
    assert got == want and ("Bergmann Bau Werke", "Bergmann Baw Werke") in got and len(got) > 40
    assert not {("Bergman Werke", "Bergmann Werke"), ("Muster Bau AG", "Muster Bau GmbH")} & got


def test_prefix_tokens_are_taken_literally(spark):
    assert one(spark, text.has_prefix_tokens(F.col("a"), ["a.b"]), a="x axb") is False
    assert one(spark, text.has_prefix_tokens(F.col("a"), ["c)"]), a="a c) b") is True


def test_phrases_are_searched_whole(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + words + " y"), (2, words.replace("w11", "other")), (3, "two, WORDS."), (4, None), (5, "two wordss")], "d long, t string")
    asked = spark.createDataFrame([(7, words), (8, "Two words"), (9, ""), (10, None), (11, "w3")], "p long, q string")
    assert sorted(tuple(r) for r in catalog.phrase_hits(docs, asked, 8, "d", "t", "p", "q").collect()) == [(1, 7), (1, 11), (2, 11), (3, 8)]


def test_document_priority(spark):
    points = text.document_priority(F.col("n"), F.col("t"), ["vertrag"], ["telefon"], ["statik"])
    rows = spark.createDataFrame([("VERTRAG.pdf", "Telefon und Vertrag " + "x" * 300), ("statik.txt", "Statik"), ("a", "y" * 12_000 + "vertrag")], "n string, t string").select(points.alias("p")).collect()
    assert [r["p"] for r in rows] == [15 + 4 + 5 + 3, -12, 5]


def test_assess_without_a_window(spark):
    rows = [("a", 0, "x", "r1"), ("a", 0, "x", "r2"), ("a", 1, "y", "r1"), ("b", 1, "x", "r1"), ("b", 1, "y", "r1"), ("c", 2, None, None)]
    got = {r["k"]: (r["best"], r["role"], r["reasons"], r["conflict"]) for r in recognition.assess(spark.createDataFrame(rows, "k string, q int, role string, why string"), "k", "q", "role", "why", "why").collect()}
    assert got == {"a": (0, "x", ["r1", "r2"], True), "b": (1, "unknown", ["r1"], False), "c": (2, "unknown", [], False)}
