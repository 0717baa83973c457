"""The positional index against plain searches over the texts: prefixes, phrases, accents, replaced and removed documents."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog, text_index
from foliant.operators.text_index import TextIndex

WORDS = ["haus", "Häuser", "hauptsache", "grün", "grün", "ÉTÉ", "et", "a", "a", "b", "straße", "ΑΒΓ", "άλφα", "x1", "42"]


def plain_tokens(body):
    letters = "".join(c for c in unicodedata.normalize("NFD", (body or "").lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[^\w]+|_", letters) if t]


def texts(n, seed):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "_"]) for _ in range(rng.randrange(0, 30))) for i in range(n)}


PHRASES = {1: "a a", 2: "haus grün", 3: "b a a", 4: "", 5: "!!", 6: "été et", 7: "42", 8: "a a a a", 9: "nirgends hier", 10: "GRÜN Straße"}


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """An index of three segments, and the documents that it then holds."""
    made = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}")
    docs = texts(60, 1) | {60: None, 61: ""}
    made.write(frame(spark, docs), "doc_id", "text")
    newer = {i: t for i, t in texts(80, 2).items() if i % 5 == 0}
    made.write(frame(spark, newer), "doc_id", "text", removed=spark.createDataFrame([(3,), (4,), (999,)], "doc_id long"))
    again = {4: "haus am see", 7: "neu"}
    made.write(frame(spark, again), "doc_id", "text")
    return made, {i: t for i, t in (docs | newer | again).items() if i != 3}


def check(spark, made, docs):
    assert {r["doc"] for r in made.documents().collect()} == set(docs)
    for words in (["hau"], ["gru", "a"], ["HÄUS"], ["été", "x"], ["zzz"], []):
        want = {i for i, t in docs.items() if words and all(any(w.startswith(plain_tokens(p)[0]) for w in plain_tokens(t)) for p in words)}
        assert {r["doc"] for r in made.having_prefixes(words).collect()} == want, words
    asked = spark.createDataFrame(list(PHRASES.items()), "phrase_id long, phrase string")
    line = lambda t: f" {' '.join(plain_tokens(t))} "
    want = {(i, k) for i, t in docs.items() for k, p in PHRASES.items() if plain_tokens(p) and line(p) in line(t)}
    assert {tuple(r) for r in made.phrase_hits(asked, "phrase_id", "phrase").collect()} == want


def test_searches_equal_plain_ones(spark, index):
    check(spark, *index)


def test_large_sides_are_not_broadcast(spark, index, monkeypatch):
    monkeypatch.setattr(catalog, "BROADCAST_ROWS", 0)
    check(spark, *index)


def test_compacting_changes_nothing(spark, index):
    made, docs = index
    made.compact()
    assert len(made._segments()) == 1
    check(spark, made, docs)
    made.write(frame(spark, {1000: "haus"}), "doc_id", "text")
    check(spark, made, docs | {1000: "haus"})


def test_a_prefix_reaches_the_scan(spark, index):
    plan = index[0].postings(F.col("token").startswith("hau"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,hau)" in plan


def test_search_is_filters_and_the_or_of_name_path_and_text(spark, index):
    made, docs = index
    rows = [(i, f"file {i}.txt", f"Ordner/{'GRUEN' if i % 7 == 0 else 'x'}/file {i}.txt", "A" if i % 2 else "b", i % 3) for i in docs]
    files = spark.createDataFrame(rows, "doc_id long, filename string, path string, kind string, root int")

    def found(query, kind=None, roots=None):
        return {r["doc_id"] for r in text_index.search(files, made, "doc_id", "filename", "path", query, {"kind": kind}, {"root": roots}).collect()}

    has = lambda t, w: any(x.startswith(w) for x in plain_tokens(t))
    assert found("") == set(docs)
    assert found("gruen") == {i for i, t in docs.items() if i % 7 == 0 or has(t, "gruen")}
    assert found("grü haus", "B") == {i for i, t in docs.items() if i % 2 == 0 and has(t, "gru") and has(t, "haus")}
    assert found("file, 12") == {i for i in docs if i == 12}
    assert found("a", roots=[1]) == {i for i, n, p, _, r in rows if r == 1 and (has(docs[i], "a") or "a" in n.lower() or "a" in p.lower())}
    assert found("a", roots=[]) == set()


def test_a_batch_packs_a_token_into_one_row(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/index")
    made.write(frame(spark, {1: "a b a", 2: "A \u00e1", 3: ""}).coalesce(1).repartition(spark.sparkContext.defaultParallelism, F.lit(0)), "doc_id", "text")
    rows = spark.read.parquet(f"file://{tmp_path}/index/postings")
    assert {(r["token"], tuple(zip(r["docs"], r["places"], strict=True))) for r in rows.collect()} == {("a", ((1, 0), (1, 2), (2, 0), (2, 1))), ("b", ((1, 1),))}
    assert {tuple(r) for r in made.postings(F.lit(True)).collect()} == {("a", 1, 0), ("a", 1, 2), ("a", 2, 0), ("a", 2, 1), ("b", 1, 1)}


def test_rows_of_postings_are_bounded_however_often_a_token_stands(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/index")
    docs = {i: "a b " * 1500 + f"c{i} a d" for i in range(6)}
    made.write(frame(spark, docs).coalesce(1).repartition(spark.sparkContext.defaultParallelism, F.lit(0)), "doc_id", "text")
    rows = spark.read.parquet(f"file://{tmp_path}/index/postings")
    assert rows.agg(F.max(F.size("places")), F.sum(F.size("places"))).first() == (1024, 6 * 3003)
    asked = spark.createDataFrame([(1, "b c3 a"), (2, "a b a b c5"), (3, "a a"), (4, "c0 a d")], "phrase_id long, phrase string")
    assert {tuple(r) for r in made.phrase_hits(asked, "phrase_id", "phrase").collect()} == {(3, 1), (5, 2), (0, 4)}


def test_batches_are_cut_by_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BATCH_TOKENS", 40)
    monkeypatch.setattr(text_index, "ROW_PLACES", 2)
    monkeypatch.setattr(text_index, "ARROW_ROWS", 7)
    made = TextIndex(spark, f"file://{tmp_path}/index")
    docs = texts(60, 5) | {60: " ".join(WORDS * 4), 61: None}
    made.write(frame(spark, docs), "doc_id", "text")
    held = spark.read.parquet(f"file://{tmp_path}/index/postings").groupBy("batch").agg(F.sum(F.size("places")).alias("n"), F.max("first") == F.min("first"))
    assert held.where("n > 40").collect() and all(r["n"] <= 40 or r[2] for r in held.collect())
    check(spark, made, docs)
    made.compact()
    check(spark, made, docs)


def test_texts_under_one_id_are_searched_one_by_one(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/index")
    rows = [(1, "a b c"), (1, "d e f"), (None, "a e"), (None, "a b"), (2, "a b f")]
    made.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(spark.sparkContext.defaultParallelism, F.lit(0)), "doc_id", "text")
    asked = spark.createDataFrame([(1, "a e"), (1, "e f"), (2, "a e f"), (3, "b c d"), (None, "a b")], "phrase_id long, phrase string")
    for _ in range(2):
        assert {tuple(r) for r in made.phrase_hits(asked, "phrase_id", "phrase").collect()} == {(None, 1), (1, 1), (1, None), (None, None), (2, None)}
