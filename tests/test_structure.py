"""Trees with numbers, digests of versions, layouts of made pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import preservation, structure
from foliant.sources import layout


def rows_of(df):
    return {r["path"]: (r["id"], r["parent_id"], r["state"]) for r in df.collect()}


def folders(spark, *files):
    return structure.folders_of(spark.createDataFrame([(f,) for f in files], "p string"), F.col("p"))


def test_numbers_are_kept_and_never_given_again(spark):
    first = structure.sync(None, folders(spark, "a/x/1.txt", "a/y/2.txt", "b/3.txt"), high=10)
    assert rows_of(first) == {"a": (11, None, "new"), "b": (12, None, "new"), "a/x": (13, 11, "new"), "a/y": (14, 11, "new")}
    second = structure.sync(first, folders(spark, "a/x/deep/1.txt", "c/9.txt"))
    assert rows_of(second) == {"a": (11, None, "kept"), "a/x": (13, 11, "kept"), "c": (15, None, "new"), "a/x/deep": (16, 13, "new"), "b": (12, None, "removed"), "a/y": (14, 11, "removed")}
    live = second.where("state <> 'removed'")
    third = structure.sync(live, folders(spark, "b/1.txt", "a/x/2.txt"), high=30)
    assert rows_of(third) == {"a": (11, None, "kept"), "a/x": (13, 11, "kept"), "b": (31, None, "new"), "c": (15, None, "removed"), "a/x/deep": (16, 13, "removed")}


def test_an_empty_tree_and_two_sources(spark):
    none = folders(spark, "top.txt")
    assert structure.sync(None, none).count() == 0
    rows = spark.createDataFrame([("s", "a/1"), ("t", "a/1"), ("t", "a/b/1")], "s string, p string")
    synced = structure.sync(None, structure.folders_of(rows, F.col("p"), F.col("s"))).collect()
    assert sorted((r["source"], r["path"], r["id"], r["parent_id"]) for r in synced) == [("s", "a", 1, None), ("t", "a", 2, None), ("t", "a/b", 3, 2)]
    assert {r["path"]: r["state"] for r in structure.sync(structure.sync(None, folders(spark, "a/1")), none).collect()} == {"a": "removed"}


def test_numbers_in_many_partitions_have_no_gap(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["k"]: r["id"] for r in structure.numbered_in_order(rows, ["k"], 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: k + 6 for k in range(1000)}


VERSION = "k long, a string, b string"


def version(spark, rows):
    return spark.createDataFrame(rows, VERSION)


BASE = [(i, f"a{i}", None if i % 3 else f"b{i}") for i in range(300)] + [(7, "a7", "again"), (None, "n", "n")]


def test_digests_do_not_depend_on_order_and_see_every_change(spark):
    mixed = list(BASE)
    random.Random(1).shuffle(mixed)
    digest = preservation.table_digest(version(spark, BASE)).first()
    assert digest == preservation.table_digest(version(spark, mixed).repartition(9)).first() and digest["rows"] == len(BASE)
    for other in (BASE[1:], [*BASE, BASE[0]], [(0, None, "a0"), *BASE[1:]], [(0, "", "b0"), *BASE[1:]], [(0, "a0", "b1"), *BASE[1:]]):
        assert preservation.table_digest(version(spark, other)).first() != digest
    assert preservation.table_digest(version(spark, [])).first()["rows"] == 0


@pytest.mark.parametrize("ranges", [1, 4096])
def test_differences_are_located(spark, ranges):
    after = [r for r in BASE if r[0] != 5] + [(5, "changed", None), (1000, "new", None), (8, "a8", None)]
    after.remove((9, "a9", "b9"))
    after.remove((None, "n", "n"))
    got = {(r["k"], r["change"]) for r in preservation.differences(version(spark, BASE), version(spark, after), ["k"], ranges=ranges).collect()}
    assert got == {(5, "changed"), (1000, "added"), (8, "changed"), (9, "lost"), (None, "lost")}
    wanted = preservation.differing_ranges(version(spark, BASE), version(spark, after), ["k"], ["a", "b"], ranges).count()
    assert wanted == (1 if ranges == 1 else 5)
    assert preservation.differences(version(spark, BASE), version(spark, BASE[::-1]), ["k"], ranges=ranges).count() == 0


def made_page(columns, seed):
    """A page of columns with paragraphs: (words, [(text, box)]); lines are 12 apart, paragraphs 40, columns 60 and more."""
    rng = np.random.default_rng(seed)
    words, blocks = [], []
    for c in range(columns):
        left, top = 50.0 + c * 320, 30.0
        for p in range(int(rng.integers(1, 4))):
            lines = []
            box = [left, top, left, top]
            for line in range(int(rng.integers(1, 5))):
                x, said = left, []
                for w in range(int(rng.integers(1, 6))):
                    width = float(rng.integers(10, 40))
                    shift = float(rng.uniform(-1, 1)) if w else 0.0  # words of a line are not quite level
                    words.append((x, x + width, top + shift, top + 10 + shift, f"c{c}p{p}l{line}w{w}"))
                    box = [min(box[0], x), min(box[1], top + shift), max(box[2], x + width), max(box[3], top + 10 + shift)]
                    said.append(words[-1][4])
                    x += width + 4
                lines.append(" ".join(said))
                top += 12
            blocks.append(("\n".join(lines), [round(v, 3) for v in box]))
            top += 40 - 12
    return words, blocks


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_columns_and_paragraphs_of_made_pages(spark, columns):
    pages = {(d, p): made_page(columns, 10 * d + p) for d in range(3) for p in range(1, 4)}
    rows = [(d, p, *w) for (d, p), (words, _) in pages.items() for w in words] + [(9, 1, 1.0, 2.0, 1.0, 2.0, " ")]
    random.Random(columns).shuffle(rows)
    words = spark.createDataFrame(rows, "doc long, page int, x0 double, x1 double, top double, bottom double, text string")
    found = {}
    for r in layout.layout_blocks(words, "doc").collect():
        found.setdefault((r["doc"], r["page"]), []).append((r["text"], [round(v, 3) for v in r["bbox"]]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(blocks) for k, (_, blocks) in pages.items()}


def test_gutters_scale_with_heights_and_rows_stay_apart():
    at = lambda x, top, h, t: (x, x + 20, top, top + h, t)
    blocks = lambda *ws: [b[0] for b in layout.page_blocks(*(np.array(c, float) for c in list(zip(*ws, strict=True))[:4]), [w[4] for w in ws])]
    assert blocks(at(0, 0, 5, "a"), at(44, 0, 5, "b")) == ["a b"]  # 24 is no gutter
    assert blocks(at(0, 0, 5, "a"), at(45, 0, 5, "b")) == ["a", "b"]
    assert blocks(at(0, 0, 20, "a"), at(80, 0, 20, "b")) == ["a b"]  # nor are three heights
    assert blocks(at(0, 0, 10, "a"), at(0, 17, 10, "b"), at(0, 36, 10, "c")) == ["a\nb", "c"]  # gaps of 7 and 9 at a height of 10
    assert blocks(at(0, 0, 10, "a"), at(13, 12, 10, "b"), at(12, 24, 10, "c")) == ["a", "b\nc"]
    assert blocks(at(0, 0, 10, "a"), at(0, 3, 10, "b"), at(100, 1, 10, "x")) == ["a b", "x"]
    assert layout.page_blocks(*[np.zeros(0)] * 4, []) == []


def test_page_budget(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 5)] + [(2, 1)], "doc long, page int")
    words = spark.createDataFrame([(1, p, 0.0, 9.0, 0.0, 9.0, "w") for p in (1, 2, 4)], "doc long, page int, x0 double, x1 double, top double, bottom double, text string")
    got = {r["doc"]: (r["pages_total"], r["pages_processed"], r["empty_pages"], r["status"], r["reason"]) for r in layout.page_states(pages, words, "doc", max_pages=3).collect()}
    assert got == {1: (4, 3, 1, "partial", "page_budget"), 2: (1, 1, 1, "ok", "")}
    assert {r["page"] for r in layout.layout_blocks(words, "doc", max_pages=3).collect()} == {1, 2}


def test_pages_of_a_batch_are_laid_out_together(spark):
    from foliant.sources import layout

    words = spark.createDataFrame([(d, p, 50.0, 70.0, 12.0 * i, 12.0 * i + 10, f"w{i}") for d in (1, None) for p in (1, 2) for i in range(3)], "doc_id long, page int, x0 double, x1 double, top double, bottom double, text string")
    found = layout.layout_blocks(words, "doc_id")
    assert {tuple(r) for r in found.select("doc_id", "page", "block", "text", "words").collect()} == {(d, p, 0, "w0\nw1\nw2", 3) for d in (1, None) for p in (1, 2)}
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no frame a page
