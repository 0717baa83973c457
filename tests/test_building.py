"""Commits and the incremental build: concurrent writers, failures, rollback, sweeping; what is opened and extracted."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.sources import building
from foliant.sources.commits import CommitConflict, CommitLog


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, f"file://{tmp_path}/log")


def one(spark, value):
    return spark.range(1).select(F.lit(value).alias("v"))


def values(log, commit=None):
    return {c: log.table(c, commit).first()["v"] for c in (commit or log.last()).components}


def test_components_are_committed_together(spark, log):
    assert log.last().components == {} and log.table("a") is None
    first = log.publish({"a": one(spark, 1), "b": one(spark, 1)})
    log.publish({"b": one(spark, 2)})
    assert values(log) == {"a": 1, "b": 2} and values(log, first) == {"a": 1, "b": 1}
    assert log.last().components["a"] == first.components["a"]  # what did not change is named again


def test_a_failing_component_commits_none(spark, log):
    log.publish({"a": one(spark, 1), "b": one(spark, 1)})
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).cast("int").alias("v"))
    with pytest.raises(Exception, match="broken"):
        log.publish({"a": one(spark, 2), "b": broken})
    assert values(log) == {"a": 1, "b": 1} and log.last().number == 1


def test_concurrent_writers_never_share_a_number(spark, log):
    base = log.publish({f"c{i}": one(spark, 0) for i in range(6)})
    folders = {i: log.write(f"c{i}", one(spark, i)) for i in range(6)}
    got = []
    gate = threading.Barrier(6)

    def writer(i):
        gate.wait()
        got.append(log.commit({f"c{i}": folders[i]}, base).number)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [2, 3, 4, 5, 6, 7]
    assert values(log) == {f"c{i}": i for i in range(6)}


def test_two_writers_of_one_component_conflict(spark, log):
    base = log.publish({"a": one(spark, 1)})
    log.commit({"a": log.write("a", one(spark, 2))}, base)
    with pytest.raises(CommitConflict):
        log.commit({"a": log.write("a", one(spark, 3))}, base)
    assert values(log) == {"a": 2}


def test_rollback_and_sweep(spark, log):
    with pytest.raises(ValueError):
        log.rollback()
    made = [log.publish({"a": one(spark, i), **({"b": one(spark, 0)} if i == 0 else {})}) for i in range(6)]
    log.rollback()
    assert values(log)["a"] == 4 and log.last().number == 7
    orphan = log.write("a", one(spark, 99))
    assert log.sweep() == []  # all are young
    gone = log.sweep(older_than=-10, referenced={made[0].components["a"]})
    assert set(gone) == {made[1].components["a"], made[2].components["a"], orphan}  # the last commit and its three predecessors stay, and so does b
    assert values(log)["b"] == 0 and log.table("a", made[3]).count() == 1


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for i in range(12):
        (root / f"service/2024/Kunde {i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"service/2024/Kunde {i % 3}" / f"f{i} [x].txt").write_text(f"Telefon text {i % 4}")
    (root / "service/picture.png").write_bytes(b"\x89PNG")
    (root / "service/other.bin").write_bytes(b"1")
    return root


def counts(b):
    return b.seen, b.unchanged, b.opened, b.extracted, b.removed


def rows(log):
    return {r["relative_path"]: (r["status"], r["text"]) for r in building.catalog(log).collect()}


def test_build_opens_what_changed_and_extracts_each_content_once(spark, log, tree):
    run = lambda **o: building.build(spark, f"file://{tree}", log, words={"cues": ["telefon"]}, **o)
    assert counts(run()) == (14, 0, 12, 4, 0)
    found = rows(log)
    assert len(found) == 14 and found["service/2024/Kunde 1/f1 [x].txt"] == ("ok", "Telefon text 1") and found["service/other.bin"] == ("extension_disabled", None)
    assert {r["priority"] for r in building.catalog(log).where("status = 'ok'").collect()} == {5}

    before = log.last().number
    assert counts(run()) == (14, 14, 0, 0, 0) and log.last().number == before  # nothing changed, nothing is written

    path = tree / "service/2024/Kunde 1/f1 [x].txt"
    at = path.stat()
    path.write_text("Telefon text X")
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert counts(run()) == (14, 14, 0, 0, 0) and rows(log) == found  # the same size and time: it was not opened
    assert counts(run(verify=True)) == (14, 0, 12, 1, 0)  # verified, only the new content is extracted
    assert rows(log)["service/2024/Kunde 1/f1 [x].txt"] == ("ok", "Telefon text X")

    (tree / "service/2024/Kunde 0/f0 [x].txt").unlink()
    (tree / "service/new.txt").write_text("Telefon text 2")
    (tree / "service/2024/Kunde 2/f2 [x].txt").write_text("anders")
    assert counts(run()) == (14, 12, 2, 1, 1)
    now = rows(log)
    assert now["service/new.txt"] == ("ok", "Telefon text 2") and now["service/2024/Kunde 2/f2 [x].txt"] == ("ok", "anders") and "service/2024/Kunde 0/f0 [x].txt" not in now


def test_many_changed_files_are_read_with_the_tree(spark, log, tree, monkeypatch):
    monkeypatch.setattr(building, "NAMED_PATHS", 1)
    building.build(spark, f"file://{tree}", log)
    assert len(rows(log)) == 14


def test_an_empty_tree(spark, log, tmp_path):
    (tmp_path / "empty").mkdir()
    assert counts(building.build(spark, f"file://{tmp_path}/empty", log)) == (0, 0, 0, 0, 0)
    assert rows(log) == {}
    (tmp_path / "empty/a.txt").write_text("a")
    time.sleep(0.01)
    assert counts(building.build(spark, f"file://{tmp_path}/empty", log)) == (1, 0, 1, 1, 0)


def test_two_builds_at_once_leave_one(spark, log, tree):
    building.build(spark, f"file://{tree}", log)
    stale = log.last()
    (tree / "service/new.txt").write_text("neu")
    building.build(spark, f"file://{tree}", log)
    with pytest.raises(CommitConflict):
        log.publish({"files": log.table("files", stale)}, stale)
    assert len(rows(log)) == 15


def test_texts_stay_while_a_kept_version_has_them(spark, log, tree):
    path = tree / "service/2024/Kunde 0/f0 [x].txt"

    def run(body):
        path.write_text(body)
        building.build(spark, f"file://{tree}", log)

    for i in range(4):
        run(f"only version {i} has this" + "!" * i)
    assert building.sweep_texts(log) == 0  # the third predecessor still has the first
    run("the last one")
    assert building.sweep_texts(log) == 1 and building.sweep_texts(log) in (0, 1)
    said = {r["text"] for r in log.table("texts").collect()}
    assert "only version 0 has this" not in said and "the last one" in said
    assert len(rows(log)) == 14
