"""Outbox replay: the table's fold equals a plain one, and a stream in micro-batches with restarts equals the table's."""

import random

import pytest

from foliant.streaming import replay

SCHEMA = "record string, sequence long, source string, op string, expected long, value string"


def made(records=12, rows=160, seed=3):
    rng = random.Random(seed)
    out = []
    for sequence in range(1, rows):
        r = rng.randrange(records)
        local = r % 3 == 0
        kind = rng.random()
        source, op = ("server", rng.choice(["put", "put", "put", "delete"])) if kind < 0.15 else ("client", "resolve") if kind < 0.3 else ("client", rng.choice(["put", "put", "put", "delete"]))
        out.append((f"local:{r}" if local else str(100 + r), sequence, source, op, None if local else 7, f"v{sequence}"))
    return out


KNOWN = [(str(100 + r), 100 + r, 7, "old") for r in range(12) if r % 3]


def plain(rows, known):
    """(record, sequence, outcome, revision, value) by the rules as they are told, in one loop over all rows."""
    state = {r: {"rev": rev, "val": v, "mine": None, "blocked": False, "wait": []} for r, _, rev, v in known}
    out = []
    for record, seq, source, op, expected, value in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(record, {"rev": None, "val": None, "mine": None, "blocked": False, "wait": []})

        def change(op, value, s=s):
            s["rev"], s["val"] = (None, None) if op == "delete" else ((s["rev"] or 0) + 1, value)

        todo = [(seq, op, expected, value)]
        if source == "server":
            change(op, value)
            out.append((record, seq, "seen", s["rev"], s["val"]))
            continue
        if op == "resolve":
            s["blocked"], s["mine"] = False, s["rev"]
            out.append((record, seq, "resolved"))
            todo, s["wait"] = s["wait"], []
        for n, o, e, v in todo:
            if s["blocked"]:
                s["wait"].append((n, o, e, v))
                out.append((record, n, "waiting"))
            elif s["rev"] != (e if s["mine"] is None else s["mine"]):
                s["blocked"] = True
                out.append((record, n, "conflict"))
            else:
                change(o, v)
                s["mine"] = s["rev"]
                out.append((record, n, "applied"))
    return sorted(r[:3] for r in out), {r: (s["rev"], s["val"]) for r, s in state.items()}


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(KNOWN, "record string, id long, revision long, value string")


@pytest.fixture(scope="module")
def by_table(spark):
    rows, known = frames(spark, made())
    return replay.replay_table(rows.repartition(5), known).collect()


def test_the_table_equals_a_plain_loop(spark, by_table):
    outcomes, state = plain(made(), KNOWN)
    assert sorted((r["record"], r["sequence"], r["outcome"]) for r in by_table) == outcomes
    assert {o for _, _, o in outcomes} == {"applied", "conflict", "waiting", "resolved", "seen"}
    now = {r["record"]: (r["revision"], r["value"]) for r in replay.current(spark.createDataFrame(by_table, replay.OUTCOME)).collect()}
    assert now == {r: state[r] for r in now}
    ids = {r["record"]: {x["id"] for x in by_table if x["record"] == r["record"] and x["id"] is not None} for r in by_table}
    assert all(len(i) <= 1 for i in ids.values()) and all(i == {int(r)} for r, i in ids.items() if r.isdigit())


def test_a_stream_with_restarts_equals_the_table(spark, by_table, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.ROCKS)
    rows = made()
    _, known = frames(spark, rows)
    inbox, checkpoint, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    for start in range(0, len(rows), 40):  # each part in a run of its own: stopped, and started again from its checkpoint
        part = rows[start : start + 40] + rows[max(0, start - 5) : start]  # some come twice
        random.Random(start).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = replay.replay_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox), known)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    assert got == sorted(map(tuple, by_table), key=repr)


def test_no_rows(spark):
    rows, known = frames(spark, [])
    assert replay.replay_table(rows, known).count() == 0


def test_query_equals_its_sql_for_records_without_a_conflict_and_rows_without_a_user(spark, tmp_path):
    import duckdb

    from foliant import registry
    from foliant.plans import lifecycle  # noqa: F401

    rows = [(1, 7, "purchase"), (2, 7, "purchase"), (3, 7, "view"), (4, 8, "purchase"), (5, 8, "error"), (6, 8, "purchase"), (7, 8, "purchase"), (8, 9, "purchase"), (9, 9, "error")]
    rows += [(10, None, "purchase"), (11, None, "error"), (12, None, "purchase"), (13, None, "error"), (14, None, "purchase")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duckdb.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = duckdb.sql(registry.oracle_sql()["outbox_replay"]).fetchall()
    assert sorted(map(tuple, registry.queries()["outbox_replay"](spark, str(tmp_path)).collect())) == sorted(wanted)
