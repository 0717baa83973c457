"""Replay of an outbox against a server's state, record by record: the same steps over a stream with state, or over a sorted table.

Rows are (record, sequence, source, op, expected, value): record is a server's id as text, or a local key of a record that the
server does not know yet. source is `client` for mutations of the outbox and `server` for what others changed meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["sequence", "source", "op", "expected", "value", "new_id"]
STATE = "id long, revision long, value string, mine long, blocked boolean, last long"
WAITING = "sequence long, op string, expected long, value string, new_id long"
OUTCOME = "record string, sequence long, op string, outcome string, id long, revision long, value string, by long, part int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Record:
    """What is known of one record. revision is null while it does not exist; mine is the revision that the client's own last step made."""

    id: int | None = None
    revision: int | None = None
    value: str | None = None
    mine: int | None = None
    blocked: bool = False
    last: int | None = None
    waiting: list[tuple] = field(default_factory=list)

    def take(self, sequence, source, op, expected, value, new_id) -> Iterator[tuple]:
        """The outcomes (sequence, op, outcome) that one row has: its own, and those of rows that it lets go on. The record is then as each leaves it.

        A row at or before the last sequence is a repetition and has none. A server's `put` or `delete` changes the record. A
        client's mutation is applied if it expects the revision that is there: the client's own last one where it has applied any
        (so what follows a mutation is rebased on its result), else the one that the row names. Otherwise it is a conflict, and all mutations
        behind it wait until a `resolve` takes the record as it is: the rejected one is dropped and the waiting are tried in order.
        """
        if self.last is not None and sequence <= self.last:
            return
        self.last = sequence
        if source == "server":
            self._change(op, value, new_id)
            yield sequence, op, "seen"
        elif op == "resolve":
            self.blocked, self.mine = False, self.revision
            yield sequence, op, "resolved"
            again, self.waiting = self.waiting, []
            for row in again:
                yield from self._mutate(*row)
        else:
            yield from self._mutate(sequence, op, expected, value, new_id)

    def _mutate(self, sequence, op, expected, value, new_id) -> Iterator[tuple]:
        if self.blocked:
            self.waiting.append((sequence, op, expected, value, new_id))
            yield sequence, op, "waiting"
        elif self.revision != (self.mine if self.mine is not None else expected):
            self.blocked = True
            yield sequence, op, "conflict"
        else:
            self._change(op, value, new_id)
            self.mine = self.revision
            yield sequence, op, "applied"

    def _change(self, op, value, new_id) -> None:
        if op == "delete":
            self.revision = self.value = None
        else:
            self.revision = (self.revision or 0) + 1
            self.value = value
            self.id = new_id if self.id is None else self.id


def _prepared(rows: DataFrame) -> DataFrame:
    """rows with the id that a record gets: its own number, or for a local key a number that the key alone decides, so that retries give it again."""
    made = F.xxhash64("record").bitwiseAND(0x7FFFFFFFFFFFFFFF)
    return rows.select("record", *[F.col(c) for c in COLUMNS[:-1]], F.coalesce(F.col("record").try_cast("long"), made).alias("new_id"))


def _plain(x):
    """None for what pandas has in place of a null."""
    return None if x is None or x != x else x


def _rows(frame) -> list[tuple]:
    whole = {c: [None if _plain(x) is None else int(x) for x in frame[c]] if c in ("sequence", "expected", "new_id") else [_plain(x) for x in frame[c]] for c in COLUMNS}
    return sorted(zip(*(whole[c] for c in COLUMNS), strict=True), key=lambda r: r[0])


def _told(name: str, record: Record, row: tuple) -> list[tuple]:
    """OUTCOME rows of one row: `by` is its sequence and `part` the place among what it led to."""
    return [(name, *o, record.id, record.revision, record.value, row[0], part) for part, o in enumerate(record.take(*row))]


def _frame(outcomes: list[tuple]):
    import pandas as pd

    frame = pd.DataFrame(outcomes, columns=[c.split()[0] for c in OUTCOME.split(", ")])
    return frame.astype({"sequence": "Int64", "id": "Int64", "revision": "Int64"})


class _Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        known = self.state.get() if self.state.exists() else None
        record = Record(*[known[i] for i in range(6)]) if known is not None else Record()
        record.waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        waited, out = list(record.waiting), []
        for row in sorted((r for frame in rows for r in _rows(frame)), key=lambda r: r[0]):
            out += _told(key[0], record, row)
        self.state.update((record.id, record.revision, record.value, record.mine, record.blocked, record.last))
        if record.waiting != waited:
            self.waiting.put(record.waiting) if record.waiting else self.waiting.clear()
        yield _frame(out)

    def handleInitialState(self, key, initial, timer_values) -> None:
        row = initial.iloc[0]
        self.state.update((int(row["id"]), int(row["revision"]), _plain(row["value"]), None, False, None))

    def close(self) -> None:
        pass


def replay_stream(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Outcomes of a stream of rows; the state of each record, with what waits, outlives micro-batches and restarts.

    known (record, id, revision, value) is what the server has at the start. Rows of a micro-batch are taken by sequence; a row that
    comes in a later micro-batch than its successors counts as a repetition. The state store must be RocksDB (ROCKS).
    """
    start = known.groupBy("record") if known is not None else None
    return _prepared(rows).groupBy("record").transformWithStateInPandas(_Replay(), OUTCOME, "Append", "None", start)


def replay_table(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Outcomes of a table of rows: sorted by record and sequence within partitions and folded in one pass, so a record of any length needs no more memory than what waits of it."""
    both = _prepared(rows).withColumn("_known", F.lit(False))
    if known is not None:
        first = known.select("record", F.lit(-(2**62)).alias("sequence"), F.lit("server").alias("source"), F.lit("put").alias("op"), F.col("revision").alias("expected"), "value", F.col("id").alias("new_id"), F.lit(True).alias("_known"))
        both = both.unionByName(first)

    def fold(frames: Iterable) -> Iterator:
        name, record = None, Record()
        for frame in frames:
            out = []
            keys, known_ = frame["record"].tolist(), frame["_known"].tolist()
            for key, is_known, row in zip(keys, known_, _rows(frame), strict=True):
                if key != name:
                    name, record = key, Record()
                if is_known:
                    record.id, record.revision, record.value = row[5], row[3], row[4]
                    continue
                out += _told(name, record, row)
            yield _frame(out)

    def in_order(frames: Iterable) -> Iterator:
        # _rows sorts a frame's rows by sequence: hand over one record's rows at a time
        for frame in frames:
            for _, part in frame.groupby((frame["record"] != frame["record"].shift()).cumsum(), sort=False):
                yield part

    return both.repartition("record").sortWithinPartitions("record", "sequence").mapInPandas(lambda frames: fold(in_order(frames)), OUTCOME)


def current(outcomes: DataFrame) -> DataFrame:
    """(record, id, revision, value) after the last outcome of each record; deleted ones have a null revision."""
    return outcomes.groupBy("record").agg(F.max_by(F.struct("id", "revision", "value"), F.struct("by", "part")).alias("s")).select("record", "s.*")
