"""Best-fit packing: few-document length patterns are fitted to the length histogram by non-negative least squares, rounded, and the rest is packed best-fit."""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged, table, task, text_bytes
from .encoding import default_tokenizer, encoder_for

MAX_TOKENS = 2048
#: Units that a sequence is divided into for the patterns; each is tried and the plan with the fewest sequences stays.
GRAINS = (16, 32, 64)
#: Most documents in an enumerated pattern.
PATTERN_DOCS = 3


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[best] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            negative = passive & (z <= 0)
            if not negative.any():
                break
            step = np.min(x[negative] / np.maximum(x[negative] - z[negative], 1e-300))
            x += step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
    return x


def length_patterns(units: int, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """All ways to fill `units` with 1 to `docs` lengths, each descending."""
    found = [(units,)]
    for n in range(2, docs + 1):
        found += [(units - sum(p), *p[::-1]) for p in combinations_with_replacement(range(1, units), n - 1) if p[-1] <= units - sum(p)]
    return found


class _Stock:
    """Pieces left by length, with the best fill of a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()

    def fit(self, gap: int, used: list[int]) -> list[int]:
        """Lengths to add for the gap: an exact one, an exact pair, or else the longest that fits; none if nothing fits."""
        if gap <= 0:
            return []
        left = self.left[: gap + 1].copy()
        for x in used:
            if x <= gap:
                left[x] -= 1
        there = left > 0
        there[0] = False
        if there[gap]:
            return [gap]
        pairs = np.flatnonzero(there & there[::-1])
        if gap % 2 == 0 and len(pairs) and left[gap // 2] < 2:
            pairs = pairs[pairs != gap // 2]
        if len(pairs):
            return [gap - int(pairs[0]), int(pairs[0])]
        fits = np.flatnonzero(there)
        return [int(fits[-1])] if len(fits) else []

    def take(self, pattern: list[int], most: int) -> int:
        """How often the pattern can be repeated, up to `most`; those pieces are gone."""
        lengths, n = np.unique(pattern, return_counts=True)
        times = int(min(most, (self.left[lengths] // n).min()))
        self.left[lengths] -= n * times
        return times


def pack_histogram(counts: np.ndarray, grain: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use every piece exactly once; counts[i] is the number of pieces of length i."""
    size = len(counts) - 1
    stock, plan = _Stock(counts), []
    if stock.left[size]:
        plan.append(([size], stock.take([size], int(stock.left[size]))))
    unit = max(1, size // grain)
    units = -(-size // unit)
    binned = np.bincount(-(-np.arange(1, size + 1) // unit), stock.left[1:], units + 1)
    patterns = [p for p in length_patterns(units) if len(p) > 1 and all(binned[u] for u in p)]
    if patterns:
        a = np.zeros((units + 1, len(patterns)))
        for j, p in enumerate(patterns):
            np.add.at(a[:, j], list(p), 1)
        repeats = np.floor(nnls(a, binned.astype(float))).astype(np.int64)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: patterns[j], reverse=True):
            todo = int(repeats[j])
            while todo > 0:
                chosen: list[int] = []
                for u in patterns[j][:-1]:  # all but the last come from their bin, longest first
                    low, high = (u - 1) * unit + 1, min(u * unit, size - sum(chosen))
                    fits = [x for x in range(high, low - 1, -1) if stock.left[x] > chosen.count(x)]
                    if not fits:
                        break
                    chosen.append(fits[0])
                else:
                    while more := stock.fit(size - sum(chosen), chosen):
                        chosen += more
                    done = stock.take(chosen, todo)
                    plan.append((chosen, done))
                    todo -= done
                    continue
                break
    for length in range(size, 0, -1):  # the rest, longest first
        while stock.left[length]:
            chosen = [length]
            while more := stock.fit(size - sum(chosen), chosen):
                chosen += more
            plan.append((chosen, stock.take(chosen, int(stock.left[length]))))
    return plan


def best_plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    return min((pack_histogram(counts, g) for g in GRAINS), key=lambda plan: sum(n for _, n in plan))


def plan_runs(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of that length from that rank on go to consecutive sequences."""
    rank: dict[int, int] = {}
    runs, sequence = [], 0
    for lengths, repeats in plan:
        offset = 0
        for x in lengths:
            runs.append((x, rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + repeats
            offset += x
        sequence += repeats
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def cut_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of each row's ids, closed by end_id: id, piece, start, length, ids_crc32. A null or empty text is the end id alone."""
    import pyarrow as pa

    path, end = tokenizer or default_tokenizer(), int(end_id).to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        encoder = encoder_for(path)
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    return rows.mapInArrow(task(cut, keep_cache=True), "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset. Every piece gets a place; sequences are gapless from 0 and hold at most max_tokens.

    Only the histogram, at most max_tokens rows, goes to the driver. Pieces of one length are numbered in buckets, so that
    a length that many pieces share is dealt over many tasks. Equal rows get different places. No rows give no rows.
    """
    import pyarrow as pa

    pieces = staged(pieces)
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    runs = pieces.sparkSession.sparkContext.broadcast(plan_runs(best_plan(counts)))

    buckets = int(max(64, counts.sum() // 200_000))
    rest = [c for c in pieces.columns if c != "length"]
    numbered = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*rest), F.lit(buckets)).cast("int"))
    sizes = numbered.groupBy("length", "_bucket").count()
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy(*rest)
    ranked = numbered.withColumn("_rank", F.row_number().over(within).cast("long")).join(first, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_first")).alias("_rank"))

    at, width = pieces.columns.index("length"), len(pieces.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(batches):
        table_ = runs.value
        keys = (table_[:, 0] << 44) + table_[:, 1]
        for batch in batches:
            rank = batch.column(width).to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, (batch.column(at).to_numpy(zero_copy_only=False) << 44) + rank, "right") - 1
            places = [table_[run, 2] + rank - table_[run, 1], table_[run, 3]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, places)], [*batch.schema.names[:width], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents")))
