"""Vector codes: parts of integer vectors by the nearest of a few codebook entries, which Orchard's search finds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_join, staged, table, task

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components times SCALE must be smaller in size, so that distances and sums are exact in 64 bits.
LARGEST = 1 << 26
#: Vectors of one step of the search: what a task holds beside its batch is a few tables of so many rows.
STEP_ROWS = 4096


@dataclass
class Codebooks:
    """entries[p, e]: entry e of part p, its components padded with zeros to the longest part; bounds: where parts begin and end."""

    entries: np.ndarray
    bounds: list[int]

    @property
    def length(self) -> int:
        return self.bounds[-1]

    def sha256(self) -> str:
        """Of all decimal components by part, entry and place, joined by commas."""
        parts = [self.entries[p, :, : b - a].ravel() for p, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False))]
        return hashlib.sha256(",".join(map(str, np.concatenate(parts).tolist() if parts else [])).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        widths = np.diff(self.bounds)
        return [int(x) for p, e in enumerate(bytes.fromhex(code)) for x in self.entries[p, e, : widths[p]]]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite and of a size that is exact in 64 bits. NaN compares as larger than all."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * SCALE < LARGEST)), F.lit(False))


def integer_parts(flat: np.ndarray, bounds: list[int]) -> np.ndarray:
    """(vector, part, place) of floor(SCALE * x), parts padded with zeros to the longest."""
    whole = np.floor(SCALE * flat.astype(np.float64)).astype(np.int64)
    widths = np.diff(bounds)
    out = np.zeros((len(whole), len(widths), max(1, widths.max(initial=0))), np.int64)
    for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        out[:, p, : b - a] = whole[:, a:b]
    return out


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry: all entries by distance from it, ties by index, and those squared distances."""
    apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
    order = np.argsort(apart, axis=2, kind="stable")
    return order, np.take_along_axis(apart, order, 2)


def orchard(rows: np.ndarray, part: np.ndarray, entries: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row in the codebook of its part, ties to the lower index, and the squared distance.

    Each row walks the neighbour list of the best entry so far. An entry that is better, or as good with a lower index,
    becomes the best, and the walk goes on at the beginning of its list; entries looked at before are passed over. The walk
    ends at the list's end, or where an entry is further from the best than twice the row is: it is then strictly
    further from the row. All rows walk at once, one list place a step; those that have ended leave.
    """
    n, k = len(rows), entries.shape[1]
    each = np.arange(n)
    # the walk begins at the entry whose first component is the nearest
    first = np.abs(entries[:, :, 0][part] - rows[:, :1]).argmin(1)
    best = first
    least = ((rows - entries[part, best]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[each, best] = True
    place = np.zeros(n, np.int64)
    live = each
    while live.size:
        b, p = best[live], part[live]
        at = place[live]
        on = (at < k) & (apart[p, b, np.minimum(at, k - 1)] <= 4 * least[live])
        live, b, p, at = live[on], b[on], p[on], at[on]
        e = order[p, b, at]
        place[live] += 1
        new = ~seen[live, e]
        look, b, p, e = live[new], b[new], p[new], e[new]
        seen[look, e] = True
        d = ((rows[look] - entries[p, e]) ** 2).sum(1)
        better = (d < least[look]) | ((d == least[look]) & (e < b))
        moved = look[better]
        best[moved], least[moved], place[moved] = e[better], d[better], 0
    return best, least


def assigned(parts: np.ndarray, books: Codebooks, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, part) of the nearest entries, and of squared distances."""
    n, p, w = parts.shape
    codes, errors = np.zeros((n, p), np.int64), np.zeros((n, p), np.int64)
    for a in range(0, n, STEP_ROWS):
        some = parts[a : a + STEP_ROWS]
        best, least = orchard(some.reshape(-1, w), np.tile(np.arange(p), len(some)), books.entries, *lists)
        codes[a : a + STEP_ROWS], errors[a : a + STEP_ROWS] = best.reshape(-1, p), least.reshape(-1, p)
    return codes, errors


def _matrix(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def part_sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (number of parts that are nearest to it, their sums by place).

    Each task adds up its own rows first; what meets at the driver is at most one row an entry and place.
    """
    import pyarrow as pa

    width = books.entries.shape[2]

    def run(batches):
        k, lists = books.entries.shape[1], neighbour_lists(books.entries)
        counts, sums = np.zeros(PARTS * k, np.int64), np.zeros((PARTS * k, width), np.int64)
        for batch in batches:
            parts = integer_parts(_matrix(batch.column(0), books.length), books.bounds)
            at = (assigned(parts, books, lists)[0] + np.arange(PARTS) * k).ravel()
            counts += np.bincount(at, minlength=PARTS * k)
            flat = parts.reshape(-1, width)
            for j in range(width):
                sums[:, j] += np.bincount(at, weights=flat[:, j], minlength=PARTS * k).astype(np.int64)  # below 2 ** 53 in a batch
        met = np.flatnonzero(counts)
        table_ = np.concatenate([counts[met, None], sums[met]], axis=1)
        rows = [np.repeat(met, width + 1), np.tile(np.arange(width + 1), len(met)), table_.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["at", "place", "total"])

    totals = kept.select("vector").mapInArrow(task(run), "at long, place long, total long").groupBy("at", "place").agg(F.sum("total").alias("total"))
    out: dict[int, list[int]] = {}
    for at, place, total in totals.collect():
        out.setdefault(at, [0] * (width + 1))[place] = total
    k = books.entries.shape[1]
    return {(at // k, at % k): (row[0], row[1:]) for at, row in out.items()}


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table: the parts of its `entries` smallest ids, moved `rounds` times to the mean of what is nearest to them.

    Rows of one id go by their vectors, those without an id come last. The smallest row's length is that of all vectors
    (see encode). A length that is no multiple of PARTS is cut as evenly as it can be. None if no vector can be used.
    """
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    kept = vectors.where(usable(v) & (F.size(v) > 0)).select(i.alias("id"), v.alias("vector"))
    line = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*line).limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    kept = kept.where(F.size("vector") == length)
    if any(len(r["vector"]) != length for r in first):
        first = kept.orderBy(*line).limit(entries).collect()
    bounds = [p * length // PARTS for p in range(PARTS + 1)]
    books = Codebooks(integer_parts(np.array([r["vector"] for r in first]), bounds).transpose(1, 0, 2).copy(), bounds)
    for _ in range(rounds):
        moved = books.entries.copy()
        for (p, e), (n, sums) in part_sums(kept, books).items():
            moved[p, e] = [x // n for x in sums]
        books = Codebooks(moved, bounds)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of the vectors that can be used, in one pass without a shuffle.

    code has two hexadecimal digits a part; error is the squared distance to what the code stands for. Vectors that are
    null, empty or hold null, non-finite or huge components (LARGEST / SCALE, far above any embedding's) are left out, and so are those of
    another length than the codebooks'. Repeated rows and ids are coded each; ids may be null; other columns are not
    looked at, whatever their names. Without codebooks (an empty table) there are no rows.
    """
    import pyarrow as pa

    v = F.col(f"`{vector_col}`")
    rows = vectors.where(usable(v) & (F.size(v) == (books.length if books else -2))).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("vector"))
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    digits = [f"{x:02x}" for x in range(256)]

    def run(batches):
        lists = neighbour_lists(books.entries)
        for batch in batches:
            parts = integer_parts(_matrix(batch.column(2), books.length), books.bounds)
            codes, errors = assigned(parts, books, lists)
            text = ["".join([digits[x] for x in row]) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(task(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (see encode) with label_error, the sum of the errors of all rows of the same label; rows without a label are one."""
    coded = staged(coded.withColumn("_label", F.when(F.col("label").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))))
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return sized_join(coded, sums, ["_label"]).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = fit_codebooks(vectors)
    out = with_label_error(encode(vectors, books))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _round_sql(i: int, final: bool = False) -> str:
    """SQL of one assignment, and of the codebook that follows from it."""
    near = f"""
near{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN book{i} b ON x.part = b.part) GROUP BY vec_id, part)"""
    if final:
        return near
    return f"""{near},
means{i} AS (SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT x.part, n.entry, a.pos, floor(sum(x.v[a.pos])::DOUBLE / count(*))::BIGINT AS m
    FROM parts x JOIN near{i} n ON x.vec_id = n.vec_id AND x.part = n.part, (SELECT unnest(range(1, w + 1)) AS pos FROM width) a GROUP BY ALL) GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry)"""


#: For tables whose ids are distinct and whose vectors have one length, a multiple of PARTS: all pairs of parts and entries.
OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS line
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT any_value(len(v)) // {PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, line, p AS part, v[p * w + 1 : p * w + w] AS v FROM kept, width, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT part, line AS entry, v FROM parts WHERE line < {ENTRIES}),{",".join(_round_sql(i) for i in range(ROUNDS))},{_round_sql(ROUNDS, True)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha
"""
