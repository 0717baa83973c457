"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window (rightmost on ties), positions kept."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, task, text_bytes

#: k-gram length and window, in code points: any shared passage of K + WINDOW - 1 = 47 code points shares a fingerprint.
K, WINDOW = 16, 32
#: Longest stretch of k-gram hashes handled at once; stretches overlap by a window, so results do not depend on it.
STRETCH = 1 << 20
BASE = 0x9E3779B97F4A7C15
_HASH_BITS = np.uint64(43)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _doubling(values: np.ndarray, length: int, join) -> np.ndarray:
    """For each i, join over values[i : i + length], from joins over lengths that are powers of two."""
    out, have, part, size = None, 0, values, 1
    while True:
        if length & size:
            if out is None:
                out, have = part, size
            else:
                n = len(values) - have - size + 1
                out, have = join(out[:n], part[have : have + n], size), have + size
        if 2 * size > length:
            return out
        part, size = join(part[:-size], part[size:], size), 2 * size


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all k-grams, 43 bits each."""
    h = _doubling(points.astype(np.uint64) + np.uint64(1), k, lambda a, b, n: a * _power(n) + b)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> (np.uint64(64) - _HASH_BITS)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the text's fingerprint, by position.

    A text shorter than k has one entry, of the whole text at 0; a text with fewer k-grams than a window has the least
    of them; the empty text has none. Equal texts have equal fingerprints.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = kgram_hashes(points, min(k, len(points)))
    width = min(window, len(h))
    kept, mask = [], np.uint64(STRETCH * 2 - 1)
    for start in range(0, len(h) - width + 1, STRETCH):
        part = h[start : start + STRETCH + width - 1]
        # the hash above, the reversed position below: the least key is the least hash, rightmost on ties
        keys = (part << np.uint64(21)) | (mask - np.arange(len(part), dtype=np.uint64))
        least = _doubling(keys, width, lambda a, b, _: np.minimum(a, b))
        kept.append(np.unique((mask - (least & mask)).astype(np.int64)) + start)
    at = np.unique(np.concatenate(kept)) if len(kept) > 1 else kept[0]
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hash sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def digest(mark: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex SHA-256 of a fingerprint's hashes and positions."""
    return hashlib.sha256(mark[0].astype("<u8").tobytes() + mark[1].astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hashes array<long>, positions array<long> of each row's whole text; null counts as empty, repeated rows repeat."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            marks = [winnow(t.decode("utf-8", "replace"), k, window) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([m[i].astype(np.int64) for m in marks], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "hashes", "positions"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, "id long, hashes array<long>, positions array<long>").withColumnRenamed("id", id_col)


#: Documents per range of the ordering below, and most ranges: their bounds go through the driver.
RANGE_ROWS, RANGES = 2_000, 20_000


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, guard, id, t) sorted by id inside each range's partition, with the first row of the next range as guard.

    Ranges hold about RANGE_ROWS documents each, by approximate quantiles of the id. The last range's guard is the
    table's first row, so every row but guards has its successor behind it. Null ids come first; ties go by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    ids = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("key"))
    ranges = max(1, min(ids.count() // RANGE_ROWS, RANGES))
    cuts = [0]
    if ranges > 1:
        cuts = ids.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype("int32"))

    placed = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("range", range_of("key"))
    firsts = placed.select("range", "key").groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # one row a range, at most RANGES
    before = {now["key"]: then["range"] for then, now in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)} if firsts else {}
    guards = spark.createDataFrame([(k, r) for k, r in before.items()] or [(0, -1)], "key long, guard_of int")
    both = placed.join(F.broadcast(guards), "key", "left")
    own = F.struct(F.col("range"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("guard_of").alias("range"), F.lit(1).alias("guard"))
    dealt = both.select("id", "key", "t", F.explode(F.when(F.col("guard_of").isNull(), F.array(own)).otherwise(F.array(own, guard))).alias("p"))
    dealt = dealt.select(F.col("p.range").alias("range"), F.col("p.guard").alias("guard"), "id", "key", "t")
    return dealt.repartition(max(ranges, 8), "range").sortWithinPartitions("range", "guard", "key", "t").select("range", "guard", "id", "t")


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks.

    The next document is the one with the next id (after the last, the first); a table of one row is its own next. Null
    and empty texts count as empty. Rows that repeat an id follow one another by text. Of several rows that share a
    range's first id, the least text is the guard. An empty table gives no rows.
    """
    import pyarrow as pa

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_marks"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def pair(doc, text, mark, following, next_mark):
        other = edited(text, following)
        other_mark = winnow(other, k, window)
        return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), digest(mark), digest(other_mark), likeness(mark[0], other_mark[0]), likeness(mark[0], next_mark[0]), len(mark[0]))

    def run(batches):
        held = None  # the row before: range, guard, id, text, fingerprint
        for batch in batches:
            out = []
            for part, guard, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == part and held[1]:
                    continue  # more rows with the guard's id
                text = raw.decode("utf-8", "replace")
                mark = winnow(text, k, window)
                if held is not None and held[0] == part:
                    out.append(pair(held[2], held[3], held[4], text, mark))
                held = (part, guard, doc, text, mark)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long"
    return in_order(docs, id_col, text_col).mapInArrow(task(run), schema).withColumnRenamed("id", id_col)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
