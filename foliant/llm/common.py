"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and A-Z, as the contracts spell them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch while tables are staged: whole texts are long, and a batch is held on both sides of a worker's pipe.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A side with at most so many rows may be broadcast; see sized_join.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or os.environ.get("FOLIANT_LOCAL_SHARED")
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    os.environ["FOLIANT_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="foliant-")
    return os.environ["FOLIANT_LOCAL_SHARED"]


def scratch_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, for tables that only one call needs; see removed."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder, or to a scratch folder in it, and read it back: lost executors cost no recomputation past this point."""
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before) if int(before) > 0 else BATCH_ROWS, BATCH_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder; nothing that is still to be computed may read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_caches: dict[str, object] = {}


def one_cache(owner: str, make):
    """A cache that outlives a task; a worker that is used again by another operator drops those it had, so it holds one at a time."""
    found = _caches.get(owner)
    if found is None:
        _caches.clear()
        found = _caches[owner] = make()
    return found


def task(run, keep_cache: bool = False):
    """run, a function of Arrow batches, such that its worker gives freed memory back to the system at the end of each task.

    Workers wait for further tasks, of other operators too, with all they hold.
    """

    def whole(batches):
        import ctypes
        import ctypes.util

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            if not keep_cache:
                _caches.clear()
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(ctypes.util.find_library("c"))
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def in_groups(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Slices of a list of texts of about so many bytes."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= size):
            n += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


#: Bytes of the rows that an operator of texts takes at once from an Arrow batch.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator, size: int | None = None) -> Iterator:
    """The rows of Arrow batches in slices of about `size` bytes (SLICE_BYTES), so that what is made of them does not grow with the batch."""
    for batch in batches:
        rows = max(1, batch.num_rows * (size or SLICE_BYTES) // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join a large, possibly skewed side with a side of one row per key.

    Up to BROADCAST_ROWS rows the small side is broadcast. Beyond that the keys are salted: the small side is
    repeated once per salt, so that a hot key's rows spread over `salts` tasks.
    """
    if at_most(small, BROADCAST_ROWS):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in on]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Plain values, batch by batch, of Arrow record batches."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
