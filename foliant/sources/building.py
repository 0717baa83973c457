"""Incremental build of a file catalog: unchanged files are never opened, and of equal contents one file is extracted.

Two components of a commit log: `files` (one row a file) and `texts` (one row a content hash and kind of reader). A run lists the tree,
compares sizes and times with the files of the last commit, hashes what changed, extracts one file of each new content and commits both.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from . import files
from .commits import KEPT, Commit, CommitLog

#: So many paths at most are named to the reader; beyond that the tree is read and joined with them.
NAMED_PATHS = 256
TEXTS = f"hash string, extension string, status string, blocks {files.BLOCKS}, text string, family string, priority int"


@dataclass
class Build:
    """What a run did: the commit, and how many files it saw, found unchanged, opened and extracted."""

    commit: Commit
    seen: int = 0
    unchanged: int = 0
    opened: int = 0
    extracted: int = 0
    removed: int = 0
    words: dict = field(default_factory=dict)


def _uri(root: str, path: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.col(path))


def _opened(spark: SparkSession, root: str, wanted: DataFrame, count: int) -> DataFrame:
    """(relative_path, extension, content) of the wanted files and no others, as far as they can be named."""
    if count <= NAMED_PATHS:
        named = [r["relative_path"] for r in wanted.select("relative_path").collect()]
        if not named:
            return files.scan_files(spark, root).limit(0).select("relative_path", "extension", "content")
        rows = files.scan_files(spark, root, only=named)
    else:
        rows = files.scan_files(spark, root).join(wanted.select("relative_path"), "relative_path", "left_semi")
    return rows.select("relative_path", "extension", "content")


def extracted(found: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """TEXTS of opened files (hash, extension, content, filename)."""
    rows = files.read_blocks(found)
    body = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    points = text.document_priority(F.col("filename"), F.col("text"), words.get("important", []), words.get("cues", []), words.get("technical", []))
    return rows.withColumn("text", body).select("hash", "extension", "status", "blocks", "text", text.family_key(F.col("text")).alias("family"), points.alias("priority"))


def build(spark: SparkSession, root: str, log: CommitLog, most_bytes: int = 1 << 28, words: dict[str, list[str]] | None = None, verify: bool = False) -> Build:
    """One run over the tree below root. With verify no file counts as unchanged, so contents are hashed again; their texts are still reused.

    Files above most_bytes or of unknown kinds are listed and not opened. A run that changes nothing commits nothing. Two
    runs at once: the second to commit raises CommitConflict and leaves the first's result.
    """
    base = log.last()
    known, texts = log.table("files", base), log.table("texts", base)
    listed = files.list_files(spark, root).withColumn("reason", files.ineligible(F.col("extension"), F.col("size"), True, [*files.TEXT, "docx", "xlsx"], most_bytes))
    columns = ["relative_path", "filename", "extension", "size", "modified", "reason"]
    same = F.lit(False)
    if known is not None:
        was = known.select("relative_path", *[F.col(c).alias(f"_{c}") for c in ("size", "modified", "reason", "hash")])
        rows = listed.select(*columns).join(was, "relative_path", "full_outer")
        if not verify:
            same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")) & F.col("reason").eqNullSafe(F.col("_reason"))
    else:
        rows = listed.select(*columns).withColumn("_hash", F.lit(None).cast("string"))
    rows = rows.withColumn("state", F.when(F.col("filename").isNull(), "removed").when(same, "unchanged").when(F.col("reason").isNotNull(), "listed").otherwise("changed"))
    rows = rows.cache()  # one listing for the run's count, its reading and its commit; recomputed from the tree if lost
    try:
        counts = {r["state"]: r["count"] for r in rows.groupBy("state").count().collect()}
        done = Build(base, sum(v for k, v in counts.items() if k != "removed"), counts.get("unchanged", 0), counts.get("changed", 0), 0, counts.get("removed", 0), words or {})
        if known is not None and not (done.opened or done.removed or counts.get("listed")):
            return done
        changed = rows.where("state = 'changed'").select("relative_path", "filename", "extension")
        hashed = log.write("_hashes", _opened(spark, root, changed, done.opened).select("relative_path", "extension", F.sha2("content", 256).alias("hash")))
        hashes = spark.read.parquet(f"{log.root}/{hashed}")
        # of each content the first path leads, and the others take what it gives
        leaders = hashes.groupBy("hash", "extension").agg(F.min("relative_path").alias("relative_path"))
        if texts is not None:
            leaders = leaders.join(texts.select("hash", "extension"), ["hash", "extension"], "left_anti")
        leaders = leaders.cache()
        done.extracted = leaders.count()
        update = {}
        if done.extracted or texts is None:
            opened = _opened(spark, root, leaders, done.extracted).join(leaders.select("relative_path", "hash"), "relative_path")
            new = extracted(opened.withColumn("filename", F.element_at(F.split("relative_path", "/"), -1)), done.words)
            update["texts"] = new if texts is None else texts.unionByName(new)
        kept = rows.where("state <> 'removed'").join(hashes.select("relative_path", "hash"), "relative_path", "left")
        update["files"] = kept.select(*columns, F.when(F.col("state") == "changed", F.col("hash")).when(F.col("state") == "unchanged", F.col("_hash")).alias("hash"), paths.classify_root(F.col("relative_path")).alias("root"))
        done.commit = log.publish(update, base, "build")
        leaders.unpersist()
        return done
    finally:
        rows.unpersist()


def catalog(log: CommitLog, commit: Commit | None = None) -> DataFrame:
    """Files with status, text, family and priority as of a commit; files that were not opened have their reason as status."""
    rows, texts = log.table("files", commit), log.table("texts", commit)
    return rows.join(texts.drop("blocks"), ["hash", "extension"], "left").withColumn("status", F.coalesce("status", "reason"))


def sweep_texts(log: CommitLog, predecessors: int = KEPT) -> int:
    """Drop extracted contents that no file of the last commit or its kept predecessors has; how many went. Their files' own versions stay as they are."""
    base = log.last()
    texts = log.table("texts", base)
    if texts is None:
        return 0
    kept = [log.read(n) for n in log.numbers()[-predecessors - 1 :]]
    tables = [log.table("files", c) for c in {c.components["files"]: c for c in kept if "files" in c.components}.values()]
    used = reduce(DataFrame.unionByName, [t.select("hash", "extension") for t in tables]).where("hash IS NOT NULL").distinct()
    gone = texts.join(used, ["hash", "extension"], "left_anti").count()
    if gone:
        log.publish({"texts": texts.join(used, ["hash", "extension"], "left_semi")}, base, "sweep of texts")
    return gone
