"""A positional inverted index as tables: token -> document and place, by batches of documents, with segments that replace documents.

Searches read postings of the tokens they ask for and never a text. Each batch is sorted by token, so the scan skips the pages that
lie outside the tokens or prefixes asked for.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import staged
from . import catalog

_SEGMENT = "%012d"

#: Tokens of a batch of documents, unless one document has more, and places in a row of postings: what a task holds at once is bounded by them.
BATCH_TOKENS, ROW_PLACES = 1 << 21, 1024

#: Rows of a Parquet page of postings: a batch has many pages, of which a scan reads those with the tokens asked for.
PAGE_ROWS = 2000

#: Rows of an Arrow batch while postings are written: whole texts are long, and a batch is held on both sides of a worker's pipe.
_ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters alone, by Unicode's decompositions: Latin, Greek and Cyrillic."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x386, 0x3D0), *range(0x400, 0x460), *range(0x1E00, 0x2000)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case without accents, those written as marks of their own too."""
    lower = F.lower(c)
    bare = F.translate(F.regexp_replace(lower, "[\\u0300-\\u036f]", ""), *_accents())
    return F.when(lower.rlike("[^\\x00-\\x7f]"), bare).otherwise(lower)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in order, folded; null counts as empty."""
    return F.filter(F.split(folded(F.coalesce(c, F.lit(""))), text.NOT_TOKEN), lambda t: t != "")


def _raw_tokens(c: Column) -> Column:
    """What tokens() gives, before the letters' accents are folded and with empty ends."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    return F.split(F.when(lower.rlike("[\\u0300-\\u036f]"), F.regexp_replace(lower, "[\\u0300-\\u036f]", "")).otherwise(lower), text.NOT_TOKEN)


def _packed(rows: DataFrame) -> DataFrame:
    """(token, batch, first, last, docs, places) of rows (doc, tokens) or (doc, tokens, places): a token's places in a batch of documents, in their order.

    Rows of a batch are in order of their tokens. A row holds at most ROW_PLACES places, and `first` and `last` are its outermost documents. A batch folds each different token
    once. No accent of a letter parts tokens, so they may be folded after the text is split. Where a batch has an id again, the
    places of that row follow after a gap, so that no phrase runs over both texts.
    """
    kind = dict(rows.dtypes)["doc"]
    accents = str.maketrans(*_accents())
    most, wide = BATCH_TOKENS, ROW_PLACES

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        counted = lambda batch: pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)

        def cut():
            """Rows that follow each other, with at most `most` tokens or one row."""
            held, room = [], most
            for batch in batches:
                ends, begin = np.cumsum(counted(batch), dtype=np.int64), 0
                while begin < len(ends):
                    done = int(ends[begin - 1]) if begin else 0
                    end = max(int(np.searchsorted(ends, done + room, "right")), begin + (not held))
                    if end > begin:
                        held.append(batch.slice(begin, end - begin))
                        room, begin = room - (int(ends[end - 1]) - done), end
                    if begin < len(ends):
                        yield pa.concat_batches(held)
                        held, room = [], most
            if held:
                yield pa.concat_batches(held)

        def pack(batch, number):
            batch = batch.take(pc.sort_indices(batch.column(0)))
            words, lengths = pc.list_flatten(batch.column(1)).dictionary_encode(), counted(batch)
            known: dict[str, int] = {}
            folds = np.array([known.setdefault(w if w.isascii() else w.translate(accents), len(known)) for w in words.dictionary.to_pylist()], np.int32)
            names = pa.array(list(known), pa.string())
            by = pc.sort_indices(names).to_numpy()
            names, folds = names.take(pa.array(by)), np.argsort(by).astype(np.int32)[folds]  # codes in the tokens' order
            code, doc = folds[words.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            kept = code != (0 if "" in known else -1)
            code, doc = code[kept], doc[kept]
            if batch.num_columns > 2:
                place = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False)[kept]
            else:
                begins = np.flatnonzero(np.diff(doc, prepend=-1))
                place = np.arange(len(doc), dtype=np.int32) - np.repeat(begins.astype(np.int32), np.diff(begins, append=len(doc)))
            again = np.flatnonzero(np.diff(batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()) == 0) + 1
            if len(again):
                spans, shift = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
                np.maximum.at(spans, doc, place + 1)
                for i in again:
                    shift[i] = shift[i - 1] + spans[i - 1] + 1
                place = place + shift[doc]
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            begins = np.flatnonzero((np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))) % wide == 0)
            docs, offsets = batch.column(0).take(pa.array(doc[order])), pa.array(np.append(begins, len(code)), pa.int32())
            first, last = docs.take(pa.array(begins)), docs.take(pa.array(np.append(begins[1:], len(code))[: len(begins)] - 1))
            columns = [names.take(pa.array(code[begins])), pa.array(np.full(len(begins), number)), first, last]
            columns += [pa.ListArray.from_arrays(offsets, docs), pa.ListArray.from_arrays(offsets, pa.array(place[order], pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["token", "batch", "first", "last", "docs", "places"])

        number = TaskContext.get().partitionId() << 32  # no other task gives these
        for i, batch in enumerate(cut()):
            yield pack(batch, number + i)

    return rows.mapInArrow(run, f"token string, batch long, first {kind}, last {kind}, docs array<{kind}>, places array<int>")


class TextIndex:
    """An index in a folder that driver and executors share.

    postings/segment=N/ has rows (token, batch, first, last, docs, places): where a token stands in the documents that one batch
    held, sorted by token; frequencies/segment=N/ (token, uses); documents/segment=N/ the
    documents that the segment brings or removes. A document's last segment holds, so an upsert writes one segment and
    rewrites nothing; compact() merges all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _segments(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/documents")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("segment=")]
        marked = lambda name: sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, name)))
        base = max([0, *marked("_BASE")])
        return [s for s in marked("_SUCCESS") if s >= base]

    def exists(self) -> bool:
        return bool(self._segments())

    def write(self, docs: DataFrame, doc_id: str, body: str, removed: DataFrame | None = None) -> None:
        """Add or replace documents, and drop those in removed (doc_id). Of rows with one id all texts count as one document's."""
        segment = _SEGMENT % (1 + max([0, *self._segments()]))
        ids = docs.select(F.col(doc_id).alias("doc"), F.lit(True).alias("live"))
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col(doc_id).alias("doc"), F.lit(False).alias("live")))
        if docs.rdd.getNumPartitions() < (most := self.spark.sparkContext.defaultParallelism):
            docs = docs.repartition(most)  # a few large files; at scale there are more
        self._put(docs.select(F.col(doc_id).alias("doc"), _raw_tokens(F.col(body)).alias("token")), segment)
        ids.groupBy("doc").agg(F.max("live").alias("live")).write.mode("overwrite").parquet(f"{self.root}/documents/segment={segment}")  # last: it makes the segment count

    def _put(self, rows: DataFrame, segment: str) -> None:
        """Postings and frequencies of rows for _packed. Batches stay with the task that read their documents, so nothing but counts is shuffled."""
        path = f"{self.root}/postings/segment={segment}"
        packed = _packed(rows)
        before = self.spark.conf.get(_ARROW)
        self.spark.conf.set(_ARROW, str(min(int(before) if int(before) > 0 else ARROW_ROWS, ARROW_ROWS)))
        try:
            packed.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
        finally:
            self.spark.conf.set(_ARROW, before)
        counts = self.spark.read.schema(packed.schema).parquet(path).groupBy("token").agg(F.sum(F.size("places")).alias("uses"))
        counts.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.root}/frequencies/segment={segment}")

    def _all(self, part: str) -> DataFrame:
        names = [_SEGMENT % s for s in self._segments()]
        if not names:
            raise ValueError(f"no index in {self.root}")
        return self.spark.read.option("basePath", f"{self.root}/{part}").parquet(*[f"{self.root}/{part}/segment={n}" for n in names])

    def documents(self) -> DataFrame:
        """(doc, segment): the segment that holds each live document."""
        last = self._all("documents").groupBy("doc").agg(F.max_by("live", "segment").alias("live"), F.max("segment").alias("segment"))
        return last.where("live").select("doc", "segment")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows of postings with one row for each place of a live document; with one segment no join is needed."""
        rows = rows.withColumn("_p", F.explode(F.arrays_zip("docs", "places"))).withColumns({"doc": F.col("_p.docs"), "place": F.col("_p.places")}).drop("_p", "docs", "places")
        return rows.join(self.documents(), ["doc", "segment"], "left_semi") if len(self._segments()) > 1 else rows

    def postings(self, wanted: Column) -> DataFrame:
        """(token, doc, place) of live documents for tokens that pass a condition."""
        return self._placed(self._all("postings").where(wanted)).select("token", "doc", "place")

    def having_prefixes(self, words: list[str]) -> DataFrame:
        """(doc) of documents in which each word begins some token; no words give no rows."""
        found = [self._plain_token(w) for w in words]
        found = list(dict.fromkeys(f for f in found if f))
        if not found:
            return self.documents().select("doc").limit(0)
        begins = lambda w: F.col("token").startswith(w)  # noqa: E731  reaches the scan as a range of tokens
        wanted = begins(found[0])
        for w in found[1:]:
            wanted = wanted | begins(w)
        hits = self.postings(wanted).select("doc", *[begins(w).alias(f"_{i}") for i, w in enumerate(found)])
        sums = hits.groupBy("doc").agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(found))])
        return sums.where(" AND ".join(f"_{i}" for i in range(len(found)))).select("doc")

    def _plain_token(self, word: str) -> str:
        """A word as it is folded in the index, without what stands between tokens."""
        return "".join(self.spark.range(1).select(tokens(F.lit(word)).alias("t")).first()["t"])

    def phrase_hits(self, phrases: DataFrame, phrase_id: str, phrase_col: str) -> DataFrame:
        """(doc, phrase_id) where all tokens of the phrase stand together; phrases without tokens hit nothing.

        Each phrase looks up its rarest token; every place of that in a document is a place where the phrase may begin. The
        phrase's other tokens are then met in the packed postings of the same batch, and a beginning that meets all is a hit.
        Phrases are told apart by themselves, so an id may have several.
        """
        lines = phrases.select(F.col(phrase_id), F.monotonically_increasing_id().alias("_phrase"), tokens(F.col(phrase_col)).alias("tokens")).where(F.size("tokens") > 0)
        asked = staged(lines.select(phrase_id, "_phrase", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")))
        parts, words = catalog.sized(asked), catalog.sized(asked.select("token").distinct())
        counts = self._all("frequencies").join(words, "token").groupBy("token").agg(F.sum("uses").alias("uses"))
        rank = F.row_number().over(Window.partitionBy("_phrase").orderBy("uses", "at"))
        rarest = staged(counts.join(parts, "token").withColumn("_r", rank).where("_r = 1").select("_phrase", "at", "token"))
        found = self._placed(self._all("postings").join(catalog.sized(rarest), "token"))
        firsts = found.select("_phrase", "segment", "batch", "doc", (F.col("place") - F.col("at")).alias("start")).where("start >= 0")
        need = staged(firsts.join(parts, "_phrase").select(phrase_id, "_phrase", "n", "segment", "batch", F.col("doc").alias("_doc"), "start", "token", (F.col("start") + F.col("at")).alias("_place")))
        rows = self._all("postings").join(words, "token", "left_semi").join(need, ["segment", "batch", "token"])
        # first what costs least: the row's documents, then its places, then both together; ids may be null
        near = F.coalesce(F.col("_doc").between(F.col("first"), F.col("last")), F.lit(True)) & F.array_contains("places", F.col("_place"))
        met = rows.where(near & F.exists(F.arrays_zip("docs", "places"), lambda p: (p["places"] == F.col("_place")) & p["docs"].eqNullSafe(F.col("_doc"))))
        whole = met.groupBy(phrase_id, "_phrase", "n", "segment", "batch", "_doc", "start").agg(F.count("*").alias("found"))
        return whole.where("found = n").select(F.col("_doc").alias("doc"), phrase_id).distinct()

    def compact(self) -> None:
        """All live postings as one new segment; those before it are not read any more, their files stay until removed by their owner."""
        segment = _SEGMENT % (1 + max(self._segments()))
        docs = self.documents().select("doc", F.lit(True).alias("live"))
        # a document's postings come together again, since a phrase is looked for in one batch
        texts = self._placed(self._all("postings")).groupBy("segment", "batch", "doc").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("_p"))
        self._put(texts.select("doc", F.col("_p.token").alias("token"), F.col("_p.place").alias("place")), segment)
        docs.write.parquet(f"{self.root}/documents/segment={segment}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/documents/segment={segment}/_BASE")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path).close()


def search(
    files: DataFrame, index: TextIndex, key: str, name: str, path: str, query: str = "", filters: dict[str, str | None] | None = None, ids: dict[str, list[int] | None] | None = None
) -> DataFrame:
    """Files that pass all filters and, where the query has words, hold them in name or path, or all as prefixes in their text.

    The three ways of matching are one condition: the index gives the documents, the rest is read from the file's own row.
    """
    rows = catalog.equal_filters(files, filters or {})
    for column, wanted in (ids or {}).items():
        rows = catalog.in_ids(rows, column, wanted)
    words = [w for w in _words(query) if w]
    if not words:
        return rows
    needle = " ".join(words)
    hits = index.having_prefixes(words).select(F.col("doc").alias(key), F.lit(True).alias("_hit"))
    named = F.coalesce(text.like_literal(F.col(name), needle), F.lit(False)) | F.coalesce(text.like_literal(F.col(path), needle), F.lit(False))
    return rows.join(hits, key, "left").where(named | F.col("_hit")).drop("_hit")


def _words(query: str) -> list[str]:
    import re

    return re.findall(r"\w+", query)
