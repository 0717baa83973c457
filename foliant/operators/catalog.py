"""Catalog operators: search, facets, rollups, coverage and ranked evidence over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..sources.shared import staged

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def check_page(limit: int, offset: int, most: int = 2000) -> None:
    if isinstance(limit, bool) or isinstance(offset, bool) or not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in order; with a limit this is a top-k of each partition, not a full sort."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def columns_there(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def equal_filters(df: DataFrame, values: dict[str, str | None], nocase: bool = True) -> DataFrame:
    """Equality on each given column. A value of None is no filter; a filter on a missing column gives no rows."""
    for name, value in values.items():
        if value is None:
            continue
        if name not in df.columns:
            return df.limit(0)
        df = df.where(text.ascii_fold(F.col(name)) == text.ascii_fold(F.lit(value)) if nocase else F.col(name) == value)
    return df


def in_ids(df: DataFrame, column: str, ids: list[int] | None) -> DataFrame:
    """None is no filter; an empty list gives no rows."""
    if ids is None:
        return df
    return df.where(F.col(column).isin(ids)) if ids else df.limit(0)


def token_grams(tokens: Column, words: int) -> Column:
    """64-bit keys of all runs of `words` tokens; each token is hashed once."""
    key = lambda h, i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)])
    grams = lambda h: F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: key(h, i))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(F.transform(tokens, lambda t: F.xxhash64(t))), grams)[0]


def phrase_hits(docs: DataFrame, phrases: DataFrame, words: int, doc_id: str, text_col: str, phrase_id: str, phrase_col: str) -> DataFrame:
    """(doc_id, phrase_id) where all tokens of the phrase stand together in the document; phrases without tokens hit nothing.

    Documents give the keys of their token n-grams, each once, and meet the phrases' first ones on equality, so nothing is
    compared pair by pair; shorter phrases meet n-grams of their own length. The whole phrase is then looked for in what met.
    """
    tokens = text.search_tokens(F.col(phrase_col))
    lines = phrases.select(F.col(phrase_id), text.token_line(F.col(phrase_col)).alias("phrase"), F.least(F.size(tokens), F.lit(words)).alias("n"), tokens.alias("tokens")).where("n > 0")
    lengths = [r["n"] for r in lines.select("n").distinct().orderBy("n").collect()]  # at most `words`
    if not lengths:
        return docs.select(doc_id).join(phrases.select(phrase_id), F.lit(False))
    first = F.coalesce(*[F.when(F.col("n") == n, F.get(token_grams(F.slice("tokens", 1, n), n), F.lit(0))) for n in lengths])
    wanted = lines.select(phrase_id, F.struct("n", first.alias("key")).alias("gram"))
    named = lambda n: lambda key: F.struct(F.lit(n).alias("n"), key.alias("key"))
    grams = [F.transform(F.array_distinct(token_grams(text.search_tokens(F.col(text_col)), n)), named(n)) for n in lengths]
    met = docs.select(F.col(doc_id), F.explode(F.concat(*grams)).alias("gram")).join(wanted, "gram").select(doc_id, phrase_id).distinct()
    found = docs.select(doc_id, F.col(text_col).alias("_text")).join(met, doc_id).join(lines.select(phrase_id, "phrase"), phrase_id)
    return found.where(F.contains(text.token_line(F.col("_text")), F.col("phrase"))).select(doc_id, phrase_id).distinct()


def facets(sources: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(facet, value) of the distinct non-empty values of each (name, table, column)."""
    out = None
    for name, df, column in sources:
        one = df.select(F.lit(name).alias("facet"), column.cast("string").alias("value")).where("value <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def rollup_direct(folders: DataFrame, files: DataFrame, key: str, size: Column, modified: Column) -> DataFrame:
    """folders with files, bytes and last of what lies directly in them; empty folders stay with 0. Files are summed before the join."""
    sums = files.groupBy(key).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(modified).alias("last"))
    return folders.join(sums, key, "left").withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def rollup_recursive(files: DataFrame, path: Column, size: Column) -> DataFrame:
    """(folder, files, bytes) of everything below each folder: each file is counted at its ancestors, no range join."""
    spread = files.select(F.explode(paths.ancestors(path)).alias("folder"), size.alias("size"))
    return spread.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def prune_tree(folders: DataFrame, path: str, match: Column) -> DataFrame:
    """Folders that match or have a matching descendant."""
    kept = folders.where(match).select(F.explode(F.concat(paths.ancestors(F.col(path)), F.array(path))).alias(path)).distinct()
    return folders.join(kept, path, "left_semi")


def coverage(roots: DataFrame, files: DataFrame, key: str, status: Column, reason: Column) -> DataFrame:
    """(key, status, reason, files); roots without files stay with a null status and 0 files."""
    sums = files.groupBy(key, status.alias("status"), reason.alias("reason")).agg(F.count("*").alias("files"))
    return roots.select(key).distinct().join(sums, key, "left").withColumn("files", F.coalesce("files", F.lit(0)))


def coverage_maps(cover: DataFrame, key: str) -> DataFrame:
    """Per key a map status -> files and a map reason -> files, empty reasons left out."""
    by = lambda c: F.map_from_entries(F.filter(F.sort_array(F.collect_list(F.struct(F.col(c), F.col("n")))), lambda e: F.coalesce(e[c], F.lit("")) != ""))
    status = cover.groupBy(key, "status").agg(F.sum("files").alias("n")).groupBy(key).agg(by("status").alias("by_status"))
    return status.join(cover.groupBy(key, "reason").agg(F.sum("files").alias("n")).groupBy(key).agg(by("reason").alias("by_reason")), key)


def ranked_evidence(files: DataFrame, content: DataFrame, key: str, root: str, order: list[Column], take: int, skip: int = 0) -> DataFrame:
    """The rows ranked skip+1 to skip+take of each root, joined with their text only after ranking.

    What is ranked is written first: its size is then known, and where it is small the texts are only scanned, not shuffled.
    """
    rank = F.row_number().over(Window.partitionBy(root).orderBy(*order))
    best = staged(files.withColumn("rank", rank).where((F.col("rank") <= skip + take) & (F.col("rank") > skip)))
    return content.join(sized(best), key)


def relevance(title: Column, subtitle: Column, query: str) -> Column:
    """0 exact title, 1 prefix, 2 in the title, 3 in the subtitle, 4 other."""
    t, s, q = text.ascii_fold(title), text.ascii_fold(subtitle), query.lower()
    return F.when(t == q, 0).when(t.startswith(q), 1).when(t.contains(q), 2).when(s.contains(q), 3).otherwise(4)


def kind_counts(records: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n) with a 0 for kinds without records."""
    every = records.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(every).join(records.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
