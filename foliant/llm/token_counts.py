"""Token counts: one exact histogram of encoded lengths answers totals, quantiles and truncated totals for every limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, task, text_bytes
from .encoding import default_tokenizer, encoder_for

#: Lengths per bucket of the two-level sums below.
BUCKET = 128


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens) per row of docs. Null and empty texts have length 0; repeated rows count each time."""
    import pyarrow as pa

    path = tokenizer or default_tokenizer()

    def lengths(batches):
        encoder = encoder_for(path)
        for batch in batches:
            n = [len(encoder.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    return rows.mapInArrow(task(lengths, keep_cache=True), "id long, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length with its suffix sums; an empty input gives no rows.

    n_docs: documents of this length; docs_at_least, tokens_at_least: those of this length or longer; docs_to, tokens_to:
    those up to it. truncated_total is the total when each document is cut at this length, and for any limit L
    between two lengths a < L < b it is tokens_to(a) + L * docs_at_least(b). quantile is docs_to over all documents.
    """
    counts = staged(lengths.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n_docs")))  # read twice below
    counts = counts.withColumn("bucket", F.floor(F.col("length") / BUCKET)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    # sums inside a bucket, and sums over the buckets before it: no window holds more than BUCKET lengths or one row a bucket
    inside = Window.partitionBy("bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    buckets = counts.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    out = counts.join(buckets, "bucket").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_before")).alias("docs_to"),
        (F.sum("tokens").over(inside) + F.col("tokens_before")).alias("tokens_to"),
        "all_docs",
        "all_tokens",
    )
    at_least = F.col("all_docs") - F.col("docs_to") + F.col("n_docs")
    return out.select(
        "length",
        "n_docs",
        "docs_to",
        "tokens_to",
        at_least.alias("docs_at_least"),
        (F.col("all_tokens") - F.col("tokens_to") + F.col("length") * F.col("n_docs")).alias("tokens_at_least"),
        (F.col("tokens_to") + F.col("length") * (F.col("all_docs") - F.col("docs_to"))).alias("truncated_total"),
        (F.col("docs_to") / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, total, n_cut) for any context limits, from the histogram alone."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    cut = F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)
    return (
        histogram.select("length", "n_docs")
        .withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
        .groupBy("limit")
        .agg(F.sum(F.least("length", "limit") * F.col("n_docs")).alias("total"), F.sum(cut).alias("n_cut"))
        .join(asked, "limit", "right")
        .select("limit", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
