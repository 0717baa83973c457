"""The corpus pipeline: from raw documents to packed training sequences, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import remainder, staged, table
from foliant.llm.language_id import fit, keep_known
from foliant.llm.ngram_jaccard import keep_one
from foliant.llm.secret_scan import mask_secrets
from foliant.llm.sequence_packing import cut_pieces, pack
from foliant.llm.source_mix import mixed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go; a missing language is filled in."""
    return keep_known(docs, fit(docs.where(remainder(F.col("doc_id"), 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a likeness of 0.8 or more of their five-word shingles."""
    return keep_one(docs, k=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents without any stay as they are."""
    return mask_secrets(docs, chars_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: documents are left out or repeated, at most three times, in mixed order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    return pack(cut_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: No SQL form: the tokenizer and the least-squares packing are outside SQL. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
