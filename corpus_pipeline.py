"""A corpus pipeline over documents: quality, exact and near dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of documents.

Defined results: a null text counts as the empty one in every stage; very long texts are read whole; an empty table gives an
empty one; further columns, also those named like a stage's own, pass through all stages but the last. Rows repeated
under a key get the same verdict of the classifier, and where their texts are equal the later stages treat them alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, exact_dedup, mixing, quality, simhash
from tapeloom.llm.common import Scratch, table
from tapeloom.llm.queries import earlier_half


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs, earlier_half(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words."""
    return simhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole; those without words are never taken."""
    return mixing.repeat(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids decode to the text's bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can't express the classifier, the near-dedup and the encoding; tests/llm holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder before the next one begins."""
    scratch, docs = Scratch(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
