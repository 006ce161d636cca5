"""A training corpus from raw documents: filter, dedup lines, dedup documents, mix, pack.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
all but the last return the columns of ``documents``.  Stages are joined by Parquet tables
in the shared folder, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from tallyflow.llm.scratch import Scratch

#: Near copies are linked from 80 % on; 28 bands of 4 rows miss 4e-7 of the pairs at that similarity.
NEAR = near_dedup.Similarity(percent=80, bands=28, rows=4, batch=28)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` outside the held-out fold."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).filter("predicted = 1").select(docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without repeated lines; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample drawn at the calibrated probabilities of source, language and topic."""
    return mixing.mix(docs).filter("sampled").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return packing.number_sequences(packing.decompose(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", cut_lines),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: The classifier has no SQL form; the tests compare every stage with a literal version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
