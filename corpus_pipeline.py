"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

Toxic documents go, then exact copies, then near copies (one document of each class stays); the rest is mixed to source
weights, rows of small sources being repeated, and packed into sequences.  All stages but the last return the columns
of their input.  Every stage takes all rows its predecessor kept; cases with NULLs, empty texts, ties and repeated rows are
those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillworks.llm import crf, exact_dedup, lshforest, mixing, packing
from tillworks.llm.common import share_code, staged, table

#: Documents that score this or more are rejected.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = crf.fit(docs, table(spark, sf_dir, "labels"))
    return crf.score(docs, model, spans=False).where(f"score < {TOXIC}").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lshforest.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: A conditional random field and a MinHash forest have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
