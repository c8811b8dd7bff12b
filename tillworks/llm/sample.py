"""Labelled rows for training: a bounded, reproducible sample; every fifth id is held out."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import staged

if TYPE_CHECKING:
    import pandas as pd

FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def label_share(labels: DataFrame, label: str, key: str = "doc_id") -> float:
    """Share of label 1 among all labels that may be learned from; 0 without any."""
    return float(labels.where(F.col(label).isin(0, 1) & ~held_out(key)).agg(F.avg(F.col(label))).first()[0] or 0.0)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], mean_bytes: int,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label), in no order: distinct whole texts that are not empty, of any length, in hash order of their ids: of class c at most
    ``most[c]``, taken until they hold ``most[c] * mean_bytes`` bytes together (the last one may pass that).  Both bounds hold
    for training only; scoring reads every text whole.  Lengths and hashes of the labelled texts decide, so what is
    broadcast to the scan of the texts is at most the sample's ids."""
    marks = labels.where(F.col(label).isin(list(most)) & ~held_out(key)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).distinct()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.octet_length("text") > 0)
    texts = texts.withColumn("_digest", F.xxhash64("text"))
    sizes = texts.select("_key", "_digest", F.octet_length("text").alias("_size")).join(marks, "_key")
    sizes = staged(sizes.groupBy("label", "_digest").agg(F.max("_size").alias("_size"), F.min(F.struct(
        F.xxhash64("_key").alias("at"), F.col("_key").alias("key"))).alias("_first")), "sample-sizes")
    chosen = []
    for c, n in sorted(most.items()):
        total = 0
        for row in sizes.where(F.col("label") == c).orderBy("_first", "_digest").limit(n).collect():
            if total >= n * mean_bytes:
                break
            total += row["_size"]
            chosen.append((row["_first"]["key"], row["_digest"], c))
    key_type = texts.schema["_key"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"_key {key_type}, _digest bigint, label int")
    found = texts.join(F.broadcast(chosen), ["_key", "_digest"]).groupBy("label", "_digest").agg(F.min("text").alias("text"))
    return found.select("text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], mean_bytes: int,
                    key: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """The rows of ``sample_rows`` on the driver, by label and text."""
    found = sample_rows(docs, labels, label, most, mean_bytes, key, text)
    return found.toArrow().to_pandas().sort_values(["label", "text"]).reset_index(drop=True)
