"""Resample a corpus towards a target distribution by hashed word n-grams (importance weights, Gumbel top-k).

Features of a text are its words and its pairs of consecutive words, hashed to buckets.  A bucket's gain is the rounded
log ratio of its smoothed shares in target and corpus; a document's weight is the mean gain over its features, and its
score adds Gumbel noise drawn from its id, so that taking the highest scores samples without replacement in proportion to
the exponential of the weights, and reruns agree.

Arrow kernels do the work inside tasks: ascii_lower, split_pattern_regex and list_flatten give flat words, dictionary_encode
their numbers; numbers shifted by one row form pairs, distinct pairs are hashed once, ``take`` brings buckets and gains
back to the rows, and segments are reduced to documents.  A pass over the corpus counts buckets (one row per bucket and
task is shuffled), a second one weighs.  Ranks come from a range sort of (score, id) and prefix sums of partition sizes.
The driver holds one number per bucket; what is broadcast are those and one row per sort partition.

Cases: NULL and empty texts have no features and weight 0; NULL ids count as empty text for the noise and rank behind equal
scores; rows that repeat are ranked one by one; an empty table or target gives no rows, or gains against an empty target;
texts longer than a piece are read in parts, pairs across parts included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import bounded_batches, staged
from tillworks.llm.tokens import PIECE_BYTES, crc32_of, encoded, pieces, split_words

BUCKETS = 10_000
SHARE = 25  # percent of the eligible documents that are drawn
LEAST_WORDS = 20
SEED = 7
SCALE = 1_000  # gains and scores are whole thousandths


def piece_buckets(texts: pa.Array, buckets: int, last: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
    """(bucket of each word, bucket of the pair that ends there or -1, first word of each text and the end, last word).
    ``last`` is the word before the first one, when the texts carry on a longer text."""
    words, docs = split_words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), docs, last
    names, word = encoded(words)
    sums = crc32_of(names)
    pair_bucket = np.full(len(word), -1, np.int64)
    inner = np.ones(len(word), bool)
    inner[docs[:-1][docs[:-1] < len(word)]] = False
    here = np.flatnonzero(inner)
    if len(here):
        pairs, which = encoded(pa.array(word[here - 1] * len(names) + word[here]))
        first, second = np.divmod(pairs.to_numpy(zero_copy_only=False), len(names))
        spaced = crc32_of(pa.array([" "]).take(pa.array(np.zeros(len(names), np.int64))), sums)
        hashed = crc32_of(names.take(pa.array(second)), spaced[first])
        pair_bucket[here] = (hashed % np.uint32(buckets)).astype(np.int64)[which]
    if last is not None:
        pair_bucket[0] = int(crc32_of(pa.array([f"{last} {words[0].as_py()}"]))[0]) % buckets
    return (sums % np.uint32(buckets)).astype(np.int64)[word], pair_bucket, docs, words[-1].as_py()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; each task adds up its own before anything is shuffled."""
    bounded_batches(docs.sparkSession, PIECE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            last = None
            for _, texts, carries_on in pieces(batch.column(0)):
                words, pairs, _, last = piece_buckets(texts, buckets, last if carries_on else None)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():  # at most one row per bucket
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    n, all_t, all_s = len(target), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(SCALE * math.log(float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n))))
                     for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """(row: all columns of docs, n_words, n_features, weight)."""
    bounded_batches(docs.sparkSession, PIECE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(text)
            n_words, n_features, total = (np.zeros(len(rows), np.int64) for _ in range(3))
            last = None
            for at, part, carries_on in pieces(texts):
                words, pairs, bounds, last = piece_buckets(part, len(gains), last if carries_on else None)
                paired = pairs >= 0
                gained = gains[words] + np.where(paired, gains[pairs], 0)
                here = slice(at, at + len(part))
                n_words[here] += np.diff(bounds)
                n_features[here] += np.diff(bounds) + np.diff(np.concatenate([[0], np.cumsum(paired)])[bounds])
                total[here] += np.diff(np.concatenate([[0], np.cumsum(gained)])[bounds])
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [rows, *map(pa.array, (n_words, n_features, weight))], ["row", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return rows.mapInArrow(run, schema)


def with_ranks(df: DataFrame, *order) -> DataFrame:
    """Adds ``rank``, 1, 2, 3... in ``order``, which must leave no ties: rows are dealt to sorted ranges, numbered in each,
    and the sizes of the ranges before are added."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = staged(dealt, "importance-ranked")
    bits = 33  # monotonically_increasing_id: partition number above, row number in the partition below
    ranges = dealt.groupBy(F.shiftright("_place", bits).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    sums, total = [], 0
    for row in ranges.orderBy("_range").collect():  # one row per partition of the sort
        sums.append((row["_range"], total))
        total += row["_n"]
    ahead = F.broadcast(df.sparkSession.createDataFrame(sums, "_range bigint, _ahead bigint"))
    return (dealt.withColumn("_range", F.shiftright("_place", bits)).join(ahead, "_range")
            .withColumn("rank", F.col("_ahead") + F.col("_place").bitwiseAND(F.lit((1 << bits) - 1)) + 1)
            .drop("_range", "_place", "_ahead"))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
               share: int = SHARE, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row: all columns of docs but the text, row_no, n_features, weight, score, rank); rank is NULL for what is not drawn.
    Of the texts with ``least_words`` words or more, ``share`` percent are drawn."""
    gains = bucket_gains(bucket_counts(target, target_text, buckets), bucket_counts(docs, text, buckets))
    name = F.coalesce(F.col(f"row.{key}").cast("string"), F.lit(""))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((drawn + 0.5) / F.lit(2.0 ** 32)))).cast("bigint")
    rows = weigh(docs, gains, text)
    kept = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields if f.name != text]
    rows = staged(rows.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("row_no"), "n_words",
                              "n_features", "weight", (F.col("weight") + noise).alias("score")), "importance-scored")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * share // 100
    ranked = with_ranks(able, F.desc("score"), F.col(f"row.{key}").asc_nulls_last(), F.col("row_no"))
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).unionByName(rest).drop("n_words")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **choices) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns."""
    numbered = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_at")),
                      "importance-rows")
    narrow = numbered.select("row_at", F.col(f"row.{key}").alias("key"), F.col(f"row.{text}").alias("text"))
    drawn = importance(narrow, target, "key", **choices).where("rank is not null").select(F.col("row.row_at").alias("row_at"))
    return numbered.join(drawn, "row_at", "left_semi").select("row.*")
