"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when identical after lower-casing A-Z; NULL counts as empty.  Each level hashes only rows whose group
at the level before has two members or more, so the content of a text is hashed whole only where length and beginning
are shared.  Which groups are shared travels as a bit filter of fixed size, broadcast and tested inside the scan: texts
are never shuffled to find out, and a false positive costs one hash and nothing else.  Groups of the last level are
aggregates (largest id, count), folded in the map tasks: a group that holds a third of all rows is one row per task.

Cases: empty and NULL texts form one group; rows that repeat id and text are copies of each other, exactly one row of a
group is kept; NULL ids rank below all others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import ascii_lower, bit_filter, in_filter, staged

PREFIX_CHARS = 256
LENGTH_BITS = 20
GROUP_BITS = 26


def _full_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(text), 256)


def refine(docs: DataFrame, text: str = "text", prefix: int = PREFIX_CHARS, length_bits: int = LENGTH_BITS,
           group_bits: int = GROUP_BITS) -> DataFrame:
    """(row: all columns, _len, _full): ``_full`` is the hash of the whole text where length and beginning are shared
    with another row, else NULL: such a text has no copy."""
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("_len", F.octet_length(whole))
    shared = rows.groupBy("_len").count().where("count > 1")
    rows = in_filter(rows, F.col("_len"), bit_filter(shared, "_len", length_bits), length_bits, "_same_length")
    rows = rows.withColumn("_start", F.when(F.col("_same_length"), F.xxhash64(
        "_len", ascii_lower(F.left(whole, F.lit(prefix))))))
    shared = rows.where("_start is not null").groupBy("_start").count().where("count > 1")
    rows = in_filter(rows, F.col("_start"), bit_filter(shared, "_start", group_bits), group_bits, "_same_start")
    return rows.select("row", "_len", F.when(
        F.col("_same_length") & F.col("_same_start"), _full_hash(whole)).alias("_full"))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.  The row with the largest key stays.
    ``text_sha256`` is filled where refinement reached it, or for all rows with ``digests`` (the digest of a text that
    no group needs is then computed as well)."""
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    digest = F.coalesce("_full", _full_hash(whole)) if digests else F.col("_full")
    rows = staged(refine(docs, text).select(
        F.col(f"row.{key}").alias("key"), F.monotonically_increasing_id().alias("row_no"), "_full",
        digest.alias("digest")), "exact-dedup-rows")
    groups = staged(rows.where("_full is not null").groupBy("_full").agg(
        F.max(F.struct("key", "row_no")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "exact-dedup-groups")
    # texts without a copy are most of the table: as NULL keys they would meet in one task
    spread = rows.withColumn("_group", F.coalesce("_full", F.concat(F.lit("-"), F.col("row_no"))))
    joined = spread.join(groups, F.col("_group") == groups["_full"], "left").drop(groups["_full"])
    alone = F.col("best").isNull()
    return joined.select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row_no") == F.col("row_no"))).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``.  Rows without a copy pass without a shuffle; of the others each
    map task keeps one per group before anything is shuffled."""
    rows = refine(docs, text)
    alone = rows.where("_full is null").select("row.*")
    best = rows.where("_full is not null").groupBy("_full").agg(
        F.max_by("row", F.struct(f"row.{key}")).alias("row")).select("row.*")
    return alone.unionByName(best)
