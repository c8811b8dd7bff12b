"""What the operators share: staging between steps, bounded bit filters and the word definition."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.session import scratch, tune

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bitmap row covers so many bits (Spark's bitmap functions fix it).
ROW_BITS = 15


def share_code(spark: SparkSession) -> None:
    """Python workers find this package where the driver does; a cluster without a shared installation ships it with
    ``--py-files``."""
    root, known = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lost executor repeats tasks of the next step only, and a
    join over the result has plain shuffles that adaptive execution can split where a key is hot."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most_bytes: int = 16 << 20) -> None:
    """Rows go to Python in batches of bounded size, as texts can be long: of so many bytes, not only so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The keys of a frame as a set of ``2**bits`` bits, 4 KB a row: never larger than ``2**bits / 8`` bytes whatever
    the number of keys, so it may be broadcast.  A key tests positive when another one shares its bit; users of the
    filter must stay right then.  Keys are dealt by bitmap row first, 8 bytes each: partial bitmaps of every task would
    be 4 KB each instead."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (keys.select(place.alias("_place")).withColumn("_bit_row", F.shiftright("_place", ROW_BITS))
            .repartition("_bit_row").groupBy("_bit_row")
            .agg(F.bitmap_construct_agg(F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("_bit_set")))


def in_filter(df: DataFrame, key: Column, found: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean column: may ``key`` be in the filter?  No shuffle of ``df``."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    inside = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bit_set", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = F.pmod(F.floor(byte / F.pow(F.lit(2), inside.bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return (df.withColumn("_place", place).withColumn("_bit_row", F.shiftright("_place", ROW_BITS))
            .join(F.broadcast(found), "_bit_row", "left")
            .withColumn(flag, F.coalesce(set_bit, F.lit(False)))
            .drop("_place", "_bit_row", "_bit_set"))
