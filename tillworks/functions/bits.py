"""Sets of 64-bit hashes as bitmaps of fixed size, for tests that may err on one side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a set: what ``bitmap_construct_agg`` fills, 4 KB.
ROW = 1 << 15
#: Bits of a set: 8 MB.  Beyond some 10^8 hashes every test answers yes.
BITS = 1 << 26


def bit_set(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """The hashes of a column as rows of bits, ``bits / 8`` bytes at most whatever their number: may be broadcast."""
    place = F.pmod(F.col(column), F.lit(bits))
    places = hashes.select(F.floor(place / ROW).alias("bit_row"), F.pmod(place, F.lit(ROW)).alias("bit"))
    # 16 bytes a hash are shuffled; a bitmap of each task would be 4 KB a row and task
    return places.repartition("bit_row").groupBy("bit_row").agg(F.bitmap_construct_agg("bit").alias("bit_rows"))


def maybe_in(df: DataFrame, value: Column, found: DataFrame, flag: str, bits: int = BITS) -> DataFrame:
    """``df`` with a boolean: False where the hash is certainly not in the set.  ``df`` is not shuffled."""
    place = F.pmod(value, F.lit(bits))
    bit = F.pmod(place, F.lit(ROW)).cast("int")
    byte = F.conv(F.hex(F.substring("bit_rows", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    probed = df.withColumn("_bit_row", F.floor(place / ROW))
    return (probed.join(F.broadcast(found), F.col("_bit_row") == F.col("bit_row"), "left")
            .withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bit_row", "bit_row", "bit_rows"))
