"""Copies of a key: keep the first, list the others, number rows that have no key.

A window per key would put every copy of one key into one task.  These operators aggregate instead: each map task
folds its copies into one row and a count before the shuffle, so a key that holds a third of the table arrives as one
row per map task.  Where copies must be written out again, the counts are cut into chunks that are spread first.

A fold of full rows sorts them, since its states have no fixed width.  Over a stored table (``stored=True``) the keys are
counted first, by their hashes alone: rows whose hash occurs once have no copy and pass as they are, without sort or shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions.bits import bit_set, maybe_in
from tillworks.operators.cleaning import synthetic_id
from tillworks.schema import DEDUP_KEYS

#: Numbers of a repeated row that one task unrolls at a time.
CHUNK = 10_000

#: Bits of the set of curated keys: 32 MB.
KNOWN_BITS = 1 << 28


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str = "copies",
                  stored: bool = False) -> DataFrame:
    """One row per key (NULL keys form a group): the one with the smallest ``order`` values, and the number of rows; among
    equal ones the smallest row, so that a run again gives the same.  Only columns that are read later should come in.
    ``stored`` says that ``df`` reads a written table, so that three scans of it are cheap and see the same rows."""
    if stored:
        again = maybe_in(df, F.xxhash64(*keys), repeated_hashes(df, keys), "_again")
        several = first_per_key(again.where("_again").drop("_again"), keys, order, count)
        alone = again.where("not _again").drop("_again").withColumn(count, F.lit(1).cast("bigint"))
        return several.unionByName(alone)
    rest = [c for c in df.columns if c not in keys]
    # each column once: an order beside the row would be sorted and shuffled a second time.  A column that cannot be
    # compared (a map) needs the order apart
    row = F.struct(*order, *[c for c in rest if c not in order])
    first = F.min(row) if comparable(df.select(*rest).schema) else F.min_by(row, F.struct(*order))
    folded = df.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias(count))
    return folded.select(*keys, *[F.col("_first")[c].alias(c) for c in rest], count)


def comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(comparable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return comparable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)


def repeated_hashes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes of the keys that occur more than once, as a set of bits.  Keys that share a hash or a bit are taken for
    repeated: they are folded, with a count of one."""
    hashes = df.select(F.xxhash64(*keys).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    return bit_set(hashes.where("n > 1"), "_hash")


def repeat_rows(df: DataFrame, times: str, index: str, chunk: int = CHUNK) -> DataFrame:
    """Each row ``times`` times, numbered from 0.  Its numbers are cut into chunks, the chunks are spread over the tasks and
    unrolled there: a row repeated a billion times is work for all of them."""
    n = F.col(times)
    parts = df.where(n > 0).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / chunk))))
    # a stated number of partitions: adaptive execution would size them by the few bytes that go in, not by the rows that
    # come out
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.repartition(tasks, F.xxhash64(*df.columns, "_part"))
    start = F.col("_part") * chunk
    numbers = F.sequence(start, F.least(start + (chunk - 1), n - 1))
    return spread.withColumn(index, F.explode(numbers)).drop("_part")


def dedup(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: Sequence[str] = ("record_key",),
          stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, duplicates).  A duplicate is listed by its key columns and copy number, one row per copy."""
    folded = first_per_key(df, keys, order, stored=stored)
    extra = folded.where("copies > 1").select(*keys, (F.col("copies") - 1).alias("_extra"))
    return folded.drop("copies"), repeat_rows(extra, "_extra", "copy_no").drop("_extra")


def fold_copies(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, id_column: str = "product_id",
                order: Sequence[str] = ("source_file", "record_key"), stored: bool = False) -> DataFrame:
    """One shuffle for both identities: rows with an id fold on ``keys``; rows without one fold on equal content, since
    each of them will get an id of its own.  ``copies`` counts the folded rows."""
    no_id = F.col(id_column).isNull()
    content = F.when(no_id, F.col("record_key"))
    folded = first_per_key(df.withColumn("_content", content), [*keys, "_content"], order, stored=stored)
    return folded.drop("_content")


def kept_rows(folded: DataFrame, id_column: str = "product_id") -> DataFrame:
    """The surviving rows of ``fold_copies`` with their final id: one per key, and every row that had no id."""
    no_id = F.col(id_column).isNull()
    many = no_id & (F.col("copies") > 1)
    single = folded.where(~many).withColumn("occurrence_no", F.lit(0).cast("bigint"))
    numbered = repeat_rows(folded.where(many), "copies", "occurrence_no")
    filled = F.coalesce(F.col(id_column), synthetic_id(F.col("record_key"), F.col("occurrence_no")))
    return single.unionByName(numbered).withColumn(id_column, filled).drop("copies", "occurrence_no")


def duplicate_keys(folded: DataFrame, keys: Sequence[str] = DEDUP_KEYS, id_column: str = "product_id") -> DataFrame:
    """One row per dropped copy, key columns only."""
    extra = (folded.where(F.col(id_column).isNotNull() & (F.col("copies") > 1))
             .select(*keys, (F.col("copies") - 1).alias("_extra")))
    return repeat_rows(extra, "_extra", "copy_no").drop("_extra", "copy_no")


def duplicates_to_errors(duplicates: DataFrame, cfg, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """``product_id=.., month=.., shop_name=..`` with NULL parts left out."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    return duplicates.select(F.lit("DUPLICATE_RECORD").alias("error_reason"), text.alias("raw_record"),
                             F.lit(cfg.executed_at).cast("timestamp").alias("error_timestamp"))


def touched_months(df: DataFrame) -> list[tuple[int | None, int | None]]:
    """Distinct partitions of a frame; at most one per calendar month, so safe to bring to the driver."""
    return [(r["year"], r["month_num"]) for r in df.select("year", "month_num").distinct().collect()]


def in_months(df: DataFrame, months: Sequence[tuple[int | None, int | None]]) -> DataFrame:
    """Partition filter with literal values, NULL partition included: other folders are not even listed for reading."""
    known = [y * 12 + m for y, m in months if y is not None]
    hit = (F.col("year") * 12 + F.col("month_num")).isin(known) if known else F.lit(False)
    if any(y is None for y, _ in months):
        hit = hit | F.col("year").isNull()
    return df.where(hit)


def new_keys(df: DataFrame, curated: DataFrame, keys: Sequence[str] = DEDUP_KEYS, own_run: str | None = None,
             probe: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows whose key is not in the curated table yet; NULLs compare equal.  Only touched months of the curated table
    are read, and rows written by this same run do not count, so a retry finds the same new rows.  ``probe`` replaces a
    key column of ``df`` by an expression."""
    return by_key(df, old_rows(curated, touched_months(df), own_run), "left_anti", keys, probe)


def by_key(df: DataFrame, other: DataFrame, how: str, keys: Sequence[str] = DEDUP_KEYS,
           probe: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` whose key is (``left_semi``) or is not (``left_anti``) among those of ``other``; NULLs compare equal."""
    named = other.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & (probe or {}).get(k, F.col(k)).eqNullSafe(F.col(f"_old_{k}"))
    return df.join(named, same, how)


def old_rows(curated: DataFrame, months: Sequence[tuple[int | None, int | None]], own_run: str | None) -> DataFrame:
    """Rows of some months of the curated table that another run wrote."""
    old = in_months(curated, months)
    return old.where(F.col("run_id") != own_run) if own_run is not None and "run_id" in curated.columns else old


def unknown_rows(df: DataFrame, old: DataFrame, store: Callable[[DataFrame, str], DataFrame],
                 keys: Sequence[str] = DEDUP_KEYS, probe: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` (a written table) whose key is not among the ``old`` rows; NULLs compare equal.  Rows whose key is certainly
    new pass by a set of bits; of the others only the keys are shuffled to meet the old ones.  Full rows are shuffled where their key
    has turned out new, which the bits did not tell.  ``store(frame, name)`` writes a frame and reads it back."""
    key = {k: (probe or {}).get(k, F.col(k)) for k in keys}
    value = F.xxhash64(*key.values())

    def hashes(rows: DataFrame) -> DataFrame:
        return bit_set(rows.select(F.xxhash64(*keys).alias("_hash")), "_hash", KNOWN_BITS)

    flagged = maybe_in(df, value, store(hashes(old), "known_bits"), "_known", KNOWN_BITS)
    asked = flagged.where("_known").drop("_known")
    fresh = store(by_key(asked.select(*[c.alias(k) for k, c in key.items()]), old, "left_anti", keys), "new_keys")
    close = maybe_in(asked, value, hashes(fresh), "_fresh", KNOWN_BITS).where("_fresh").drop("_fresh")
    new = store(by_key(close, fresh, "left_semi", keys, probe), "new")
    return flagged.where("not _known").drop("_known").unionByName(new)


def first_id(id_column: str = "product_id") -> Column:
    """The id of a row, or the id the first of its copies would get."""
    return F.coalesce(F.col(id_column), synthetic_id(F.col("record_key"), F.lit(0)))
