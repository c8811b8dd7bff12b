"""Mix sources to target weights: hash-random order inside each source, distributed prefix sums, exact cut.

Every row gets a random key, the MD5 of seed and id, so reruns agree.  The keys of a source are cut into ranges of about
``RANGE_ROWS`` rows; ranges are sorted and summed in parallel, and a prefix sum over range totals places each of them, so
a source that holds a third of all rows is spread over as many tasks as it has ranges.  A source's budget is its whole
number of epochs plus a rest; the rows whose prefix sum lies within the rest are taken once more.

Only the table of sources (one row each) is ordered in a single task: a rank over sources is what the weights ask for.

``mix_rows`` mixes whole rows.  Its order is the random key, then a hash of the row, and its ranges are cut by both, so rows
that share an id (or have none) are spread and cut one by one; rows equal in every column are one entry with a count.

Cases: NULL or empty texts have size 0 and take nothing; NULL source is a source, ranked last; a source without words has
target 0; rows that repeat an id lie side by side in the order and are cut one by one, rows without id lie anywhere in
``mix_rows``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import staged, word_count

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
RANGE_ROWS = 5_000
SEED = "mix"


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size, source_rows).  Sources in ascending order of size per
    weight: one is capped while its share of what is left exceeds ``most`` times its size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sources.withColumn("source_no", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                                                 (F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("bigint"))
              .withColumn("cap", F.col("source_size") * most))
    everything = Window.partitionBy()
    before = (Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = (ranked.withColumn("total", F.sum("source_size").over(everything))
              .withColumn("all_weight", F.sum("weight").over(everything))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("capped", F.col("weight") * F.col("left") > F.col("cap") * F.col("left_weight")))
    ranked = (ranked.withColumn("open", F.col("total") - F.coalesce(
                  F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
              .withColumn("open_weight", F.coalesce(
                  F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(1))))
    share = (F.col("weight") * F.col("open")).cast("double") / F.col("open_weight").cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return ranked.select("source", "source_no", "source_size", "source_rows", "weight", target.alias("target"))


def budgets(ranked: DataFrame) -> DataFrame:
    """Adds the target in whole words as epochs and a rest."""
    budget = F.floor("target").cast("bigint")
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    return (ranked.withColumn("epochs", epochs)
            .withColumn("rest", F.when(some, budget - F.col("epochs") * F.col("source_size")).otherwise(0)))


def _key(key: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def prefix_sums(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, source_no, order_key, size, start, and the source's source, source_size, target, epochs, rest): ``start``
    is the number of words before the row in its source's random order."""
    rows = staged(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias(
        "size"), _key(key, seed).alias("order_key")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = staged(budgets(targets(sources)), "mix-sources")
    place = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    ranges = F.ceil(F.col("source_rows") / range_rows)
    placed = (rows.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source")))
              .drop("_source").withColumn("range_no", F.floor(place * ranges)))
    totals = placed.groupBy("source_no", "range_no").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "range_no", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias(
        "range_start"))
    inside = (Window.partitionBy("source_no", "range_no").orderBy("order_key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (summed.join(totals, ["source_no", "range_no"])
            .withColumn("start", F.col("range_start") + F.col("in_range"))
            .select(F.col("id").alias(key), "source", "source_no", "order_key", "size", "start", "source_size", "target",
                    "epochs", "rest"))


def mix_words(docs: DataFrame, **columns) -> DataFrame:
    """Words the mix takes of each row, cut at the exact budget: the row on the border gives its first words only."""
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    return prefix_sums(docs, **columns).withColumn("taken", F.col("epochs") * F.col("size") + part)


def _row_order(docs: DataFrame, key: str, seed: str) -> Column:
    """(random key, hash of the whole row): equal for rows that are equal in every column only."""
    content = F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(seed), *docs.columns).alias("b"))
    drawn = F.when(F.col(key).isNull(), F.md5(F.concat_ws(":", F.lit(seed), content["a"], content["b"]))).otherwise(_key(key, seed))
    return F.struct(drawn.alias("key"), content.alias("content"))


def entry_sums(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(source, source_size, target, epochs, rest, place, size, n, start) of distinct rows: ``n`` equal rows of ``size`` words each,
    ``start`` words of the source before them in its random order."""
    entries = docs.select(F.col(source).alias("source"), _row_order(docs, key, seed).alias("place"), word_count(F.col(text)).alias(
        "size")).groupBy("source", "place", "size").agg(F.count(F.lit(1)).alias("n"))
    entries = staged(entries, "mix-entries")
    sources = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    sources = staged(budgets(targets(sources)), "mix-sources")
    placed = entries.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    order = ["source_no", "place"]
    placed = staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()).withColumn("range_no", F.shiftright("at", 33)), "mix-ranges")
    words = F.col("size") * F.col("n")
    totals = placed.groupBy("source_no", "range_no").agg(F.sum(words).alias("range_size"))
    ahead = Window.partitionBy("source_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "range_no", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source_no", "range_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("in_range", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(totals, ["source_no", "range_no"])
            .withColumn("start", F.col("range_start") + F.col("in_range"))
            .select("source", "source_size", "target", "epochs", "rest", "place", "size", "n", "start"))


def mix_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             seed: str = SEED) -> DataFrame:
    """The mix itself: each row once per epoch, and once more when it lies within the rest (the row on the border when
    at least half of it does).  Texts stay whole.  The cut is one place per source, so rows are judged in the scan
    against the table of sources and texts are not shuffled; of equal rows on the border, one is taken as often as needed."""
    room = 2 * (F.col("rest") - F.col("start")) - F.col("size")
    extra = F.when(room < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(
        F.least(F.col("n"), F.floor(room / (2 * F.greatest("size", F.lit(1)))) + 1))
    cuts = entry_sums(docs, key, text, source, seed).withColumn("extra", extra).groupBy(
        F.col("source").alias("cut_source"), "epochs").agg(F.max(F.when(F.col("extra") > 0, F.struct(
            "place", "extra", "n"))).alias("last"))
    cuts = staged(cuts, "mix-cuts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("cut_for"), _row_order(docs, key, seed).alias("place"))
    rows = rows.join(cuts, F.col("cut_for").eqNullSafe(F.col("cut_source")))
    partly = F.coalesce((F.col("place") == F.col("last.place")) & (F.col("last.extra") < F.col("last.n")), F.lit(False))
    whole = rows.where(~partly).withColumn("copies", F.col("epochs") + F.when(F.col("place") <= F.col("last.place"), 1).otherwise(0))
    border = rows.where(partly).groupBy("cut_for").agg(F.any_value("row").alias("row"), F.max(
        F.col("epochs") * F.col("last.n") + F.col("last.extra")).alias("copies"))
    taken = whole.select("row", "copies").unionByName(border.select("row", "copies")).where("copies > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
