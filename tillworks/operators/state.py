"""Latest state, cache look-up and expiry."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import Config

# Life times in hours (cache) and days (everything else).
CACHE_HOURS = 6
RETENTION_DAYS = {"requests": 90, "raw_archive": 90, "raw_expire": 365, "curated_tier": 180, "error": 30,
                  "quarantine": 30}


def latest_state(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last version of each key (upsert reading of a change table); older versions fold away in the map tasks."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*")


def merged_state(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Like ``latest_state``, but a version that leaves a column NULL keeps the earlier value (partial update)."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])


def with_ttl(df: DataFrame, created: str, hours: int, column: str = "ttl_expiry") -> DataFrame:
    return df.withColumn(column, F.unix_timestamp(created) + hours * 3600)


def expired(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Rows whose expiry second has passed."""
    return df.where(F.col(column) <= F.unix_timestamp(as_of))


def live(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    return df.where(F.col(column) > F.unix_timestamp(as_of))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, as_of: Column, payload: str = "payload",
                 ttl: str = "ttl_expiry") -> DataFrame:
    """Requests with the cached payload where a live entry exists; ``hit`` tells which.  The cache folds to one entry per
    key first, so a key asked for by a third of all requests still joins one row."""
    entries = live(cache, ttl, as_of).groupBy(key).agg(F.max_by(payload, ttl).alias(payload)).where(
        F.col(payload).isNotNull())
    return requests.join(entries, key, "left").withColumn("hit", F.col(payload).isNotNull())


def cache_misses(requests: DataFrame, cache: DataFrame, key: str, as_of: Column, payload: str = "payload",
                 ttl: str = "ttl_expiry") -> DataFrame:
    entries = live(cache, ttl, as_of).where(F.col(payload).isNotNull()).select(key)
    return requests.join(entries, key, "left_anti")


def retention_plan(partitions: DataFrame, zone: str, cfg: Config, date_column: str = "landing_date") -> DataFrame:
    """What to do with each dated folder of a zone: keep, archive (raw, curated) or expire."""
    def older(days: int) -> Column:
        return F.col(date_column) < F.lit(cfg.as_of - timedelta(days=days))

    keep = F.lit("keep")
    action = {
        "raw": F.when(older(RETENTION_DAYS["raw_expire"]), "expire").when(
            older(RETENTION_DAYS["raw_archive"]), "archive").otherwise(keep),
        "curated": F.when(older(RETENTION_DAYS["curated_tier"]), "archive").otherwise(keep),
        "error": F.when(older(RETENTION_DAYS["error"]), "expire").otherwise(keep),
        "quarantine": F.when(older(RETENTION_DAYS["quarantine"]), "expire").otherwise(keep),
    }[zone]
    return partitions.withColumn("action", action)
