"""Incremental landing: each new file is loaded once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tillworks.config import Config
from tillworks.plans.load import load
from tillworks.schema import RAW_SCHEMA
from tillworks.sources.raw import CSV_OPTIONS, snake_case, with_record_number, with_source_file


def stream_raw(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA).options(**CSV_OPTIONS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return snake_case(with_source_file(reader.csv(path)))


def ingest_incremental(spark: SparkSession, source: str, root: str, checkpoint: str, cfg: Config,
                       files_per_batch: int | None = None) -> None:
    """Load the files that arrived since the last call.  The checkpoint remembers files; a batch that is run again has
    the same run id, overwrites its own folders and does not take its own rows for old ones."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        load(spark, with_record_number(batch), root, replace(cfg, run_id=f"{cfg.run_id}-{batch_id:06d}"),
             source=source, incremental=True)

    query = (stream_raw(spark, source, files_per_batch).writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()


def dedup_stream(df: DataFrame, keys: Sequence[str], event_time: str, watermark: str) -> DataFrame:
    """First row of each key inside the watermark; state older than it is dropped.  NULL keys form a group.  For keys of
    any age use ``ingest_incremental``, which checks the curated table."""
    return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))
