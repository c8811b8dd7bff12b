"""Table writers and registry.

Every sink ends in a ``run_id=`` folder and overwrites only that folder, so a retried run replaces its own rows and
never anybody else's.  The 21-column curated contract is the table without ``run_id``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tillworks.config import Config
from tillworks.schema import CURATED, ERRORS, LINEAGE, PARTITIONS, QUALITY_REPORT, QUARANTINE, RAW_COLUMNS
from tillworks.session import open_writers, passing_shuffles
from tillworks.sources import folders

RUN = "run_id"


@dataclass(frozen=True)
class Table:
    name: str
    folder: str
    schema: T.StructType
    partitions: tuple[str, ...] = (RUN,)
    file_format: str = "parquet"
    options: Mapping[str, str] | None = None
    comment: str = ""


def _with_run(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])


TABLES = {t.name: t for t in [
    Table("raw_sales", "landing", T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS.values()]),
          (), "csv", {"header": "true", "quote": '"', "escape": '"', "recursiveFileLookup": "true"},
          "landing files, all text"),
    Table("curated_sales", "curated", _with_run(CURATED), (*PARTITIONS, RUN), comment="scored and de-duplicated rows"),
    Table("error_sales", "error", _with_run(ERRORS), comment="malformed rows and duplicates"),
    Table("quarantine_sales", "quarantine", _with_run(QUARANTINE), comment="low scores and anomalies"),
    Table("data_quality_metrics", "quality-reports", _with_run(QUALITY_REPORT), (RUN,), "json",
          comment="one report per run"),
    Table("transformation_lineage", "lineage", _with_run(LINEAGE), comment="rows in and out per run"),
]}


def folder_of(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{TABLES[table].folder}"


def write_parts(df: DataFrame, path: str, partitions: Sequence[str], file_format: str = "parquet") -> None:
    with passing_shuffles(df.sparkSession):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partitions).format(file_format).save(path))


def by_month(df: DataFrame) -> DataFrame:
    """Rows spread by month, so a task does not open one file per month; the rebalance hint lets adaptive execution split a
    month that is too large for one task."""
    return df.hint("rebalance", *[F.col(c) for c in PARTITIONS])


def write_curated(df: DataFrame, root: str, cfg: Config, spread: bool = False) -> None:
    """``year/month_num/run_id`` leaves.  ``spread`` says that ``by_month`` already dealt the rows out, before columns were
    added that need not be shuffled."""
    spread = (df if spread else by_month(df)).withColumn(RUN, F.lit(cfg.run_id))
    with open_writers(df.sparkSession):
        write_parts(spread, folder_of(root, "curated_sales"), [*PARTITIONS, RUN])


def write_errors(df: DataFrame, root: str, cfg: Config) -> None:
    write_parts(df.withColumn(RUN, F.lit(cfg.run_id)), folder_of(root, "error_sales"), [RUN])


def write_quarantine(df: DataFrame, root: str, cfg: Config) -> None:
    write_parts(df.withColumn(RUN, F.lit(cfg.run_id)), folder_of(root, "quarantine_sales"), [RUN])


def write_quality_report(df: DataFrame, root: str, cfg: Config) -> None:
    """One JSON object per line."""
    write_parts(df.withColumn(RUN, F.lit(cfg.run_id)), folder_of(root, "data_quality_metrics"), [RUN], "json")


def write_lineage(df: DataFrame, root: str, cfg: Config) -> None:
    write_parts(df.withColumn(RUN, F.lit(cfg.run_id)), folder_of(root, "transformation_lineage"), [RUN])


def write_events(events: DataFrame, root: str, cfg: Config, table: str) -> None:
    """Record-level change events of a run, by table.  A repeated run replaces its own part, so an event is there once."""
    write_parts(events.drop("table_name").withColumns({"table_name": F.lit(table), RUN: F.lit(cfg.run_id)}),
                f"{root.rstrip('/')}/change-events", ["table_name", RUN])


def read_events(spark: SparkSession, root: str, table: str | None = None, run: str | None = None) -> DataFrame:
    """Change events of all tables and runs, or of one: other folders are not read."""
    events = spark.read.parquet(f"{root.rstrip('/')}/change-events")
    events = events if table is None else events.where(F.col("table_name") == table)
    return events if run is None else events.where(F.col(RUN) == run)


def write_log(df: DataFrame, root: str, folder: str, cfg: Config) -> None:
    """JSON lines of a run; a repeated run replaces its own."""
    write_parts(df.withColumn(RUN, F.lit(cfg.run_id)), f"{root.rstrip('/')}/{folder}", [RUN], "json")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    table = TABLES[name]
    return spark.read.schema(table.schema).options(**(table.options or {})).format(table.file_format).load(
        folder_of(root, name))


def partitions(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The partition values of a folder, once for each file: a listing only, no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return listed.drop("path", "modificationTime", "length", "content")


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    return folders.exists(spark, folder_of(root, name))


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of finished runs in a table, empty before the first load."""
    if not table_exists(spark, root, name) or not table_exists(spark, root, "transformation_lineage"):
        return spark.createDataFrame([], TABLES[name].schema)
    return published(read_table(spark, root, name), read_table(spark, root, "transformation_lineage"))


def read_curated(spark: SparkSession, root: str) -> DataFrame:
    """The curated table as readers see it: rows of finished runs."""
    return read_published(spark, root, "curated_sales")


def published(df: DataFrame, lineage: DataFrame) -> DataFrame:
    """Rows of finished runs: the lineage row is written last."""
    done = lineage.select(F.col("job_run_id").alias("_done")).distinct()
    return df.join(done, F.col(RUN) == F.col("_done"), "left_semi")


def register_tables(spark: SparkSession, root: str, database: str = "default") -> list[str]:
    """Catalog entries over the folders, with types, partitions and comments."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root.rstrip('/')}/database'")
    names = []
    for table in TABLES.values():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        parts = f"PARTITIONED BY ({', '.join(table.partitions)})" if table.partitions else ""
        options = ", ".join(f"'{k}' '{v.replace(chr(39), chr(92) + chr(39))}'"
                            for k, v in (table.options or {}).items())
        name = f"`{database}`.`{table.name}`"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {table.file_format} "
                  + (f"OPTIONS ({options}) " if options else "") + parts
                  + f" LOCATION '{folder_of(root, table.name)}' COMMENT '{table.comment}'")
        if table.partitions and table_exists(spark, root, table.name):
            spark.catalog.recoverPartitions(f"{database}.{table.name}")
        names.append(f"{database}.{table.name}")
    return names


def schema_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows: position, name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def schema_diff(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Columns missing, added or of another type between two schema frames."""
    a = declared.select("column_name", F.col("data_type").alias("declared_type"))
    b = found.select("column_name", F.col("data_type").alias("found_type"))
    change = (F.when(F.col("found_type").isNull(), "missing").when(F.col("declared_type").isNull(), "added")
              .when(F.col("declared_type") != F.col("found_type"), "type_changed"))
    return a.join(b, "column_name", "full_outer").withColumn("change", change).where("change is not null")


def discover(spark: SparkSession, path: str, declared: T.StructType, policy: str = "LOG",
             table: str | None = None) -> DataFrame:
    """Compare what lies in a folder with the declared schema.  LOG only reports; UPDATE also adds new columns to the
    catalog table and registers new partitions."""
    found = spark.read.option("mergeSchema", True).parquet(path).schema
    diff = schema_diff(schema_frame(spark, declared), schema_frame(spark, found))
    if policy == "UPDATE" and table is not None:
        known = {f.name for f in declared.fields}
        new = [f for f in found.fields if f.name not in known]
        if new:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
        try:
            spark.catalog.recoverPartitions(table)
        except AnalysisException:  # not partitioned: nothing to register
            pass
    return diff


def compact(spark: SparkSession, source: str, target: str, partitions_by: Sequence[str] = PARTITIONS,
            target_mb: int = 192, max_records: int = 10_000_000) -> None:
    """Rewrite a partitioned folder into files of about ``target_mb`` of Parquet.  The listing tells the bytes of each
    partition and so its number of files; rows are dealt to them by hash.  The result goes to a new folder, since a folder
    cannot be overwritten while it is read; ``compact_live`` publishes it."""
    keys = list(partitions_by)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    sizes = listed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.ceil(F.sum("length") / (target_mb << 20)).alias("_files"))
    rows = spark.read.parquet(source)
    names = rows.columns
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    dealt = rows.join(sizes, same).withColumn("_file", F.pmod(F.xxhash64(*names), F.col("_files")))
    (dealt.repartition(*keys, "_file").select(*names).write.partitionBy(*keys)
     .option("maxRecordsPerFile", max_records).parquet(target))


LIVE = "_live"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version bigint, folder string").json(f"{path}/{LIVE}")


def live_folder(spark: SparkSession, path: str) -> str:
    """The folder that readers of a versioned table read: the one its newest manifest names."""
    newest = _versions(spark, path).orderBy(F.desc("version"), "folder").first()
    return f"{path}/{newest['folder']}"


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """A versioned table as it is now.  The frame stays on that version while newer ones are published."""
    return spark.read.parquet(live_folder(spark, path))


def publish(spark: SparkSession, path: str, folder: str) -> int:
    """Make ``folder`` (below ``path``) the version that readers see.  A manifest is one file that the commit of the write puts in
    place by one rename: readers find the old manifest or the new one."""
    before = _versions(spark, path).agg(F.max("version")).first()[0] if folders.exists(spark, f"{path}/{LIVE}") else None
    version = (before or 0) + 1
    spark.createDataFrame([(version, folder)], "version bigint, folder string").coalesce(1).write.mode("errorifexists").json(
        f"{path}/{LIVE}/n={version}")
    return version


def compact_live(spark: SparkSession, path: str, partitions_by: Sequence[str] = PARTITIONS, target_mb: int = 192) -> str:
    """Compact the live version of a table into a new folder and publish that; the old folder stays for its readers."""
    folder = f"v-{uuid.uuid4().hex}"
    compact(spark, live_folder(spark, path), f"{path}/{folder}", partitions_by, target_mb)
    publish(spark, path, folder)
    return folder


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the folders of all but the newest versions, once no reader can be on them; the names removed."""
    listed = [r["folder"] for r in _versions(spark, path).orderBy(F.desc("version")).collect()]  # one per compaction
    old = [f for f in dict.fromkeys(listed[keep:]) if f not in listed[:keep] and folders.exists(spark, f"{path}/{f}")]
    for folder in old:
        folders.delete(spark, f"{path}/{folder}")
    return old


def ctas(df: DataFrame, target: str, partitions: Sequence[str] = PARTITIONS, drop: Sequence[str] = (),
         path: str | None = None) -> None:
    """Rebuild a table without some columns under a new name."""
    writer = df.drop(*drop).write.format("parquet").option("compression", "snappy").mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(target)


def swap(spark: SparkSession, live: str, replacement: str, backup: str) -> None:
    """Put a rebuilt table in place of the live one and keep the old one."""
    spark.sql(f"ALTER TABLE {live} RENAME TO {backup}")
    spark.sql(f"ALTER TABLE {replacement} RENAME TO {live}")
