"""Retention carried out: dated folders are archived and expire.

What a run is going to do is logged first, then done, then logged as done.  Each action can be repeated: a run that was cut off
leaves planned entries without a done one, and the next run, whatever its id, carries them out with its own.  Readers of a zone
see a folder whole or not at all, as it is renamed or removed in one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.operators.state import retention_plan
from tillworks.sources import folders, tables

LOG = "retention-log"
ARCHIVE = "_archive"
ENTRY = "zone string, place string, folder string, landing_date date, action string"


def retention_log(spark: SparkSession, root: str) -> DataFrame:
    """zone, place (live or archive), folder, landing_date, action, run_id, state (planned or done)."""
    path = f"{root.rstrip('/')}/{LOG}"
    schema = f"{ENTRY}, run_id string, state string"
    return spark.read.schema(schema).json(path) if folders.exists(spark, path) else spark.createDataFrame([], schema)


def unfinished(spark: SparkSession, root: str) -> DataFrame:
    """Planned entries that no run has reported as done."""
    log, entry = retention_log(spark, root), ["zone", "place", "folder", "landing_date", "action"]
    return log.where("state = 'planned'").select(*entry).distinct().join(
        log.where("state = 'done'").select(*entry).distinct(), entry, "left_anti")


def plan(spark: SparkSession, root: str, zone: str, cfg: Config, column: str = "landing_date") -> DataFrame:
    """The actions due in a zone now, on live folders and on archived ones, which expire in turn."""
    root = root.rstrip("/")
    found = [(zone, place, name, day) for place, path in (("live", f"{root}/{zone}"), ("archive", f"{root}/{ARCHIVE}/{zone}"))
             for name, day in folders.dated(spark, path, column)]
    listed = spark.createDataFrame(found, "zone string, place string, folder string, landing_date date")
    return retention_plan(listed, zone, cfg).where(
        (F.col("action") == "expire") | ((F.col("action") == "archive") & (F.col("place") == "live")))


def _act(spark: SparkSession, root: str, zone: str, place: str, folder: str, action: str) -> None:
    path = f"{root}/{zone}/{folder}" if place == "live" else f"{root}/{ARCHIVE}/{zone}/{folder}"
    if action == "expire":
        folders.delete(spark, path)
    else:
        folders.move(spark, path, f"{root}/{ARCHIVE}/{zone}/{folder}")


def carry_out(spark: SparkSession, root: str, zones: list[str], cfg: Config, column: str = "landing_date") -> int:
    """Carry out what is due and what earlier runs left open; the number of actions."""
    root = root.rstrip("/")
    due = unfinished(spark, root)
    for zone in zones:
        due = due.unionByName(plan(spark, root, zone, cfg, column).select(due.columns))
    rows = due.distinct().orderBy("zone", "place", "folder").collect()  # one per dated folder
    if not rows:
        return 0

    def log(state: str) -> None:
        entries = spark.createDataFrame(rows, ENTRY).coalesce(1).withColumns({tables.RUN: F.lit(cfg.run_id), "state": F.lit(state)})
        tables.write_parts(entries, f"{root}/{LOG}", [tables.RUN, "state"], "json")

    log("planned")
    for r in rows:
        _act(spark, root, r["zone"], r["place"], r["folder"], r["action"])
    log("done")
    return len(rows)
