"""Which devices have readings on which date, kept beside the reading table.

The newest reading of each device needs the newest date of each device only. The index
tells that date without reading readings: for every piece of the table it holds the
devices in it, exactly. A piece never changes, so an index is brought up to date by reading
the ``device_id`` of the pieces which are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.operators.latest import latest_reading
from voltfleet.sources.manifest import Piece, Table, Version
from voltfleet.sources.tables import readings_table

_SCHEMA = "of string, device_id bigint, day date"


def index_table(spark: SparkSession, path: str) -> Table:
    """Rows ``of, device_id, day`` for the pieces indexed so far, named by their folder."""
    return Table(spark, f"{path}/_devices", _SCHEMA)


def _dated(pieces: tuple[Piece, ...]) -> list[Piece]:
    return [p for p in pieces if p.date is not None]


def refresh(spark: SparkSession, path: str, version: Version) -> Version:
    """Index the pieces of a version which are not yet; the version of the index to read.

    The batch number is the version's, so that a call run again adds nothing.
    """
    table, index = readings_table(spark, path), index_table(spark, path)
    now = index.version()
    if now.writers.get("index", -1) >= version.number:
        return now
    known = {r["of"] for r in index.read(now).select("of").distinct().collect()}
    new = [p for p in _dated(version.pieces) if p.folder not in known]
    if new:
        # As written, before removals, which are dealt with on reading.
        rows = table.rows(Version(version.number, tuple(new)), new, "piece")
        pairs = rows.select("piece", "device_id", F.col("log_date").alias("day")).distinct()
        folder = F.concat(F.lit("piece="), "piece", F.lit("/log_date="), F.col("day").cast("string"))
        parts = pairs.select(folder.alias("of"), "device_id", "day")
        index.append(parts, "index", version.number)
    return index.version()


def newest_days(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """``device_id, day``: the newest date on which each device has a reading."""
    table, index = readings_table(spark, path), index_table(spark, path)
    indexed = index.read(refresh(spark, path, version))
    # What a removal may have emptied is looked up in the readings that are left.
    touched = [p for p in _dated(version.pieces) if version.removals_of(p)]
    whole = [p.folder for p in _dated(version.pieces) if p not in set(touched)]
    live = spark.createDataFrame([(f,) for f in whole], "of string")
    pairs = indexed.join(live, "of", "left_semi").select("device_id", "day")
    if touched:
        left = table.rows(version, touched).select("device_id", F.col("log_date").alias("day"))
        pairs = pairs.unionByName(left)
    return pairs.groupBy("device_id").agg(F.max("day").alias("day"))


def latest_by_device(spark: SparkSession, path: str) -> DataFrame:
    """The newest reading of each device, reading only the dates on which one stands.

    The dates are brought to the driver, of which a table has a few thousand. Devices that
    have been silent for long are found on their last date.
    """
    table = readings_table(spark, path)
    version = table.version()
    days = newest_days(spark, path, version)
    needed = {str(r["day"]) for r in days.select("day").distinct().collect()}
    rows = table.read(version, dates=lambda day: day in needed)
    same = F.col("device_id").eqNullSafe(F.col("d")) & (F.col("log_date") == F.col("day"))
    wanted = days.withColumnRenamed("device_id", "d")
    return latest_reading(rows.join(wanted, same, "left_semi"), ["device_id"])
