"""The newest reading of each device, kept current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltfleet.operators.latest import SHOWN, latest_reading, newest
from voltfleet.schema import READINGS
from voltfleet.sources.manifest import FAN_OUT, Table
from voltfleet.streaming.folders import key_schema, write_table

_SHOWN = "ts timestamp_ntz, seq bigint, " + ", ".join(f"{m} double" for m in SHOWN.values())


def newest_rows(rows: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """The newest reading per key, as a row that can be compared again."""
    picked = rows.where(F.col("ts").isNotNull()).groupBy(*keys).agg(newest().alias("r"))
    return picked.select(*keys, "r.ts", "r.seq", *[f"r.{name}" for name in SHOWN.values()])


def latest_table(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = ("device_id",),
    fan_out: int = FAN_OUT,
) -> Table:
    """The newest readings of each batch; merged pieces keep the newest of all."""
    schema = key_schema(keys, READINGS) + _SHOWN
    return Table(spark, path, schema, lambda rows: newest_rows(rows, keys), fan_out=fan_out)


def write_latest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    keys: Sequence[str] = ("device_id",),
) -> StreamingQuery:
    """Write the newest reading of each key which a batch has; other devices write nothing.

    An older reading in a later batch changes nothing, as the newest of all counts.
    """
    return write_table(
        stream,
        lambda spark: latest_table(spark, path, keys),
        checkpoint,
        lambda rows: newest_rows(rows, keys),
        trigger or {"processingTime": "60 seconds"},
    )


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str] = ("device_id",)
) -> DataFrame:
    """The newest reading of each key so far; no rows before the first batch."""
    return latest_reading(latest_table(spark, path, keys).read(), keys)
