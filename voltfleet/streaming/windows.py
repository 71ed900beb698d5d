"""Hours and last-day statistics as readings come in.

Each micro-batch writes the partial aggregates of its hours, and reading the table puts
them together. There is no watermark: a reading counts in its hour however late it comes,
and a device whose clock is ahead cuts nobody off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltfleet.plans.hourly import (
    PARTIALS,
    hourly_table,
    merged_partials,
    stats_of_partials,
)
from voltfleet.schema import READINGS
from voltfleet.sources.manifest import FAN_OUT, Table
from voltfleet.streaming.folders import key_schema, write_table

_COUNTS = ("n", "count_")
_STRETCH = 24 * 28  # hours that one window partition covers


def _schema(keys: Sequence[str]) -> str:
    parts = (f"{p} {'bigint' if p.startswith(_COUNTS) else 'double'}" for p in PARTIALS)
    return key_schema(keys, READINGS) + ", ".join(["ts timestamp_ntz", *parts, "log_date date"])


def merged_hours(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and hour from parts of hours."""
    whole = parts.groupBy(*keys, "ts", "log_date").agg(*merged_partials())
    return whole.select(*keys, "ts", *PARTIALS, "log_date")


def hours_of(
    spark: SparkSession, path: str, keys: Sequence[str] = (), fan_out: int = FAN_OUT
) -> Table:
    """The table of the parts of hours; merged pieces hold whole sums."""
    return Table(
        spark, path, _schema(keys), lambda parts: merged_hours(parts, keys), fan_out=fan_out
    )


def write_hours(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    keys: Sequence[str] = (),
    fan_out: int = FAN_OUT,
) -> StreamingQuery:
    """Write readings as parts of the hourly table."""
    return write_table(
        stream,
        lambda spark: hours_of(spark, path, keys, fan_out),
        checkpoint,
        lambda rows: hourly_table(rows, keys),
        trigger or {"processingTime": "300 seconds"},
    )


def read_hours(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The hourly table so far, the current hour included; no rows before the first batch."""
    return merged_hours(hours_of(spark, path, keys).read(), keys)


def stats_of_hours(hours: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last-day statistics at each full hour that has readings in the 24 hours before.

    Hours go by stretches of days, each with the day before it, so that a long history is
    spread even without keys. Every hour makes the window ends up to the next hour that has
    readings, so that each end is made once; an end then folds the 24 hours before it by a
    range of hour numbers.
    """
    nth = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    known = hours.where(F.col("ts").isNotNull()).select(*keys, nth.alias("hour"), *PARTIALS)
    stretch = F.floor(F.col("hour") / _STRETCH)
    spread = known.withColumn("stretch", stretch).unionByName(
        known.where(F.pmod("hour", F.lit(_STRETCH)) >= _STRETCH - 24).withColumn(
            "stretch", stretch + 1
        )
    )
    in_stretch = Window.partitionBy(*keys, "stretch").orderBy("hour")
    start = F.col("stretch") * _STRETCH
    following = F.coalesce(F.lead("hour").over(in_stretch), start + _STRETCH)
    ends = (
        spread.select(
            *keys,
            "stretch",
            F.greatest(F.col("hour") + 1, start + 1).alias("first"),
            F.least(F.col("hour") + 24, following, start + _STRETCH).alias("last"),
        )
        .where("first <= last")
        .select(*keys, "stretch", F.explode(F.sequence("first", "last")).alias("hour"))
    )
    day = in_stretch.rangeBetween(-24, -1)
    folded = spread.withColumn("is_end", F.lit(False)).unionByName(
        ends.withColumn("is_end", F.lit(True)), allowMissingColumns=True
    )
    folded = folded.select(
        *keys, "hour", "is_end", *[f.over(day).alias(c) for c, f in _folds().items()]
    )
    at = F.timestamp_seconds(F.col("hour") * 3600).cast("timestamp_ntz")
    days = folded.where("is_end").withColumns(
        {"window_end": at, "window_start": at - F.expr("INTERVAL 24 HOURS")}
    )
    return stats_of_partials(days, *keys, "window_start", "window_end")


def _folds() -> dict[str, Column]:
    """The aggregates which put partials together, by name."""
    by_name = {"min": F.min, "max": F.max}
    return {name: by_name.get(name.split("_")[0], F.sum)(name) for name in PARTIALS}
