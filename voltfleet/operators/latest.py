"""The newest reading, and readings in order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.functions.display import charge_direction, time_left
from voltfleet.operators.periods import Moment, select_period

# Output name and measure of each value shown for the newest reading.
SHOWN = {
    "soc": "socPercent",
    "watts_out": "wattsOut",
    "watts_in": "wattsIn",
    "temp": "temperature",
    "wh_stored": "whStored",
    "time_to_empty_full": "timeToEmptyFull",
}


def newest() -> Column:
    """Aggregate: the whole reading with the highest time, then the highest ``seq``.

    The maximum of a struct compares field by field and is folded within each task
    before the shuffle; the readings are never sorted as a whole.
    """
    return F.max(F.struct("ts", "seq", *SHOWN.values()))


def latest_reading(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The newest reading, of all rows or of each key.

    Rows without a time cannot be newest. With no reading at all the values are 0 and
    the time left is unknown; a NULL in the newest reading stays NULL.
    """
    picked = df.where(F.col("ts").isNotNull()).groupBy(*keys).agg(newest().alias("r"))
    return picked.select(
        *keys, *_values(), time_left(F.col("r.timeToEmptyFull")).alias("time_left")
    )


def _values() -> list[Column]:
    """The time and values shown of a newest reading ``r``."""
    values = {
        out: F.when(F.col("r").isNull(), F.lit(None if name == "timeToEmptyFull" else 0.0))
        .otherwise(F.col(f"r.{name}"))
        .cast("double")
        for out, name in SHOWN.items()
    }
    return [F.col("r.ts").alias("ts"), *[value.alias(out) for out, value in values.items()]]


def newest_day(df: DataFrame) -> DataFrame:
    """The rows of the newest ``log_date``, which hold the newest reading of all.

    On the reading table the newest date comes from the names of its folders, and the
    scan then reads that one folder, however long the history is.
    """
    dates = df.where(F.col("log_date").isNotNull())
    return dates.where(F.col("log_date") == dates.select(F.max("log_date")).scalar())


def current_stats(df: DataFrame, polls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The newest reading with ``connected``, the outcome ``ok`` of the newest poll.

    Without a connection the time left is unknown and the direction neutral. A key with
    polls only has the values of no reading; one with readings only is not connected.
    Readings and polls fold in one aggregation, without a join.
    """
    reading = F.struct("ts", "seq", *SHOWN.values())
    read = df.where(F.col("ts").isNotNull()).select(*keys, reading.alias("r"))
    asked = polls.where(F.col("ts").isNotNull()).select(
        *keys, F.struct("ts", "seq", "ok").alias("p")
    )
    both = read.unionByName(asked, allowMissingColumns=True)
    picked = both.groupBy(*keys).agg(F.max("r").alias("r"), F.max("p").alias("p"))
    connected = F.coalesce(F.col("p.ok"), F.lit(False))
    shown = picked.select(
        *keys,
        *_values(),
        connected.alias("connected"),
        time_left(F.col("r.timeToEmptyFull"), connected).alias("time_left"),
    )
    return charge_direction(shown, "watts_in", "watts_out", "connected")


def ordered_series(
    df: DataFrame,
    period: str,
    date: str | None = None,
    as_of: Moment | None = None,
    mode: str = "calendar",
) -> DataFrame:
    """The readings of a view by ascending time, ready for the chart labels.

    Device and insert order come after the time, so that range partitioning can also
    split readings which share one time.
    """
    return (
        select_period(df, period, date, as_of, mode)
        .select("device_id", "seq", "date_heure", "ts", "wattsOut", "temperature", "wattsIn")
        .orderBy("ts", "device_id", "seq")
    )
