"""Averages, extremes and statistics over time buckets.

Buckets are grouped by a DATE and an hour number and labelled after the
aggregation, so each task folds its rows into one entry per bucket before anything
is shuffled: a device or an hour with very many rows costs no more network than
another. With ``keys=[]`` the readings are taken as those of one device.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.functions.timekeys import (
    date_hour_label,
    day_label,
    hour_label,
    month_label,
)
from voltfleet.operators.periods import Moment, check_period, lookback, select_period

_DAY, _HOUR = "_day", "_hour"

EXTREMES = ("min_watts_in", "max_watts_in", "min_watts_out", "max_watts_out")


def bucket_columns(grain: str) -> dict[str, Column]:
    """The grouping columns of a grain."""
    day, hour = F.col("log_date"), F.hour("ts")
    return {
        "hour_of_day": {_HOUR: hour},
        "date_hour": {_DAY: day, _HOUR: hour},
        "day": {_DAY: day},
        "month": {_DAY: F.trunc(day, "MM")},
    }[grain]


def bucket_label(grain: str) -> Column:
    """The label of a bucket, from its grouping columns."""
    return {
        "hour_of_day": lambda: hour_label(F.col(_HOUR)),
        "date_hour": lambda: date_hour_label(F.col(_DAY), F.col(_HOUR)),
        "day": lambda: day_label(F.col(_DAY)),
        "month": lambda: month_label(F.col(_DAY)),
    }[grain]()


def grain_of(period: str, date: str | None) -> str:
    """An hourly view of one date shows hours of the day; a trailing one, hours of a date."""
    check_period(period)
    if period == "hour":
        return "hour_of_day" if date else "date_hour"
    return period


def grouped(df: DataFrame, grain: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregate per key and bucket."""
    buckets = bucket_columns(grain)
    return df.groupBy(*keys, *[c.alias(name) for name, c in buckets.items()]).agg(*aggregates)


def bucket_averages(df: DataFrame, grain: str, keys: Sequence[str] = ()) -> DataFrame:
    """Averages per bucket of rows already filtered."""
    rows = grouped(
        df,
        grain,
        keys,
        F.avg("wattsOut").alias("avg_watts_out"),
        F.avg("temperature").alias("avg_temp"),
        F.avg("wattsIn").alias("avg_watts_in"),
    )
    return rows.select(
        *keys, bucket_label(grain).alias("periode"), "avg_watts_out", "avg_temp", "avg_watts_in"
    )


def rollup(
    df: DataFrame,
    period: str,
    date: str | None = None,
    as_of: Moment | None = None,
    keys: Sequence[str] = (),
    mode: str = "calendar",
) -> DataFrame:
    """The table of a view: averages per hour, day or month, in no order."""
    rows = select_period(df, period, date, as_of, mode)
    return bucket_averages(rows, grain_of(period, date), keys)


def label_order(
    rolled: DataFrame, chronological: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """Sort buckets by their text, so that months go ``01/2026`` before ``12/2025``.

    ``chronological`` sorts months by year first; the other labels sort by time as text.
    Equal labels go by ``keys``, so that the sort can also be cut within a label.
    """
    label = F.col("periode")
    if chronological:
        year_first = F.concat(F.substring(label, 4, 4), F.substring(label, 1, 2))
        label = F.when(label.rlike(r"^\d{2}/\d{4}$"), year_first).otherwise(label)
    return rolled.orderBy(label, *keys)


def _extremes() -> list[Column]:
    return [
        F.min("wattsIn").alias("min_watts_in"),
        F.max("wattsIn").alias("max_watts_in"),
        F.min("wattsOut").alias("min_watts_out"),
        F.max("wattsOut").alias("max_watts_out"),
    ]


def minmax_raw(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes of power in and out over the rows given."""
    return df.groupBy(*keys).agg(*_extremes())


def minmax_hourly(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes over the extremes of each hour, which are those of the rows."""
    return minmax_raw(df, keys)


def minmax_daily(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes over the extremes of each day, which are those of the rows."""
    return minmax_raw(df, keys)


def mean_of_buckets(rolled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The unweighted mean of bucket averages, not the mean of the rows.

    Buckets without a value are skipped; with none left the mean is 0.
    """
    zero = F.lit(0.0)
    return rolled.groupBy(*keys).agg(
        F.coalesce(F.avg("avg_watts_in"), zero).alias("avg_watts_in"),
        F.coalesce(F.avg("avg_watts_out"), zero).alias("avg_watts_out"),
    )


def summary_of_buckets(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row from buckets which hold averages and extremes; zeros where there are none."""
    zero = F.lit(0.0)
    parts = []
    for side in ("in", "out"):
        for how, fold in (("avg", F.avg), ("min", F.min), ("max", F.max)):
            name = f"{how}_watts_{side}"
            parts.append(F.coalesce(fold(name), zero).alias(name))
    return buckets.groupBy(*keys).agg(*parts)


def summary(
    df: DataFrame,
    period: str,
    date: str | None = None,
    as_of: Moment | None = None,
    keys: Sequence[str] = (),
    mode: str = "calendar",
) -> DataFrame:
    """Mean of buckets, minimum and maximum of power in and out for a view.

    Extremes of buckets are extremes of the rows, so one scan and one bucket table
    give all six numbers.
    """
    rows = select_period(df, period, date, as_of, mode)
    buckets = grouped(
        rows,
        grain_of(period, date),
        keys,
        F.avg("wattsIn").alias("avg_watts_in"),
        F.avg("wattsOut").alias("avg_watts_out"),
        *_extremes(),
    )
    return summary_of_buckets(buckets, keys)


def stats_24h(
    df: DataFrame, as_of: Moment, keys: Sequence[str] = (), mode: str = "calendar"
) -> DataFrame:
    """Statistics of the last day; no row where there is no reading.

    ``sum_abs_wh_out`` adds up a cumulative counter and so is no amount of energy; it
    is kept as the statistic which the logger prints.
    """
    return (
        lookback(df, as_of, 1, "day", mode)
        .groupBy(*keys)
        .agg(
            F.avg("wattsOut").alias("avg_watts_out"),
            F.max("wattsOut").alias("max_watts_out"),
            F.min("wattsOut").alias("min_watts_out"),
            F.avg("socPercent").alias("avg_soc"),
            F.sum(F.abs("whOut")).alias("sum_abs_wh_out"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") > 0)
    )
