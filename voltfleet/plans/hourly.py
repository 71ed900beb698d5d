"""The hourly table: sums, counts and extremes of each hour.

Built once per reading, it answers every rollup, summary and statistic of a view
from a few rows per device and hour. Its hours fall inside days, weeks and months,
so the period filters and the removal of a period work on it unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.operators.periods import Moment, as_moment, lookback, select_period
from voltfleet.operators.rollups import (
    EXTREMES,
    bucket_columns,
    bucket_label,
    grain_of,
    summary_of_buckets,
)
from voltfleet.sources.tables import by_date, refuse_stream_table

# Name used in the hourly table and the measure it comes from.
_AVERAGED = {
    "watts_out": "wattsOut",
    "temp": "temperature",
    "watts_in": "wattsIn",
    "soc": "socPercent",
}


def hour_partials() -> list[Column]:
    """Aggregates which can be aggregated again without loss."""
    partials = [F.count("*").alias("n")]
    for name, measure in _AVERAGED.items():
        partials += [
            F.sum(measure).alias(f"sum_{name}"),
            F.count(measure).alias(f"count_{name}"),
        ]
    return [
        *partials,
        F.min("wattsIn").alias("min_watts_in"),
        F.max("wattsIn").alias("max_watts_in"),
        F.min("wattsOut").alias("min_watts_out"),
        F.max("wattsOut").alias("max_watts_out"),
        F.sum(F.abs("whOut")).alias("sum_abs_wh_out"),
    ]


PARTIALS = (
    "n",
    *[f"{part}_{name}" for name in _AVERAGED for part in ("sum", "count")],
    *EXTREMES,
    "sum_abs_wh_out",
)


def merged_partials() -> list[Column]:
    """The aggregates of :func:`hour_partials` over rows which already hold them."""
    folds = {"min": F.min, "max": F.max}
    return [folds.get(name.split("_")[0], F.sum)(name).alias(name) for name in PARTIALS]


def mean(name: str) -> Column:
    """Mean of a measure from its merged sum and count; NULL without values."""
    return F.try_divide(F.col(f"sum_{name}"), F.col(f"count_{name}"))


def hourly_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and hour; ``ts`` is the start of the hour."""
    hours = df.groupBy(*keys, "log_date", F.hour("ts").alias("_hour")).agg(*hour_partials())
    start = F.concat(
        F.col("log_date").cast("string"),
        F.lit(" "),
        F.lpad(F.col("_hour").cast("string"), 2, "0"),
        F.lit(":00:00"),
    )
    return hours.select(
        *keys, start.cast("timestamp_ntz").alias("ts"), *PARTIALS, "log_date"
    )


def write_hourly(hourly: DataFrame, path: str) -> None:
    """Replace the dates which ``hourly`` covers, each with a directory of its own.

    Give whole dates. Writing them again, after late readings or a failed run, changes
    nothing else.
    """
    refuse_stream_table(hourly.sparkSession, path)
    (
        by_date(hourly)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(path)
    )


def _buckets(hourly: DataFrame, grain: str, keys: Sequence[str]) -> DataFrame:
    names = [c.alias(name) for name, c in bucket_columns(grain).items()]
    return (
        hourly.groupBy(*keys, *names)
        .agg(*merged_partials())
        .withColumns({f"avg_{name}": mean(name) for name in _AVERAGED})
    )


def _hours_of(
    hourly: DataFrame, period: str, date: str | None, as_of: Moment | None, mode: str
) -> DataFrame:
    """The hours of a view. An exact start within an hour would need its readings."""
    if mode == "exact" and not date and as_of is not None:
        moment = as_moment(as_of)
        if (moment.minute, moment.second, moment.microsecond) != (0, 0, 0):
            raise ValueError("an exact view of the hourly table starts on a full hour")
    return select_period(hourly, period, date, as_of, mode)


def rollup_from_hourly(
    hourly: DataFrame,
    period: str,
    date: str | None = None,
    as_of: Moment | None = None,
    keys: Sequence[str] = (),
    mode: str = "calendar",
) -> DataFrame:
    """The table of a view, from the hourly table."""
    grain = grain_of(period, date)
    rows = _buckets(_hours_of(hourly, period, date, as_of, mode), grain, keys)
    return rows.select(
        *keys, bucket_label(grain).alias("periode"), "avg_watts_out", "avg_temp", "avg_watts_in"
    )


def minmax_from_hourly(hourly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes over the hours given."""
    folds = [(F.min if e.startswith("min") else F.max)(e).alias(e) for e in EXTREMES]
    return hourly.groupBy(*keys).agg(*folds)


def summary_from_hourly(
    hourly: DataFrame,
    period: str,
    date: str | None = None,
    as_of: Moment | None = None,
    keys: Sequence[str] = (),
    mode: str = "calendar",
) -> DataFrame:
    """The summary of a view, from the hourly table."""
    rows = _hours_of(hourly, period, date, as_of, mode)
    return summary_of_buckets(_buckets(rows, grain_of(period, date), keys), keys)


def stats_of_partials(merged: DataFrame, *names: str) -> DataFrame:
    """The last-day statistics from merged partials."""
    return merged.where(F.col("n") > 0).select(
        *names,
        mean("watts_out").alias("avg_watts_out"),
        "max_watts_out",
        "min_watts_out",
        mean("soc").alias("avg_soc"),
        "sum_abs_wh_out",
        "n",
    )


def stats_from_hourly(
    hourly: DataFrame, as_of: Moment, keys: Sequence[str] = ()
) -> DataFrame:
    """Statistics of the last calendar day, from the hourly table."""
    rows = lookback(hourly, as_of, 1, "day")
    return stats_of_partials(rows.groupBy(*keys).agg(*merged_partials()), *keys)
