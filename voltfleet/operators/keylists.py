"""The dates, weeks and months for which there are readings.

All three read only ``log_date``: in the partitioned table that is no data column.
Dates are made distinct before any label is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.functions.timekeys import day_label, month_key, week_key
from voltfleet.schema import MONTH_LIST_SIZE


def _dates(df: DataFrame) -> DataFrame:
    return df.select("log_date").distinct()


def available_dates(df: DataFrame) -> DataFrame:
    """Distinct dates, newest first; rows without a time give one NULL."""
    return _dates(df).select(day_label(F.col("log_date")).alias("date")).orderBy(F.desc("date"))


def available_weeks(df: DataFrame) -> DataFrame:
    """Distinct Monday weeks with the first date present in each, newest first."""
    return (
        _dates(df)
        .groupBy(week_key(F.col("log_date")).alias("week"))
        .agg(F.min("log_date").alias("week_start"))
        .orderBy(F.desc("week"))
    )


def available_months(df: DataFrame, n: int = MONTH_LIST_SIZE) -> DataFrame:
    """The newest ``n`` months."""
    return (
        _dates(df)
        .select(month_key(F.col("log_date")).alias("month"))
        .distinct()
        .orderBy(F.desc("month"))
        .limit(n)
    )
