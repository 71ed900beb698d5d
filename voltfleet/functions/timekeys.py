"""Bucket keys and labels as Column expressions.

Everything is built from a DATE and an hour number, never by formatting a
TIMESTAMP: formatting one per row is slow, and it would drag wall-clock times
through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A full ISO local time as the logger writes it: no zone offset, no shortened form.
ISO_LOCAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def parse_local_time(text: Column) -> Column:
    """ISO text to TIMESTAMP_NTZ; anything else, also a time with an offset, is NULL."""
    return F.when(text.rlike(ISO_LOCAL), text.try_cast("timestamp_ntz"))


def day_label(day: Column) -> Column:
    """``yyyy-MM-dd``."""
    return day.cast("string")


def hour_label(hour: Column) -> Column:
    """``HH:00`` of an hour number."""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def date_hour_label(day: Column, hour: Column) -> Column:
    """``yyyy-MM-dd HH:00``."""
    return F.concat(day_label(day), F.lit(" "), hour_label(hour))


def month_key(day: Column) -> Column:
    """``yyyy-MM``."""
    return F.substring(day.cast("string"), 1, 7)


def month_label(day: Column) -> Column:
    """``MM/yyyy``."""
    text = day.cast("string")
    return F.concat(F.substring(text, 6, 2), F.lit("/"), F.substring(text, 1, 4))


def week_key(day: Column) -> Column:
    """``yyyy-Www`` with weeks from Monday; the days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(
        F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")
    )


def time_keys(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add every bucket key and label which the other operators use."""
    day, hour = F.to_date(F.col(ts)), F.hour(F.col(ts))
    return df.withColumns(
        {
            "hour_of_day": hour_label(hour),
            "date_hour": date_hour_label(day, hour),
            "day": day_label(day),
            "year_month": month_key(day),
            "month_label": month_label(day),
            "week": week_key(day),
        }
    )
