"""Time filters.

Every filter names ``log_date``, which prunes partitions, and ``ts``, which reaches
the Parquet scan where a table is not partitioned. Keys are turned into date ranges
here, since the optimizer cannot see through a formatted time.
"""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("hour", "day", "month")

Moment = datetime | str


def as_moment(value: Moment) -> datetime:
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if moment.tzinfo is not None:
        raise ValueError("as_of is a local time without a zone")
    return moment


def check_period(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; one of {PERIODS}")


def _match(pattern: str, key: str, what: str) -> tuple[int, ...]:
    found = re.fullmatch(pattern, key)
    if not found:
        raise ValueError(f"{key!r} is not {what}")
    return tuple(int(g) for g in found.groups())


def day_span(key: str) -> tuple[date, date]:
    start = date(*_match(r"(\d{4})-(\d{2})-(\d{2})", key, "a day yyyy-MM-dd"))
    return start, start + timedelta(days=1)


def month_span(key: str) -> tuple[date, date]:
    year, month = _match(r"(\d{4})-(\d{2})", key, "a month yyyy-MM")
    start = date(year, month, 1)
    return start, (start + timedelta(days=31)).replace(day=1)


def week_span(key: str) -> tuple[date, date]:
    """Dates of a Monday week, cut to its year. A week which the year lacks is empty."""
    year, week = _match(r"(\d{4})-W(\d{2})", key, "a week yyyy-Www")
    new_year, next_year = date(year, 1, 1), date(year + 1, 1, 1)
    first_monday = new_year + timedelta(days=-new_year.weekday() % 7)
    start = first_monday + timedelta(weeks=week - 1)
    end = start + timedelta(weeks=1)
    return min(max(start, new_year), next_year), min(end, next_year)


def hour_span(key: str) -> tuple[datetime, datetime]:
    year, month, day, hour = _match(
        r"(\d{4})-(\d{2})-(\d{2}) (\d{2})", key, "an hour yyyy-MM-dd HH"
    )
    start = datetime(year, month, day, hour)
    return start, start + timedelta(hours=1)


def cutoff(as_of: Moment, n: int, unit: str) -> datetime:
    """``as_of`` minus ``n`` units.

    Months keep the day number and run over into the next month where the target
    month is too short: 31 August less 6 months is 3 March (2 March in a leap year).
    """
    moment = as_moment(as_of)
    if unit in ("hour", "hours"):
        return moment - timedelta(hours=n)
    if unit in ("day", "days"):
        return moment - timedelta(days=n)
    if unit in ("month", "months"):
        months = moment.year * 12 + moment.month - 1 - n
        first = moment.replace(year=months // 12, month=months % 12 + 1, day=1)
        return first + timedelta(days=moment.day - 1)
    raise ValueError(f"unknown unit {unit!r}")


def _moment(value: date | datetime) -> Column:
    if not isinstance(value, datetime):
        value = datetime.combine(value, time.min)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def on_dates(start: date, end: date) -> Column:
    """``start <= log_date < end``: reads no data column of a partitioned table."""
    return (F.col("log_date") >= F.lit(start)) & (F.col("log_date") < F.lit(end))


def between(start: date | datetime, end: date | datetime | None = None) -> Column:
    """``start <= ts < end`` together with the dates this spans."""

    def as_date(value: date | datetime) -> date:
        return value.date() if isinstance(value, datetime) else value

    log_date, ts = F.col("log_date"), F.col("ts")
    span = (log_date >= F.lit(as_date(start))) & (ts >= _moment(start))
    if end is not None:
        # The last date which holds a time before `end`.
        last = as_date(end)
        if not isinstance(end, datetime) or end.time() == time.min:
            last -= timedelta(days=1)
        span = span & (log_date <= F.lit(last)) & (ts < _moment(end))
    return span


def lookback(
    df: DataFrame,
    as_of: Moment,
    n: int,
    unit: str,
    mode: str = "calendar",
    unparsed: bool = False,
) -> DataFrame:
    """Rows since ``as_of`` minus ``n`` units, without an upper bound.

    ``calendar`` starts at midnight of the cutoff date, so "24 hours" takes in up to
    48; ``exact`` starts at the cutoff. ``unparsed`` also keeps rows without a time
    whose text sorts after the cutoff.
    """
    start = cutoff(as_of, n, unit)
    if mode == "calendar":
        keep = between(start.date())
    elif mode == "exact":
        keep = between(start)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if unparsed:
        text = start.isoformat(sep=" ", timespec="seconds")
        keep = keep | (F.col("log_date").isNull() & (F.col("date_heure") >= F.lit(text)))
    return df.where(keep)


def on_day(df: DataFrame, key: str) -> DataFrame:
    """Rows of the day ``yyyy-MM-dd``."""
    return df.where(between(*day_span(key)))


def in_week(df: DataFrame, key: str) -> DataFrame:
    """Rows of the Monday week ``yyyy-Www``, week 00 included."""
    return df.where(between(*week_span(key)))


def in_months(df: DataFrame, keys: str) -> DataFrame:
    """Rows of the months in a comma list ``yyyy-MM,yyyy-MM``."""
    spans = [between(*month_span(key)) for key in keys.split(",")]
    return df.where(reduce(lambda a, b: a | b, spans))


def in_hour(df: DataFrame, key: str) -> DataFrame:
    """Rows of the hour ``yyyy-MM-dd HH``."""
    return df.where(between(*hour_span(key)))


def select_period(
    df: DataFrame,
    period: str = "hour",
    date: str | None = None,
    as_of: Moment | None = None,
    mode: str = "calendar",
) -> DataFrame:
    """Rows which a view shows.

    With ``date``: a day for ``hour``, a week for ``day``, a list of months for
    ``month``. Without it the trailing 24 hours, 7 days or 6 months before ``as_of``.
    """
    check_period(period)
    if date:
        return {"hour": on_day, "day": in_week, "month": in_months}[period](df, date)
    if as_of is None:
        raise ValueError("a view without a date needs as_of")
    n, unit = {"hour": (24, "hours"), "day": (7, "days"), "month": (6, "months")}[period]
    return lookback(df, as_of, n, unit, mode)


def period_key(
    df: DataFrame,
    period: str,
    date: str | None = None,
    label: str = "periode",
    out: str = "key",
) -> DataFrame:
    """The delete or filter key of a displayed bucket label.

    An hour label ``HH:00`` needs the date it was shown for; a month ``MM/yyyy``
    becomes ``yyyy-MM``; a day stays as it is.
    """
    check_period(period)
    shown = F.col(label)
    if period == "hour":
        if not date:
            raise ValueError("an hour label needs its date")
        key = F.concat(F.lit(f"{date} "), F.substring(shown, 1, 2))
    elif period == "day":
        key = shown
    else:
        parts = F.split(shown, "/")
        key = F.when(shown.contains("/"), F.concat_ws("-", parts[1], parts[0])).otherwise(shown)
    return df.withColumn(out, key)
