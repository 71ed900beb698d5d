import sqlite3
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from voltfleet.functions.timekeys import parse_local_time, time_keys, week_key
from voltfleet.operators.periods import cutoff, week_span


def test_weeks_agree_with_sqlite_over_36_years(spark):
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(13_000)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    ours = {r[0]: r[1] for r in df.select("day", week_key(F.col("day"))).collect()}
    con = sqlite3.connect(":memory:")
    for day in days:
        (theirs,) = con.execute("SELECT strftime('%Y-W%W', ?)", (str(day),)).fetchone()
        assert ours[day] == theirs
        start, end = week_span(theirs)
        assert start <= day < end


def test_named_weeks(readings):
    rows = time_keys(
        readings(
            [
                {"t": "2023-01-01T00:00:00"},
                {"t": "2024-01-01T00:00:00"},
                {"t": "2024-12-31T00:00:00"},
            ]
        )
    ).orderBy("seq")
    assert [r["week"] for r in rows.collect()] == ["2023-W00", "2024-W01", "2024-W53"]


def test_week_span_of_missing_weeks_is_empty():
    assert week_span("2024-W00") == (date(2024, 1, 1), date(2024, 1, 1))
    start, end = week_span("2023-W60")
    assert start >= end


def test_labels(readings):
    row = time_keys(readings([{"t": "2026-01-05T09:07:01.5"}])).first()
    assert row["hour_of_day"] == "09:00"
    assert row["date_hour"] == "2026-01-05 09:00"
    assert row["day"] == "2026-01-05"
    assert row["year_month"] == "2026-01"
    assert row["month_label"] == "01/2026"


def test_month_cutoff_agrees_with_sqlite():
    con = sqlite3.connect(":memory:")
    day = datetime(1999, 1, 1, 10, 30)
    for _ in range(3000):
        for n in (1, 6, 11):
            (theirs,) = con.execute(
                "SELECT datetime(?, ?)", (day.isoformat(sep=" "), f"-{n} months")
            ).fetchone()
            assert cutoff(day, n, "months").isoformat(sep=" ") == theirs
        day += timedelta(days=1)
    assert cutoff("2026-08-31 00:00:00", 6, "months").date() == date(2026, 3, 3)


def test_only_full_local_times_parse(spark):
    texts = {
        "2024-01-15T10:00:00": datetime(2024, 1, 15, 10),
        "2024-01-15T10:00:00.25": datetime(2024, 1, 15, 10, 0, 0, 250000),
        "2024-01-15T10:00:00+02:00": None,
        "2024-01-15T10:00:00Z": None,
        "2026-01": None,
        "garbage": None,
        "2024-13-45T10:00:00": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", parse_local_time(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == texts


def test_labels_do_not_depend_on_the_session_zone(spark, readings):
    zone = spark.conf.get("spark.sql.session.timeZone")
    # 02:30 on that day does not exist in Paris.
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        row = time_keys(readings([{"t": "2024-03-31T02:30:00"}])).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["date_hour"] == "2024-03-31 02:00"
