import sqlite3

import pytest

from tests.conftest import rows_of
from voltfleet.operators import periods


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


def test_calendar_and_exact_lookback(readings):
    df = readings(
        [
            {"t": "2026-01-21T23:59:59"},
            {"t": "2026-01-22T00:10:00"},
            {"t": "2026-01-22T12:00:00"},
            {"t": "2026-01-25T00:00:00"},
            {"t": None},
        ]
    )
    as_of = "2026-01-23 12:00:00"
    assert seqs(periods.lookback(df, as_of, 24, "hours")) == [1, 2, 3]
    assert seqs(periods.lookback(df, as_of, 24, "hours", mode="exact")) == [2, 3]
    exact = set(seqs(periods.lookback(df, as_of, 24, "hours", mode="exact")))
    assert exact <= set(seqs(periods.lookback(df, as_of, 24, "hours")))


def test_lookback_agrees_with_a_text_compare(readings):
    texts = [
        f"2026-0{m}-{d:02d}T{h:02d}:00:00" for m in (2, 3) for d in range(1, 28) for h in (0, 13)
    ] + ["garbage", None, "0-earlier"]
    df = readings([{"t": t} for t in texts])
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE logs (id INTEGER, t TEXT)")
    con.executemany("INSERT INTO logs VALUES (?, ?)", list(enumerate(texts)))
    as_of = "2026-08-31 10:00:00"
    for n, unit in ((24, "hours"), (180, "days"), (6, "months")):
        theirs = con.execute(
            "SELECT id FROM logs WHERE t >= datetime(?, ?) ORDER BY id", (as_of, f"-{n} {unit}")
        ).fetchall()
        ours = periods.lookback(df, as_of, n, unit, unparsed=True)
        assert seqs(ours) == [r[0] for r in theirs]


def test_chosen_periods(readings):
    df = readings(
        [
            {"t": "2023-12-31T23:59:59.999999"},
            {"t": "2024-01-01T00:00:00"},
            {"t": "2024-01-07T23:59:59"},
            {"t": "2024-01-08T09:30:00"},
            {"t": "2024-02-29T10:00:00"},
            {"t": "2024-03-01T00:00:00"},
        ]
    )
    assert seqs(periods.on_day(df, "2024-01-01")) == [1]
    assert seqs(periods.in_week(df, "2024-W01")) == [1, 2]
    assert seqs(periods.in_week(df, "2023-W52")) == [0]
    assert seqs(periods.in_hour(df, "2024-01-08 09")) == [3]
    assert seqs(periods.in_months(df, "2023-12,2024-02")) == [0, 4]
    assert seqs(periods.select_period(df, "hour", "2024-01-01")) == [1]
    assert seqs(periods.select_period(df, "day", "2024-W01")) == [1, 2]
    assert seqs(periods.select_period(df, "month", "2024-01")) == [1, 2, 3]
    assert seqs(periods.select_period(df, "day", as_of="2024-03-01 00:00:00")) == [4, 5]


@pytest.mark.parametrize(
    "call",
    [
        lambda df: periods.in_week(df, "2024-03"),
        lambda df: periods.on_day(df, "2024-1-5"),
        lambda df: periods.in_hour(df, "2024-01-05"),
        lambda df: periods.in_months(df, "2024-01,soon"),
        lambda df: periods.select_period(df, "year", as_of="2024-01-01"),
        lambda df: periods.select_period(df, "hour"),
        lambda df: periods.lookback(df, "2024-01-01T00:00:00+02:00", 1, "day"),
        lambda df: periods.period_key(df, "hour"),
    ],
)
def test_bad_keys_raise(readings, call):
    with pytest.raises(ValueError):
        call(readings([{"t": "2024-01-01T00:00:00"}]))


def test_period_key(spark):
    hours = spark.createDataFrame([("09:00",)], "periode string")
    days = spark.createDataFrame([("2026-01-09",)], "periode string")
    months = spark.createDataFrame([("01/2026",), ("2026-02",)], "periode string")
    assert periods.period_key(hours, "hour", "2026-01-09").first()["key"] == "2026-01-09 09"
    assert periods.period_key(days, "day").first()["key"] == "2026-01-09"
    assert rows_of(periods.period_key(months, "month").select("key")) == [
        ("2026-01",),
        ("2026-02",),
    ]
