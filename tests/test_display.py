import random

from voltfleet.functions import display


def test_time_left(spark):
    values = [90.0, -90.0, 0.0, -1.0, None, 6000.0, -1.5, 59.99]
    df = spark.createDataFrame([(v,) for v in values], "timeToEmptyFull double")
    got = [r["time_left"] for r in display.format_time_left(df).collect()]
    assert got == ["01:30", "01:30", "00:00", "--:--", "--:--", "100:00", "00:01", "00:59"]


def test_time_left_needs_a_connection(spark):
    df = spark.createDataFrame([(90.0, False), (90.0, None)], "timeToEmptyFull double, up boolean")
    got = display.format_time_left(df, connected="up").collect()
    assert [r["time_left"] for r in got] == ["--:--", "--:--"]


def test_profiles(spark):
    rows = [(20, 85, 25), (0, 100, 95), (20, 85, 26), (20, None, 25)]
    df = spark.createDataFrame(rows, "min int, max int, re int")
    got = [r["profile"] for r in display.classify_profile(df).collect()]
    assert got == ["eco", "standard", "custom", None]


def test_direction(spark):
    rows = [
        (10.0, 5.0, True, "charging"),
        (5.0, 10.0, True, "discharging"),
        (5.0, 5.0, True, "discharging"),
        (0.0, 0.0, True, "neutral"),
        (None, 3.0, True, "discharging"),
        (3.0, None, True, "charging"),
        (10.0, 5.0, False, "neutral"),
    ]
    df = spark.createDataFrame(rows, "wattsIn double, wattsOut double, up boolean, want string")
    for r in display.charge_direction(df, connected="up").collect():
        assert r["direction"] == r["want"]


def test_chart(readings):
    df = readings(
        [
            {"t": "2024-01-05T09:07:31.25", "wattsOut": 3},
            {"t": None},
            {"t": "garbage which is longer than that"},
            {"t": "2026-01"},
        ]
    )
    labels = {
        "hour": "09:07",
        "day": "05/01 09:07",
        "month": "05/01",
    }
    for period, first in labels.items():
        got = display.chart_series(df, period).orderBy("seq").collect()
        assert [r["label"] for r in got] == [first, "???", "garbage which is lo", "2026-01"]
        assert got[0]["chart_watts_out"] == 3.0 and got[1]["chart_watts_out"] == 0.0


def test_rounding_is_that_of_python(spark):
    rng = random.Random(2)
    values = [0.15, 0.25, 2.675, 1.005, -0.04, -0.25, 1e-9, 1e15 + 0.3]
    values += [k / 32 for k in range(2000)] + [k / 800 for k in range(2000)]
    values += [round(rng.uniform(-1000, 1000), 3) for _ in range(5000)]
    df = spark.createDataFrame([(v, v, v) for v in values], "a double, b double, c double")
    got = display.display_round(df, {"a": 0, "b": 1, "c": 2}).collect()
    assert [tuple(r) for r in got] == [(round(v), round(v, 1), round(v, 2)) for v in values]


def test_rounding(spark):
    rows = [(2.5, 0.25, 0.125), (-2.5, 0.35, 0.375), (None, None, None)]
    df = spark.createDataFrame(rows, "w double, a double, b double")
    got = [tuple(r) for r in display.display_round(df, {"w": "watts", "a": 1, "b": 2}).collect()]
    assert got == [(3.0, 0.2, 0.12), (-2.0, 0.3, 0.38), (None, None, None)]


def test_utilisation(readings):
    df = readings(
        [
            {"socPercent": 120, "wattsOut": 3000, "wattsIn": 750, "temperature": 60},
            {"socPercent": 50, "wattsOut": None, "wattsIn": 0, "temperature": -6},
        ]
    )
    df = display.rated_utilisation(df).orderBy("seq")
    got = [
        (r["socPercent_share"], r["wattsOut_share"], r["wattsIn_share"], r["temperature_share"])
        for r in df.collect()
    ]
    assert got == [(1.2, 1.0, 0.5, 1.0), (0.5, None, 0.0, -0.1)]


def test_null_to_zero(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert tuple(display.null_to_zero(df, ["a"]).first()) == (0.0, None)
