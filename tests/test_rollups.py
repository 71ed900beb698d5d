import random
import sqlite3

import pytest

from tests.conftest import rows_of
from voltfleet.operators import keylists, latest, periods, rollups
from voltfleet.plans import hourly
from voltfleet.plans.dashboard import dashboard, view_title
from voltfleet.schema import MEASURES

AS_OF = "2024-03-31 08:30:00"


@pytest.fixture(scope="module")
def sample(readings):
    """Readings of three devices, one of which has most of them; some are NULL."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        month, day = rng.randint(1, 3), rng.randint(1, 28)
        row = {
            "device_id": rng.choice([1, 1, 1, 1, 2, 3]),
            "seq": i,
            "t": f"2024-{month:02d}-{day:02d}T{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00",
        }
        for m in MEASURES:
            row[m] = None if rng.random() < 0.1 else round(rng.uniform(-50, 500), 2)
        rows.append(row)
    return rows, readings(rows).cache()


@pytest.fixture(scope="module")
def sqlite(sample):
    rows, _ = sample
    con = sqlite3.connect(":memory:")
    names = ["device_id", "seq", "t", *MEASURES]
    con.execute(f"CREATE TABLE logs ({', '.join(names)})")
    con.executemany(
        f"INSERT INTO logs VALUES ({', '.join('?' * len(names))})",
        [[row.get(n) for n in names] for row in rows],
    )
    return con


VIEWS = {
    ("hour", "2024-02-10", None): ("%H:00", "strftime('%Y-%m-%d', t) = '2024-02-10'"),
    ("hour", None, AS_OF): ("%Y-%m-%d %H:00", f"t >= datetime('{AS_OF}', '-24 hours')"),
    ("day", "2024-W06", None): ("%Y-%m-%d", "strftime('%Y-W%W', t) = '2024-W06'"),
    ("day", None, AS_OF): ("%Y-%m-%d", f"t >= datetime('{AS_OF}', '-7 days')"),
    ("month", "2024-01,2024-03", None): ("%m/%Y", "strftime('%Y-%m', t) IN ('2024-01','2024-03')"),
    ("month", None, AS_OF): ("%m/%Y", f"t >= datetime('{AS_OF}', '-6 months')"),
}


def near(ours, theirs):
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y) if isinstance(y, float) else y)


@pytest.mark.parametrize("view", VIEWS)
def test_rollup_agrees_with_sqlite(sample, sqlite, view):
    label, where = VIEWS[view]
    theirs = sqlite.execute(
        f"SELECT strftime('{label}', t) AS p, avg(wattsOut), avg(temperature), avg(wattsIn) "
        f"FROM logs WHERE {where} GROUP BY p ORDER BY p"
    ).fetchall()
    _, df = sample
    period, date, as_of = view
    ours = rollups.label_order(rollups.rollup(df, period, date, as_of)).collect()
    near([tuple(r) for r in ours], theirs)
    table = hourly.hourly_table(df)
    near(
        [
            tuple(r)
            for r in rollups.label_order(
                hourly.rollup_from_hourly(table, period, date, as_of)
            ).collect()
        ],
        theirs,
    )


@pytest.mark.parametrize("view", VIEWS)
def test_summary_agrees_with_its_parts(sample, view):
    _, df = sample
    period, date, as_of = view
    got = rollups.summary(df, period, date, as_of).first()
    rows = periods.select_period(df, period, date, as_of)
    means = rollups.mean_of_buckets(rollups.rollup(df, period, date, as_of)).first()
    raw = rollups.minmax_raw(rows).first()
    assert got["avg_watts_in"] == pytest.approx(means["avg_watts_in"])
    assert got["avg_watts_out"] == pytest.approx(means["avg_watts_out"])
    for name in rollups.EXTREMES:
        assert got[name] == (raw[name] or 0.0)
    assert rollups.minmax_hourly(rows).first() == raw
    assert rollups.minmax_daily(rows).first() == raw
    table = hourly.hourly_table(df)
    hours = periods.select_period(table, period, date, as_of)
    assert hourly.minmax_from_hourly(hours).first() == raw
    near(
        [tuple(hourly.summary_from_hourly(table, period, date, as_of).first())], [tuple(got)]
    )


def test_stats(sample, sqlite):
    _, df = sample
    theirs = sqlite.execute(
        "SELECT avg(wattsOut), max(wattsOut), min(wattsOut), avg(socPercent), sum(abs(whOut)), "
        "count(*) FROM logs WHERE t >= datetime('2024-03-20 10:00:00', '-1 day')"
    ).fetchall()
    as_of = "2024-03-20 10:00:00"
    near([tuple(rollups.stats_24h(df, as_of).first())], theirs)
    near([tuple(hourly.stats_from_hourly(hourly.hourly_table(df), as_of).first())], theirs)
    assert rollups.stats_24h(df, "2030-01-01 00:00:00").count() == 0


def test_unequal_buckets(readings):
    df = readings(
        [{"t": "2024-01-05T08:00:00", "wattsOut": 10}]
        + [{"t": f"2024-01-05T09:0{i}:00", "wattsOut": 20} for i in range(9)]
    )
    rolled = rollups.rollup(df, "hour", "2024-01-05")
    assert rollups.mean_of_buckets(rolled).first()["avg_watts_out"] == 15.0
    # Every wattsIn is NULL: the bucket is skipped, and the mean of none is 0.
    assert rolled.first()["avg_watts_in"] is None
    assert rollups.mean_of_buckets(rolled).first()["avg_watts_in"] == 0.0


def test_empty_input(readings):
    df = readings([{"t": "2020-01-01T00:00:00", "wattsOut": 5}])
    assert rollups.rollup(df, "hour", "2024-01-05").count() == 0
    assert tuple(rollups.summary(df, "hour", "2024-01-05").first()) == (0.0,) * 6
    assert tuple(rollups.minmax_raw(periods.on_day(df, "2024-01-05")).first()) == (None,) * 4


def test_a_device_does_not_change_with_others(sample):
    _, df = sample
    keys = ["device_id"]
    together = rollups.summary(df, "month", as_of=AS_OF, keys=keys)
    alone = rollups.summary(df.where("device_id = 2"), "month", as_of=AS_OF, keys=keys)
    near(rows_of(together.where("device_id = 2")), rows_of(alone))


def test_buckets_add_up(sample):
    rows, df = sample
    table = hourly.hourly_table(df, ["device_id"])
    assert table.groupBy().sum("n").first()[0] == len(rows)


def test_label_order(readings):
    df = readings([{"t": "2025-12-05T00:00:00"}, {"t": "2026-01-05T00:00:00"}])
    rolled = rollups.rollup(df, "month", "2025-12,2026-01")
    as_text = [r["periode"] for r in rollups.label_order(rolled).collect()]
    by_time = [r["periode"] for r in rollups.label_order(rolled, chronological=True).collect()]
    assert as_text == ["01/2026", "12/2025"] and by_time == ["12/2025", "01/2026"]


def test_key_lists(readings):
    days = ["2023-01-01", "2024-01-01", "2024-01-03", "2024-12-31"]
    df = readings([{"t": f"{d}T00:00:00"} for d in days] + [{"t": "garbage"}])
    assert [r[0] for r in keylists.available_dates(df).collect()] == [*reversed(days), None]
    weeks = [(r[0], str(r[1])) for r in keylists.available_weeks(df).collect()]
    assert weeks == [
        ("2024-W53", "2024-12-31"),
        ("2024-W01", "2024-01-01"),
        ("2023-W00", "2023-01-01"),
        (None, "None"),
    ]
    many = readings([{"t": f"2023-{m:02d}-01T00:00:00"} for m in range(1, 10)])
    months = [r[0] for r in keylists.available_months(many).collect()]
    assert months == [f"2023-{m:02d}" for m in (9, 8, 7, 6, 5, 4)]


def test_latest(readings):
    df = readings(
        [
            {"t": "2024-01-01T00:00:00", "wattsOut": 1, "timeToEmptyFull": 90},
            {"t": "2024-01-02T00:00:00", "wattsOut": 2, "seq": 8},
            {"t": "2024-01-02T00:00:00", "wattsOut": None, "socPercent": 3, "seq": 9},
            {"t": "zzz", "wattsOut": 99},
            {"device_id": 2, "t": "2023-01-01T00:00:00", "wattsOut": 7, "timeToEmptyFull": 61},
        ]
    )
    row = latest.latest_reading(df).first()
    assert row["soc"] == 3.0 and row["watts_out"] is None and row["time_left"] == "--:--"
    per_device = {r["device_id"]: r for r in latest.latest_reading(df, ["device_id"]).collect()}
    assert per_device[2]["time_left"] == "01:01" and per_device[1]["soc"] == 3.0
    none = latest.latest_reading(df.where("seq < 0")).first()
    assert none["soc"] == 0.0 and none["wh_stored"] == 0.0 and none["temp"] == 0.0
    assert none["time_to_empty_full"] is None and none["time_left"] == "--:--"


def test_series_in_order(readings):
    df = readings([{"t": f"2024-01-05T{h:02d}:00:00"} for h in (5, 1, 3, 3)])
    got = latest.ordered_series(df, "hour", "2024-01-05").collect()
    assert [r["seq"] for r in got] == [1, 2, 3, 0]


def test_current_stats_of_silent_and_failing_devices(readings, polls):
    read = readings(
        [
            {"device_id": d, "t": "2023-11-14T22:00:00", "wattsIn": 5, "wattsOut": 3, "timeToEmptyFull": 90}
            for d in (1, 2, 3)
        ]
    )
    asked = polls([(1, 1, False), (1, 2, True), (2, 1, True), (2, 2, False), (4, 1, True), (5, 1, False)])
    found = latest.current_stats(read, asked, ["device_id"]).collect()
    assert {r["device_id"]: (r["connected"], r["time_left"], r["direction"], r["watts_in"]) for r in found} == {
        1: (True, "01:30", "charging", 5.0),
        2: (False, "--:--", "neutral", 5.0),
        3: (False, "--:--", "neutral", 5.0),
        4: (True, "--:--", "neutral", 0.0),
        5: (False, "--:--", "neutral", 0.0),
    }
    one = latest.current_stats(read, asked.where("seq < 0")).first()
    assert (one["connected"], one["watts_in"]) == (False, 5.0)
    none = latest.current_stats(read.where("seq < 0"), asked.where("seq < 0")).first()
    assert (none["connected"], none["ts"], none["soc"]) == (False, None, 0.0)


def test_dashboard(sample):
    _, df = sample
    parts = dashboard(df, "day", "2024-W06")
    assert set(parts) == {
        "title",
        "table",
        "summary",
        "series",
        "latest",
        "dates",
        "weeks",
        "months",
    }
    assert parts["title"] == "Par jour - Semaine 06/2024"
    in_week = periods.in_week(df, "2024-W06").count()
    assert parts["series"].count() == in_week
    fleet = dashboard(df, "day", "2024-W06", keys=["device_id"])
    assert fleet["latest"].count() == 3 and fleet["summary"].count() == 3
    assert fleet["series"].where("device_id = 2").count() == df.where(
        "device_id = 2 AND log_date BETWEEN '2024-02-05' AND '2024-02-11'"
    ).count()
    quick = dashboard(df, "day", "2024-W06", hourly=hourly.hourly_table(df))
    near(rows_of(quick["table"]), rows_of(parts["table"]))
    near(rows_of(quick["summary"]), rows_of(parts["summary"]))
    for part in ("dates", "weeks", "months"):
        assert quick[part].collect() == parts[part].collect()


def test_titles():
    assert view_title("hour") == "Par heure - Dernières 24h"
    assert view_title("hour", "2024-01-05") == "Par heure - 2024-01-05"
    assert view_title("month", "2024-01") == "Par mois - Sélection personnalisée"
    with pytest.raises(ValueError):
        view_title("day", "2024-06")
