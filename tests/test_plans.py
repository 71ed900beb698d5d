import io
import pathlib
import re
from contextlib import redirect_stdout

import pytest

from voltfleet.operators import keylists, latest, outages, periods, rollups
from voltfleet.plans import hourly
from voltfleet.sources.tables import append_readings, read_logs
from voltfleet.streaming import windows

LIBRARY = pathlib.Path(__file__).parent.parent / "voltfleet"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def table(spark, readings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    append_readings(readings([{"t": f"2024-01-{d:02d}T10:00:00"} for d in range(1, 29)]), path)
    return read_logs(spark, path)


@pytest.mark.parametrize(
    "select",
    [
        lambda df: periods.on_day(df, "2024-01-15"),
        lambda df: periods.in_week(df, "2024-W03"),
        lambda df: periods.in_months(df, "2024-01,2024-03"),
        lambda df: periods.in_hour(df, "2024-01-15 10"),
        lambda df: periods.lookback(df, "2024-01-20 00:00:00", 7, "days"),
    ],
)
def test_filters_prune_and_reach_the_scan(table, select):
    plan = plan_of(rollups.minmax_raw(select(table)))
    assert re.search(r"PartitionFilters: \[[^\]]*log_date#\d+ >=", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,", plan)


def test_only_needed_columns_are_read(table):
    plan = plan_of(rollups.rollup(table, "hour", "2024-01-15"))
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    wanted = "ts:timestamp_ntz,wattsOut:double,wattsIn:double,temperature:double"
    assert schema == f"ReadSchema: struct<{wanted}>"


def test_key_lists_read_no_data_column(table):
    for df in (keylists.available_dates, keylists.available_weeks, keylists.available_months):
        assert "ReadSchema: struct<>" in plan_of(df(table))


def test_month_list_needs_no_full_sort(table):
    assert "TakeOrderedAndProject" in plan_of(keylists.available_months(table))


def test_the_newest_reading_needs_one_folder(table):
    found = latest.latest_reading(latest.newest_day(table))
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\]]*log_date#\d+ = [^\]]*[Ss]ubquery", plan)
    assert str(found.first()["ts"]) == "2024-01-28 10:00:00"


def test_aggregates_fold_before_the_shuffle(table):
    keys = ["device_id"]
    for df in (
        rollups.bucket_averages(table, "date_hour", keys),
        rollups.stats_24h(table, "2024-01-20 00:00:00", keys),
        latest.latest_reading(table, keys),
    ):
        plan = plan_of(df)
        assert plan.count("Exchange\n") <= 1 or "partial_" in plan
        assert "partial_" in plan


def test_runs_slice_the_polls_by_day(polls):
    """One shuffle of the polls, on device and day, and one of what is left of the days."""
    plan = plan_of(outages.failure_runs(polls([(1, s, False) for s in range(10)])))
    assert "rangepartitioning" not in plan
    assert re.search(r"hashpartitioning\(device_id#\d+L?, slice#\d+", plan)
    initial = plan.split("== Initial Plan ==")[-1] if "== Initial Plan ==" in plan else plan
    assert len(re.findall(r"Arguments: hashpartitioning", initial)) <= 3


def test_extremes_take_one_shuffle(table):
    for extremes in (rollups.minmax_hourly, rollups.minmax_daily):
        plan = plan_of(extremes(table, ["device_id"]))
        assert len(re.findall(r"Arguments: hashpartitioning", plan)) == 1


def test_summary_is_one_scan(table):
    plan = plan_of(rollups.summary(table, "day", "2024-W03"))
    assert plan.count("Scan parquet") - plan.count(") Scan parquet") == 1
    assert "Join" not in plan


def test_no_plan_crosses_tables(table):
    assert "Cartesian" not in plan_of(rollups.summary(table, "day", "2024-W03"))
    for path in LIBRARY.rglob("*.py"):
        text = path.read_text()
        for banned in ("crossJoin", "toPandas", "localCheckpoint", ".rdd"):
            assert banned not in text, path


def test_a_label_order_by_keys_can_be_cut_within_a_label(table):
    rolled = rollups.rollup(table, "month", "2024-01", keys=["device_id"])
    plan = plan_of(rollups.label_order(rolled, keys=["device_id"]))
    assert re.search(r"rangepartitioning\(periode#\d+ ASC NULLS FIRST, device_id#\d+L? ASC", plan)


def test_an_exact_view_of_hours_starts_on_the_hour(table):
    hours = hourly.hourly_table(table)
    exact = hourly.rollup_from_hourly(hours, "day", as_of="2024-01-28 11:00:00", mode="exact")
    want = rollups.rollup(table, "day", as_of="2024-01-28 11:00:00", mode="exact")
    assert sorted(map(tuple, exact.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError, match="full hour"):
        hourly.summary_from_hourly(hours, "day", as_of="2024-01-28 11:30:00", mode="exact")


def test_sliding_hours_are_not_copied(table):
    plan = plan_of(windows.stats_of_hours(hourly.hourly_table(table)))
    assert "RangeFrame, -24" in plan and "24 AS k" not in plan
