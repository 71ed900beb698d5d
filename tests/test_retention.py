import os

import pytest

from voltfleet.operators.retention import delete_period, delete_to_snapshot, survivors
from voltfleet.plans import hourly
from voltfleet.sources.tables import append_readings, read_logs, readings_table

ROWS = [
    {"t": "2026-01-23T09:00:00"},
    {"t": "2026-01-23T09:59:59.999999"},
    {"t": "2026-01-23T10:00:00"},
    {"t": "2026-01-24T09:00:00"},
    {"t": "2026-02-01T00:00:00"},
    {"t": None},
    {"t": "garbage"},
]

CASES = [
    ("hour", "2026-01-23 09", {2, 3, 4, 5, 6}),
    ("hour", "2026-01-24 09", {0, 1, 2, 4, 5, 6}),
    ("hour", "2026-01-24 10", {0, 1, 2, 3, 4, 5, 6}),
    ("day", "2026-01-23", {3, 4, 5, 6}),
    ("day", "2020-01-01", {0, 1, 2, 3, 4, 5, 6}),
    ("month", "2026-01", {4, 5, 6}),
]


@pytest.mark.parametrize("period,key,left", CASES)
def test_delete(spark, readings, tmp_path, period, key, left):
    path = str(tmp_path / "t")
    df = readings(ROWS)
    append_readings(df, path)
    removed = delete_period(spark, path, period, key)
    assert removed == len(ROWS) - len(left)
    assert {r["seq"] for r in read_logs(spark, path).collect()} == left
    assert {r["seq"] for r in survivors(df, period, key).collect()} == left


def dates_of(spark, path):
    return {p.date for p in readings_table(spark, path).version().pieces}


def test_an_emptied_date_is_gone_at_the_next_merge(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    append_readings(readings(ROWS), path)
    delete_period(spark, path, "hour", "2026-01-24 09")
    assert "2026-01-24" in dates_of(spark, path)
    readings_table(spark, path).compact()
    assert dates_of(spark, path) == {None, "2026-01-23", "2026-02-01"}
    assert {r["seq"] for r in read_logs(spark, path).collect()} == {0, 1, 2, 4, 5, 6}


def test_other_dates_are_not_rewritten(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    append_readings(readings(ROWS), path)
    before = set(readings_table(spark, path).version().pieces)
    delete_period(spark, path, "hour", "2026-01-23 09")
    readings_table(spark, path).compact()
    gone = before - set(readings_table(spark, path).version().pieces)
    assert {p.date for p in gone} == {"2026-01-23"}


def test_snapshot(spark, readings, tmp_path):
    path, snapshot = str(tmp_path / "t"), str(tmp_path / "s")
    append_readings(readings(ROWS), path)
    assert delete_to_snapshot(spark, path, snapshot, "day", "2026-01-23") == 3
    assert read_logs(spark, path).count() == len(ROWS)
    assert {r["seq"] for r in read_logs(spark, snapshot).collect()} == {3, 4, 5, 6}


def test_a_folder_with_the_file_list_of_a_stream_is_refused(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    os.makedirs(f"{path}/_spark_metadata")
    with pytest.raises(ValueError, match="stream"):
        delete_period(spark, path, "day", "2026-01-23")
    with pytest.raises(ValueError, match="stream"):
        append_readings(readings(ROWS), path)


def test_a_plain_folder_is_read_but_not_appended_to(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    readings(ROWS).write.partitionBy("log_date").parquet(path)
    assert read_logs(spark, path).count() == len(ROWS)
    with pytest.raises(ValueError, match="plain"):
        append_readings(readings(ROWS), path)
    assert delete_period(spark, path, "day", "2026-01-23") == 3
    assert read_logs(spark, path).count() == len(ROWS) - 3


def test_unknown_period(spark, tmp_path):
    with pytest.raises(ValueError):
        delete_period(spark, str(tmp_path), "year", "2026")


def test_the_hourly_table_is_deleted_from_in_place(spark, readings, tmp_path):
    path = str(tmp_path / "h")
    table = hourly.hourly_table(readings(ROWS))
    hourly.write_hourly(table, path)
    hourly.write_hourly(table, path)
    assert spark.read.parquet(path).groupBy().sum("n").first()[0] == len(ROWS)
    schema = spark.read.parquet(path).schema
    assert delete_period(spark, path, "day", "2026-01-23", schema) == 2
    assert spark.read.schema(schema).parquet(path).groupBy().sum("n").first()[0] == len(ROWS) - 3


def test_the_hourly_table_takes_the_same_delete(readings):
    df = readings(ROWS)
    for period, key, _ in CASES:
        ours = hourly.hourly_table(survivors(df, period, key))
        from_table = survivors(hourly.hourly_table(df), period, key)
        counts = [
            t.where("ts IS NOT NULL").groupBy().sum("n").first()[0] for t in (ours, from_table)
        ]
        assert counts[0] == counts[1]
