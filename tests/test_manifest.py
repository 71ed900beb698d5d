import os
import random
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from voltfleet.operators import device_index
from voltfleet.operators.latest import latest_reading
from voltfleet.operators.retention import delete_period
from voltfleet.sources import files
from voltfleet.sources.manifest import Piece, Removal, Table, Version, due, folders
from voltfleet.sources.tables import append_readings, read_logs, readings_table


def day(d, rows=1, hour=10):
    return [{"t": f"2026-01-{d:02d}T{hour:02d}:{k:02d}:00", "wattsOut": k} for k in range(rows)]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_a_repeated_batch_adds_no_row(spark, readings, path):
    rows = readings(day(1, 3))
    assert append_readings(rows, path, "w", 0)
    assert not append_readings(rows, path, "w", 0)
    assert append_readings(rows, path, "w", 1)
    assert append_readings(rows, path, "other", 0)
    assert not append_readings(rows, path, "w", 0)
    assert read_logs(spark, path).count() == 9


def test_readers_stay_with_their_version(spark, readings, path):
    append_readings(readings(day(1, 2)), path)
    table = readings_table(spark, path)
    before = table.read()
    append_readings(readings(day(2, 3)), path)
    table.remove(date(2026, 1, 1), date(2026, 1, 2))
    table.compact()
    assert before.count() == 2
    assert [table.read(n).count() for n in table.versions()] == [2, 5, 3, 3]


def test_rows_added_after_a_removal_stay(spark, readings, path):
    append_readings(readings(day(1, 4)), path)
    assert delete_period(spark, path, "day", "2026-01-01") == 4
    assert delete_period(spark, path, "day", "2026-01-01") == 0
    append_readings(readings(day(1, 2)), path)
    assert read_logs(spark, path).count() == 2
    readings_table(spark, path).compact()
    assert read_logs(spark, path).count() == 2
    assert readings_table(spark, path).version().removals == ()


def between(monkeypatch, then):
    """Run ``then`` once, just before the next version is put."""
    put, done = files.put_new, []

    def late(*args):
        if not done:
            done.append(1)
            then()
        return put(*args)

    monkeypatch.setattr(files, "put_new", late)


def test_an_append_during_a_removal_is_kept(spark, readings, path, monkeypatch):
    append_readings(readings(day(1, 4)), path)
    more = readings(day(1, 3))
    between(monkeypatch, lambda: append_readings(more, path))
    assert delete_period(spark, path, "day", "2026-01-01") == 4
    assert read_logs(spark, path).count() == 3


def test_a_merge_during_a_removal_makes_it_look_again(spark, readings, path, monkeypatch):
    for _ in range(2):
        append_readings(readings(day(1, 4)), path)
    table = readings_table(spark, path)
    between(monkeypatch, table.compact)
    assert table.remove(date(2026, 1, 1), date(2026, 1, 2)) == 8
    assert table.read().count() == 0


def test_a_removal_during_a_merge_stops_the_merge(spark, readings, path, monkeypatch):
    for _ in range(2):
        append_readings(readings(day(1, 4)), path)
    table = readings_table(spark, path)
    between(monkeypatch, lambda: delete_period(spark, path, "hour", "2026-01-01 10"))
    assert not table.compact()
    assert table.read().count() == 0


def test_a_driver_lost_midway_loses_nothing(spark, readings, path, monkeypatch):
    for d in (1, 1, 2):
        append_readings(readings(day(d, 3)), path, "w", d * 10 + len(day(d)))
    for _ in range(1):
        append_readings(readings(day(1, 3)), path)
    table, before = readings_table(spark, path), rows_of(read_logs(spark, path))

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "put_new", lost)
        for step in (
            table.compact,
            lambda: table.remove(date(2026, 1, 1), date(2026, 1, 2)),
            lambda: append_readings(readings(day(3, 3)), path),
        ):
            with pytest.raises(KeyboardInterrupt):
                step()
    assert rows_of(read_logs(spark, path)) == before
    assert table.vacuum() == 0  # what is young may still be named
    assert table.vacuum(min_age_s=-10) == 2
    assert rows_of(read_logs(spark, path)) == before


def test_vacuum_keeps_what_the_newest_versions_name(spark, readings, path):
    for _ in range(3):
        append_readings(readings(day(1, 2)), path)
    table = readings_table(spark, path)
    table.compact()
    assert table.vacuum(keep=2, min_age_s=-10) == 0
    assert [table.read(n).count() for n in table.versions()] == [6, 6]
    assert table.vacuum(keep=1, min_age_s=-10) == 3
    assert table.read().count() == 6
    assert len(os.listdir(f"{path}/data")) == 1


def test_one_of_two_writers_puts_a_version(spark, tmp_path):
    name = str(tmp_path / "v" / "1.json")
    assert files.put_new(spark, name, "a") and not files.put_new(spark, name, "b")
    assert files.read_text(spark, name) == "a"
    assert list(files.names(spark, str(tmp_path / "v"))) == ["1.json"] or ".1.json" in str(
        files.names(spark, str(tmp_path / "v"))
    )


def test_removals_meet_their_dates_only():
    piece = Piece("f", "2026-01-02", 0, 3)
    whole = Removal("2026-01-01", "2026-01-02", 5)
    assert not whole.meets(piece)
    assert Removal("2026-01-01", "2026-01-03", 5).meets(piece)
    assert Removal("2026-01-02T09:00:00", "2026-01-02T10:00:00", 5).meets(piece)
    assert not Removal("2026-01-02", "2026-01-03", 2).meets(piece)
    assert not Removal("2026-01-01T23:00:00", "2026-01-02T00:00:00", 5).meets(piece)
    version = Version(5, (piece,), (whole,), {"w": 1})
    assert Version.loaded(version.dumped()) == version
    assert version.without([piece]).removals == ()


@pytest.mark.parametrize("fan_out", [2, 8])
def test_a_row_is_rewritten_a_logarithmic_number_of_times(fan_out):
    """A thousand batches of a date, by the rule that picks what to merge."""
    pieces, sizes, rewritten, batches = [], {}, 0, 1000
    for k in range(batches):
        piece = Piece(str(k), "2026-01-01", 0, k)
        pieces.append(piece)
        sizes[piece] = 1
        while found := due(pieces, fan_out):
            merged = replace(found[0], folder=f"m{k}-{found[0].tier}", tier=found[0].tier + 1)
            sizes[merged] = sum(sizes[p] for p in found)
            rewritten += sizes[merged]
            pieces = [p for p in pieces if p not in found] + [merged]
    tiers = {2: 9, 8: 3}[fan_out]
    assert rewritten <= tiers * batches
    assert len(pieces) <= (fan_out - 1) * (tiers + 1)
    assert sum(sizes[p] for p in pieces) == batches


def test_batches_of_many_dates_merge_date_by_date(spark, path):
    rng = random.Random(1)
    table = Table(
        spark, path, "n bigint, log_date date",
        lambda rows: rows.groupBy("log_date").agg(F.sum("n").alias("n")), fan_out=2,
    )
    total = 0
    for k in range(9):
        dates = [date(2026, 1, 1 + rng.randrange(3)) for _ in range(3)]
        total += 3
        rows = spark.createDataFrame([(1, d) for d in dates], "n bigint, log_date date")
        table.append(rows.groupBy("log_date").agg(F.sum("n").alias("n")).select("n", "log_date"), "w", k)
    assert table.read().agg(F.sum("n")).first()[0] == total
    pieces = table.version().pieces
    assert len(pieces) == len({(p.date, p.tier) for p in pieces})
    one = table.read(dates=lambda day: day == "2026-01-02")
    assert {r["log_date"] for r in one.collect()} == {date(2026, 1, 2)}


def test_times_in_a_removal(spark, readings, path):
    append_readings(readings(day(1, 3) + day(1, 2, 11) + [{"t": None}]), path)
    table = readings_table(spark, path)
    assert table.remove(datetime(2026, 1, 1, 10, 1), datetime(2026, 1, 1, 11, 1)) == 3
    assert table.read().count() == 3


def test_a_whole_write_is_listed_as_one_folder():
    pieces = [Piece(f"w/log_date={d}", d, 0, 1, 2) for d in ("2026-01-01", "2026-01-02")]
    single = Piece("v/log_date=2026-01-01", "2026-01-01", 0, 2, 3)
    assert folders([*pieces, single]) == ["w", "v/log_date=2026-01-01"]
    assert folders([Piece("u", "", 0, 1)]) == ["u"]


def test_newest_reading_of_each_device_reads_its_dates_only(spark, readings, path, monkeypatch):
    def on(device, *days):
        return [{"device_id": device, "t": f"2026-01-{d:02d}T10:00:00", "wattsOut": d} for d in days]

    append_readings(readings(on(1, 1, 2, 9) + on(2, 1, 3) + on(3, 2) + on(None, 4) + [{"t": None}]), path)
    append_readings(readings(on(1, 8) + on(2, 2)), path)
    asked = []
    read = Table.read

    def watched(self, version=None, dates=None):
        if dates is not None:
            asked.append({p.date for p in version.pieces if p.date and dates(p.date)})
        return read(self, version, dates)

    monkeypatch.setattr(Table, "read", watched)

    def check():
        got = rows_of(device_index.latest_by_device(spark, path))
        every = read_logs(spark, path).where("log_date IS NOT NULL")
        assert got == rows_of(latest_reading(every, ["device_id"]))
        return asked[-1]

    assert check() == {"2026-01-09", "2026-01-03", "2026-01-02", "2026-01-04"}
    # A removal sends a device back to an older date, a later reading forward.
    delete_period(spark, path, "hour", "2026-01-09 10")
    delete_period(spark, path, "day", "2026-01-03")
    assert check() == {"2026-01-08", "2026-01-02", "2026-01-04"}
    append_readings(readings(on(3, 12)), path)
    assert check() == {"2026-01-08", "2026-01-02", "2026-01-04", "2026-01-12"}
    readings_table(spark, path).compact()
    assert check() == {"2026-01-08", "2026-01-02", "2026-01-04", "2026-01-12"}
    before = device_index.index_table(spark, path).version().number
    assert check() and device_index.index_table(spark, path).version().number == before
