import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from voltfleet.operators import latest as batch_latest
from voltfleet.operators.outages import failure_runs, outage_events
from voltfleet.plans import hourly
from voltfleet.schema import MEASURES
from voltfleet.sources.documents import read_state
from voltfleet.sources.tables import read_logs
from voltfleet.sources.manifest import Table
from voltfleet.streaming import folders, ingest, latest, outage_log, windows

FILES = 5
ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def events(spark):
    """Polls of three devices over two days, one of them busy."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        device, watts = rng.choice([1, 1, 1, 2, 3]), round(rng.uniform(0, 90), 2)
        rows.append((device, i, i * 120, watts, rng.random() > 0.5))
    df = spark.createDataFrame(rows, "device_id long, seq long, s long, w double, ok boolean")
    ts = F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz")
    members = [f"'\"{m}\":', w + {k}" for k, m in enumerate(MEASURES)]
    payload = F.expr("concat('{', " + ", ',', ".join(members) + ", '}')")
    return df.select("device_id", "seq", ts.alias("ts"), "ok", payload.alias("payload"))


def land(events, path, files):
    for k in files:
        part = events.where(F.col("seq") % FILES == k)
        part.coalesce(1).write.mode("append").parquet(path)


def follow(events, path):
    reader = events.sparkSession.readStream.schema(events.schema)
    return reader.option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def landing(events, tmp_path_factory):
    """The same in several files, each over the whole time: later batches hold late rows."""
    path = str(tmp_path_factory.mktemp("landing"))
    land(events, path, range(FILES))
    return path


@pytest.fixture
def stream(events, landing):
    return follow(events, landing)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert list(x) == [pytest.approx(v) if isinstance(v, float) else v for v in y]


def in_two_runs(events, tmp_path, start):
    """Run a stream, stop it after two batches, and go on from its checkpoint."""
    landing, path, checkpoint = (str(tmp_path / name) for name in ("in", "o", "c"))
    for files in (range(2), range(2, FILES)):
        land(events, landing, files)
        start(follow(events, landing), path, checkpoint).awaitTermination()
    return path


def test_ingest_and_restart(spark, events, tmp_path):
    landing, path, checkpoint = (str(tmp_path / name) for name in ("in", "t", "c"))
    for files in (range(2), range(2, FILES)):
        land(events, landing, files)
        ingest.stream_ingest(follow(events, landing), path, checkpoint, ONCE).awaitTermination()
        assert read_logs(spark, path).count() == 1500 * (files[-1] + 1) // FILES
    assert rows_of(read_logs(spark, path)) == rows_of(read_state(events.drop("ok")))


def test_corrupt_payloads_are_set_aside(spark, stream, tmp_path):
    broken = F.when(F.col("seq") % 10 == 0, "bad").otherwise(F.col("payload"))
    raw = stream.withColumn("payload", broken)
    path = str(tmp_path / "t")
    ingest.stream_corrupt(raw, path, str(tmp_path / "c"), ONCE).awaitTermination()
    assert spark.read.parquet(path).count() == 150


@pytest.mark.parametrize("keys", [[], ["device_id"]])
def test_hours_with_late_readings(spark, events, tmp_path, keys):
    def start(raw, path, checkpoint):
        return windows.write_hours(read_state(raw), path, checkpoint, ONCE, keys)

    got = windows.read_hours(spark, in_two_runs(events, tmp_path, start), keys)
    want = hourly.hourly_table(read_state(events), keys)
    close(rows_of(got), rows_of(want.select(*got.columns)))
    assert got.groupBy().sum("n").first()[0] == events.count()


def test_stats_of_each_full_hour(spark, events, stream, tmp_path):
    path = str(tmp_path / "hours")
    windows.write_hours(read_state(stream), path, str(tmp_path / "c"), ONCE).awaitTermination()
    got = windows.stats_of_hours(windows.read_hours(spark, path))
    day = F.window(F.date_trunc("hour", F.col("ts").cast("timestamp")), "24 hours", "1 hour")
    want = (
        read_state(events)
        .groupBy(day.alias("w"))
        .agg(
            F.avg("wattsOut"),
            F.max("wattsOut"),
            F.min("wattsOut"),
            F.avg("socPercent"),
            F.sum(F.abs("whOut")),
            F.count("*"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "*",
        )
        .drop("w")
    )
    close(rows_of(got), rows_of(want))


def test_latest(spark, events, tmp_path):
    def start(raw, path, checkpoint):
        return latest.write_latest(read_state(raw), path, checkpoint, ONCE)

    path = in_two_runs(events, tmp_path, start)
    assert latest.latest_table(spark, path).version().number == FILES
    want = batch_latest.latest_reading(read_state(events), ["device_id"])
    assert rows_of(latest.read_latest(spark, path)) == rows_of(want)


def test_latest_writes_changed_devices_only(spark, events, tmp_path):
    landing, path, checkpoint = (str(tmp_path / name) for name in ("in", "o", "c"))
    for part in ("seq < 1000", "device_id = 2 AND seq >= 1000"):
        events.where(part).coalesce(1).write.mode("append").parquet(landing)
        rows = read_state(follow(events, landing))
        latest.write_latest(rows, path, checkpoint, ONCE).awaitTermination()
    second = latest.latest_table(spark, path).version().pieces[1]
    assert spark.read.parquet(f"{path}/data/{second.folder}").count() == 1
    assert latest.read_latest(spark, path).count() == 3


def start_polls(raw, path, checkpoint):
    return outage_log.write_polls(raw, path, checkpoint, ONCE)


def test_outages_with_late_polls_and_a_restart(spark, events, tmp_path):
    path = in_two_runs(events, tmp_path, start_polls)
    want = failure_runs(events).select("device_id", "start", "end", "n")
    assert rows_of(outage_log.read_outages(spark, path).drop("is_open")) == rows_of(want)
    got = outage_log.read_outage_events(spark, path)
    assert rows_of(got) == rows_of(outage_events(events))


def events_by_hand(rows, threshold=3):
    """Alerts and recoveries, poll by poll."""
    out, runs = [], {}
    for device, ts, _, ok in sorted(rows):
        n, start, end = runs.get(device, (0, None, None))
        if ok:
            if n >= threshold:
                out.append((device, "recovery", ts, start, end, n))
            runs[device] = (0, None, None)
        else:
            runs[device] = (n + 1, start or ts, ts)
            if n + 1 >= threshold:
                out.append((device, "alert", ts, start or ts, ts, n + 1))
    return sorted(out, key=str)


def test_outage_events_are_those_of_the_polls_in_order(events):
    rows = [tuple(r) for r in events.select("device_id", "ts", "seq", "ok").collect()]
    assert rows_of(outage_events(events)) == events_by_hand(rows)


def test_outage_events_over_days_without_a_success(polls):
    day = 86_400
    marks = [(1, k * day // 2, False) for k in range(9)] + [(1, 5 * day, True), (2, 7, True)]
    rows = [tuple(r) for r in polls(marks).select("device_id", "ts", "seq", "ok").collect()]
    assert rows_of(outage_events(polls(marks))) == events_by_hand(rows)


def test_a_late_success_splits_a_run(spark, polls, tmp_path):
    landing, path, checkpoint = (str(tmp_path / name) for name in ("in", "o", "c"))
    marks = polls([(1, 10, False), (1, 20, False), (1, 30, False), (1, 15, True)])
    for low, high, alerts in ((0, 3, 1), (3, 4, 0)):
        part = marks.where(f"seq >= {low} AND seq < {high}")
        part.coalesce(1).write.mode("append").parquet(landing)
        start_polls(follow(marks, landing), path, checkpoint).awaitTermination()
        got = outage_log.read_outage_events(spark, path)
        assert got.where("kind = 'alert'").count() == alerts


def test_merged_pieces_read_the_same(spark, events, tmp_path):
    landing, path, checkpoint = (str(tmp_path / name) for name in ("in", "o", "c"))
    land(events, landing, range(FILES))

    def merge(rows):
        return rows.groupBy("device_id").agg(F.sum("n").alias("n"))

    def opened(session):
        return Table(session, path, "device_id bigint, n bigint", merge, fan_out=2)

    folders.write_table(
        follow(events, landing), opened, checkpoint,
        lambda rows: rows.groupBy("device_id").agg(F.count("*").alias("n")), ONCE,
    ).awaitTermination()
    # Five batches, merged in pairs: one piece of four and one of the last.
    assert sorted(p.tier for p in opened(spark).version().pieces) == [0, 2]
    assert rows_of(merge(opened(spark).read())) == rows_of(
        events.groupBy("device_id").agg(F.count("*"))
    )


def test_a_batch_reads_the_days_of_its_devices_only(spark, events, tmp_path, monkeypatch):
    path, read = str(tmp_path / "o"), []
    outage_log.keep_polls(events, path, "w", 0)
    touched = outage_log.touched_polls

    def watched(polls, new):
        found = touched(polls, new)
        read.extend(found.select("device_id", "log_date").distinct().collect())
        return found

    monkeypatch.setattr(outage_log, "touched_polls", watched)
    late = events.where("device_id = 3 AND date(ts) = '2024-01-02'").limit(1).withColumn("ok", ~F.col("ok"))
    late = late.withColumn("seq", F.lit(10_000).cast("long"))
    outage_log.keep_polls(late, path, "w", 1)
    outage_log.keep_polls(late, path, "w", 1)
    assert [(r[0], str(r[1])) for r in read] == [(3, "2024-01-02")]
    every = events.unionByName(late)
    got = outage_log.read_outage_events(spark, path)
    assert rows_of(got) == rows_of(outage_events(every))
    runs = failure_runs(every).select("device_id", "start", "end", "n")
    assert rows_of(outage_log.read_outages(spark, path).drop("is_open")) == rows_of(runs)
    dated = late.withColumn("log_date", F.to_date("ts"))
    plan = touched(outage_log.read_polls(spark, path), dated)._jdf.queryExecution().toString()
    assert "log_date" in plan.partition("PartitionFilters: [")[2].partition("]")[0]


def test_a_run_goes_on_over_since(spark, polls, tmp_path):
    """Two failures before midnight, one after, then a success: nothing of it is lost."""
    path, midnight = str(tmp_path / "o"), 1_700_006_400 - 1_700_000_000
    rows = [(1, midnight - 600, False), (1, midnight - 300, False), (1, midnight, False), (1, midnight + 300, True)]
    outage_log.keep_polls(polls(rows), path, "w", 0)
    whole = outage_log.read_outage_events(spark, path)
    late = outage_log.read_outage_events(spark, path, since="2023-11-15")
    assert rows_of(late) == rows_of(whole) and late.count() == 2
    assert outage_log.read_outages(spark, path, since="2023-11-15").first()["n"] == 3
    assert outage_log.read_outages(spark, path, since="2023-11-16").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_days_in_any_order_and_merged_give_the_events_in_order(spark, polls, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "o")
    marks = [(rng.choice([1, 2]), rng.randrange(6) * 40_000 + k, rng.random() < 0.3) for k in range(120)]
    every = polls(marks)
    for batch in range(4):
        part = every.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == batch)
        outage_log.keep_polls(part, path, "w", batch, fan_out=2)
    rows = [tuple(r) for r in every.select("device_id", "ts", "seq", "ok").collect()]
    assert rows_of(outage_log.read_outage_events(spark, path)) == events_by_hand(rows)
    higher = outage_log.read_outage_events(spark, path, threshold=5)
    assert rows_of(higher) == events_by_hand(rows, 5)


def test_readers_before_the_first_batch(spark, tmp_path):
    path = str(tmp_path / "none")
    assert latest.read_latest(spark, path).count() == 0
    assert windows.read_hours(spark, path).count() == 0
    assert outage_log.read_outages(spark, path).count() == 0
    assert outage_log.read_outage_events(spark, path).count() == 0
