"""Every operator as a query over the given tables.

Averages are rounded to 6 places and sums to 4, since the order in which doubles are
added differs from engine to engine. They are rounded to 9 places first, or a last
digit which differs would tip an exact half either way. Times are shown as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.functions import display, timekeys
from voltfleet.operators import config_log, device_index, keylists, latest, outages, periods, retention, rollups
from voltfleet.plans import hourly as hours
from voltfleet.plans.dashboard import dashboard as plan_dashboard
from voltfleet.schema import MEASURES
from voltfleet.session import working_dir
from voltfleet.sources import documents, tables
from voltfleet.streaming import ingest, outage_log, windows
from voltfleet.streaming import latest as live
from workload import views as v

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}


def job(fn: Job) -> Job:
    JOBS[fn.__name__] = fn
    return fn


def _shown(df: DataFrame) -> DataFrame:
    """Round doubles and show times as text, so that two engines can agree."""
    out = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "double":
            places = 4 if field.name.startswith("sum_") else 6
            out[field.name] = F.round(F.round(field.name, 9), places)
        elif kind == "timestamp_ntz":
            out[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumns(out) if out else df


# Sources and sinks


@job
def read_state(spark, d):
    rows = documents.read_state(v.state_raw(spark, d))
    return _shown(rows.select("device_id", "seq", *MEASURES, "log_date"))


@job
def count_states(spark, d):
    return documents.count_states(v.state_raw(spark, d))


@job
def corrupt_states(spark, d):
    return documents.corrupt_states(v.state_raw(spark, d)).select("device_id", "seq", "payload")


@job
def append_readings(spark, d):
    path = working_dir(spark, "readings")
    tables.append_readings(v.readings(spark, d), path)
    written = tables.read_logs(spark, path)
    return (
        written.groupBy("log_date")
        .agg(F.count("*").alias("n"), F.sum("wattsOut").alias("sum_watts_out"))
        .transform(_shown)
    )


@job
def read_logs(spark, d):
    path = working_dir(spark, "readings")
    tables.append_readings(v.readings(spark, d), path)
    return _shown(tables.read_logs(spark, path))


@job
def parse_time(spark, d):
    texts = v.readings(spark, d).select(
        "seq",
        # Every kind of text which is no local time, next to the good ones.
        F.when(F.col("seq") % 19 == 0, F.concat("date_heure", F.lit("+02:00")))
        .when(F.col("seq") % 23 == 0, F.substring("date_heure", 1, 7))
        .when(F.col("seq") % 29 == 0, F.lit("garbage"))
        .otherwise(F.col("date_heure"))
        .alias("date_heure"),
    )
    return _shown(tables.parse_time(texts))


@job
def export_json(spark, d):
    rows = v.readings(spark, d).select("device_id", "seq", "socPercent", "wattsOut", "wattsIn")
    return tables.export_json(rows)


# Projections


@job
def default_missing(spark, d):
    rows = documents.default_missing(documents.parsed_states(v.state_raw(spark, d)))
    return rows.select("seq", "whOut", "wattsOut", "wattsIn", "temperature", "timeToEmptyFull")


@job
def port_states(spark, d):
    rows = documents.port_states(v.state_raw(spark, d))
    return rows.select("seq", "ac", "usb", "12v", "ac_on", "usb_on", "12v_on")


@job
def charge_profile(spark, d):
    return documents.charge_profile(v.state_raw(spark, d)).select("seq", "min", "max", "re")


@job
def classify_profile(spark, d):
    profiles = documents.charge_profile(v.state_raw(spark, d))
    return display.classify_profile(profiles).select("seq", "profile")


@job
def format_time_left(spark, d):
    rows = v.readings(spark, d).withColumn("connected", F.col("seq") % 10 != 0)
    rows = rows.withColumn("timeToEmptyFull", F.col("timeToEmptyFull") * F.lit(-1.5))
    return display.format_time_left(rows, connected="connected").select("seq", "time_left")


@job
def charge_direction(spark, d):
    rows = v.readings(spark, d).withColumn("connected", F.col("seq") % 10 != 0)
    return display.charge_direction(rows, connected="connected").select("seq", "direction")


def _chart(spark, d, period):
    rows = display.chart_series(v.readings(spark, d), period)
    return rows.select("seq", "label", "chart_watts_out", "chart_temp", "chart_watts_in")


@job
def chart_series(spark, d):
    return _chart(spark, d, "hour")


@job
def chart_series_day(spark, d):
    return _chart(spark, d, "day")


@job
def chart_series_month(spark, d):
    return _chart(spark, d, "month")


@job
def null_to_zero(spark, d):
    rolled = rollups.bucket_averages(v.readings(spark, d), "date_hour", ["device_id"])
    return _shown(display.null_to_zero(rolled, ["avg_watts_out", "avg_temp", "avg_watts_in"]))


@job
def display_round(spark, d):
    rows = v.readings(spark, d).select("seq", "wattsOut", "whOut", "ampsOut")
    return display.display_round(rows, {"wattsOut": 1, "whOut": 2, "ampsOut": "watts"})


@job
def time_keys(spark, d):
    rows = timekeys.time_keys(v.readings(spark, d))
    return rows.select(
        "seq", "hour_of_day", "date_hour", "day", "week", "year_month", "month_label"
    )


@job
def time_keys_years(spark, d):
    rows = timekeys.time_keys(v.monthly(spark, d))
    return rows.select("seq", "week", "day", "year_month", "month_label")


@job
def period_key(spark, d):
    rolled = rollups.bucket_averages(v.monthly(spark, d), "month")
    return periods.period_key(rolled, "month").select("periode", "key")


@job
def period_key_hour(spark, d):
    rolled = rollups.rollup(v.readings(spark, d), "hour", v.DAY)
    return periods.period_key(rolled, "hour", v.DAY).select("periode", "key")


@job
def rated_utilisation(spark, d):
    charged = v.monthly(spark, d).withColumn("socPercent", F.col("seq") % 130)
    rows = display.rated_utilisation(charged)
    names = [c for c in rows.columns if c.endswith("_share")]
    return _shown(rows.select("seq", *names))


@job
def poll_success(spark, d):
    polls = documents.poll_success(v.poll_attempts(spark, d), "dashboard", "ok_dashboard")
    polls = documents.poll_success(polls, "logger", "ok_logger")
    return polls.select("seq", "ok_dashboard", "ok_logger")


# Filters

_POINT = ("device_id", "seq", "wattsOut")


@job
def lookback(spark, d):
    return periods.lookback(v.readings(spark, d), v.AS_OF, 24, "hours").select(*_POINT)


@job
def lookback_exact(spark, d):
    rows = v.readings(spark, d)
    return periods.lookback(rows, v.AS_OF, 7, "days", mode="exact").select(*_POINT)


@job
def lookback_months(spark, d):
    return periods.lookback(v.monthly(spark, d), v.AS_OF_MONTHS, 6, "months").select(*_POINT)


@job
def on_day(spark, d):
    return periods.on_day(v.readings(spark, d), v.DAY).select(*_POINT)


@job
def in_week(spark, d):
    return periods.in_week(v.readings(spark, d), v.WEEK).select(*_POINT)


@job
def in_week_zero(spark, d):
    return periods.in_week(v.monthly(spark, d), "1999-W00").select(*_POINT)


@job
def in_months(spark, d):
    return periods.in_months(v.monthly(spark, d), v.MONTHS).select(*_POINT)


@job
def in_hour(spark, d):
    return periods.in_hour(v.readings(spark, d), v.HOUR).select(*_POINT)


@job
def select_period(spark, d):
    return periods.select_period(v.readings(spark, d), "day", as_of=v.AS_OF).select(*_POINT)


# Aggregations


@job
def rollup_hour_of_day(spark, d):
    return _shown(rollups.rollup(v.readings(spark, d), "hour", v.DAY))


@job
def rollup_date_hour(spark, d):
    return _shown(rollups.rollup(v.readings(spark, d), "hour", as_of=v.AS_OF))


@job
def rollup_day_in_week(spark, d):
    return _shown(rollups.rollup(v.readings(spark, d), "day", v.WEEK))


@job
def rollup_day_7d(spark, d):
    return _shown(rollups.rollup(v.readings(spark, d), "day", as_of=v.AS_OF))


@job
def rollup_month_selected(spark, d):
    return _shown(rollups.rollup(v.monthly(spark, d), "month", v.MONTHS))


@job
def rollup_month_6m(spark, d):
    return _shown(rollups.rollup(v.monthly(spark, d), "month", as_of=v.AS_OF_MONTHS))


@job
def rollup_device_hours(spark, d):
    return _shown(rollups.bucket_averages(v.readings(spark, d), "date_hour", ["device_id"]))


@job
def minmax_raw(spark, d):
    return rollups.minmax_raw(periods.on_day(v.readings(spark, d), v.DAY))


@job
def minmax_raw_device(spark, d):
    return rollups.minmax_raw(v.readings(spark, d), ["device_id"])


@job
def minmax_hourly(spark, d):
    return rollups.minmax_hourly(periods.in_week(v.readings(spark, d), v.WEEK))


@job
def minmax_daily(spark, d):
    rows = periods.select_period(v.monthly(spark, d), "month", as_of=v.AS_OF_MONTHS)
    return rollups.minmax_daily(rows)


@job
def mean_of_buckets(spark, d):
    rolled = rollups.rollup(v.readings(spark, d), "hour", v.DAY)
    return _shown(rollups.mean_of_buckets(rolled))


@job
def mean_of_buckets_device(spark, d):
    keys = ["device_id"]
    rolled = rollups.bucket_averages(v.readings(spark, d), "day", keys)
    return _shown(rollups.mean_of_buckets(rolled, keys))


@job
def stats_24h(spark, d):
    return _shown(rollups.stats_24h(v.readings(spark, d), v.AS_OF))


@job
def stats_24h_device(spark, d):
    return _shown(rollups.stats_24h(v.readings(spark, d), v.AS_OF, ["device_id"]))


def _polls(spark, d):
    return documents.poll_success(v.poll_attempts(spark, d))


@job
def failure_runs(spark, d):
    return _shown(outages.failure_runs(_polls(spark, d)))


# Distinct, sort, top


@job
def available_dates(spark, d):
    return keylists.available_dates(v.readings(spark, d))


@job
def available_weeks(spark, d):
    return keylists.available_weeks(v.monthly(spark, d))


@job
def available_months(spark, d):
    return keylists.available_months(v.monthly(spark, d))


@job
def latest_reading(spark, d):
    return _shown(latest.latest_reading(v.readings(spark, d)))


@job
def latest_reading_device(spark, d):
    return _shown(latest.latest_reading(v.readings(spark, d), ["device_id"]))


@job
def latest_of_newest_day(spark, d):
    path = working_dir(spark, "readings")
    tables.append_readings(v.readings(spark, d), path)
    return _shown(latest.latest_reading(latest.newest_day(tables.read_logs(spark, path))))


@job
def current_stats(spark, d):
    # A failed poll leaves no reading.
    readings = v.readings_of(v.events(spark, d).where("event_type <> 'error'"))
    return _shown(latest.current_stats(readings, _polls(spark, d), ["device_id"]))


@job
def ordered_series(spark, d):
    return _shown(latest.ordered_series(v.readings(spark, d), "day", v.WEEK))


@job
def label_order(spark, d):
    rolled = rollups.rollup(v.monthly(spark, d), "month", v.MONTHS)
    return _shown(rollups.label_order(rolled))


@job
def failure_runs_by_hour(spark, d):
    # The same runs from slices of an hour.
    runs = outages.failure_runs(_polls(spark, d), seconds=3600)
    return _shown(runs)


@job
def active_config(spark, d):
    return config_log.active_config(v.config_changes(spark, d), v.readings(spark, d))


@job
def config_from_polls(spark, d):
    polls = _polls(spark, d).withColumn("mode", v.mode_of(F.col("device_id")))
    return _shown(config_log.config_from_polls(polls))


# Table changes


def _after_delete(spark, d, period, key, source=v.readings):
    path = working_dir(spark, "readings")
    tables.append_readings(source(spark, d), path)
    removed = retention.delete_period(spark, path, period, key)
    left = tables.read_logs(spark, path)
    return left.select(*_POINT, F.lit(removed).cast("bigint").alias("removed"))


@job
def delete_hour(spark, d):
    return _after_delete(spark, d, "hour", v.HOUR)


@job
def delete_day(spark, d):
    return _after_delete(spark, d, "day", v.DAY)


@job
def delete_month(spark, d):
    return _after_delete(spark, d, "month", v.MONTH, v.over_two_months)


@job
def survivors(spark, d):
    return retention.survivors(v.monthly(spark, d), "month", v.ONE_MONTH).select(*_POINT)


@job
def fold_config(spark, d):
    return _shown(config_log.fold_config(v.config_changes(spark, d)))


@job
def fold_config_ip(spark, d):
    return config_log.fold_config_ip(v.config_changes(spark, d))


@job
def fold_config_ip_any_mode(spark, d):
    return config_log.fold_config_ip(v.config_changes(spark, d), fixed=frozenset())


# Composite


@job
def summary(spark, d):
    return _shown(rollups.summary(v.readings(spark, d), "hour", v.DAY))


@job
def summary_day(spark, d):
    return _shown(rollups.summary(v.readings(spark, d), "day", as_of=v.AS_OF))


@job
def summary_month(spark, d):
    return _shown(rollups.summary(v.monthly(spark, d), "month", as_of=v.AS_OF_MONTHS))


@job
def summary_device(spark, d):
    return _shown(rollups.summary(v.readings(spark, d), "day", v.WEEK, keys=["device_id"]))


def _view(spark, d):
    return plan_dashboard(v.readings(spark, d), "day", v.WEEK)


@job
def dashboard(spark, d):
    parts = _view(spark, d)
    return _shown(parts["table"].withColumn("title", F.lit(parts["title"])))


@job
def dashboard_table(spark, d):
    # As it is shown: 0 for a bucket without a value, one decimal.
    parts = plan_dashboard(v.readings(spark, d), "hour", as_of=v.AS_OF)
    table = display.null_to_zero(parts["table"], display.TABLE_ROUNDING)
    return display.display_round(_shown(table), display.TABLE_ROUNDING)


@job
def dashboard_summary(spark, d):
    return _shown(_view(spark, d)["summary"])


@job
def dashboard_series(spark, d):
    return _view(spark, d)["series"]


@job
def dashboard_latest(spark, d):
    return _shown(_view(spark, d)["latest"])


@job
def dashboard_dates(spark, d):
    return _view(spark, d)["dates"]


@job
def dashboard_months(spark, d):
    return _view(spark, d)["months"]


@job
def dashboard_weeks(spark, d):
    return _view(spark, d)["weeks"]


# The hourly table


def _hourly(spark, d):
    path = working_dir(spark, "hourly")
    hours.write_hourly(hours.hourly_table(v.readings(spark, d), ["device_id"]), path)
    return spark.read.parquet(path)


@job
def hourly_table(spark, d):
    return _shown(hours.hourly_table(v.readings(spark, d), ["device_id"]))


@job
def hourly_rollup_day(spark, d):
    return _shown(hours.rollup_from_hourly(_hourly(spark, d), "day", v.WEEK))


@job
def hourly_summary(spark, d):
    return _shown(hours.summary_from_hourly(_hourly(spark, d), "day", as_of=v.AS_OF))


@job
def hourly_stats(spark, d):
    return _shown(hours.stats_from_hourly(_hourly(spark, d), v.AS_OF, ["device_id"]))


# Streams

_ONCE = {"availableNow": True}


_PARTS = 4


def _followed(spark, d, label, start):
    """Run a stream over ``events`` in four parts, each with events of the whole month.

    A part is one micro-batch, so polls and readings come out of order. The
    stream is stopped after two of them and started again from its checkpoint. ``start``
    takes the stream, the folder to write and the checkpoint; gives the folder.
    """
    events = v.events(spark, d)
    landing, path, checkpoint = (
        working_dir(spark, f"{label}{part}") for part in ("-landing", "", "-checkpoint")
    )
    in_part = F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(_PARTS))
    for parts in ((0, 1), (2, 3)):
        for k in parts:
            events.where(in_part == k).write.parquet(f"{landing}/part={k}")
        files = len(spark.read.parquet(f"{landing}/part={parts[0]}").inputFiles())
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
        source = source.option("recursiveFileLookup", "true").parquet(landing)
        start(source, path, checkpoint).awaitTermination()
    return path


def _ingested(spark, d, label):
    def start(events, path, checkpoint):
        return ingest.stream_ingest(v.state_raw_of(events), path, checkpoint, _ONCE)

    return _followed(spark, d, label, start)


def _kept(spark, path):
    return _shown(tables.read_logs(spark, path).select("device_id", "seq", *MEASURES, "log_date"))


@job
def stream_ingest(spark, d):
    return _kept(spark, _ingested(spark, d, "ingest"))


@job
def stream_compact(spark, d):
    # The stream's table, read after its dates are one piece each.
    path = _ingested(spark, d, "compact")
    tables.readings_table(spark, path).compact()
    return _kept(spark, path)


@job
def stream_latest_device(spark, d):
    # The newest reading of each device by the index of the stream's table.
    path = _ingested(spark, d, "devices")
    return _shown(device_index.latest_by_device(spark, path))


@job
def stream_delete_day(spark, d):
    # A day and an hour removed from the stream's table, and a part of it appended again.
    path = _ingested(spark, d, "removal")
    retention.delete_period(spark, path, "day", v.DAY)
    retention.delete_period(spark, path, "hour", v.NEXT_HOUR)
    again = documents.read_state(v.state_raw(spark, d)).where(F.col("log_date") == v.DAY)
    again = again.where(F.col("seq") % 2 == 0)
    for _ in range(2):
        tables.append_readings(again, path, "again", 0)
    return _kept(spark, path)


def _hours_followed(spark, d, label):
    def start(events, path, checkpoint):
        readings = v.readings_of(events)
        # Pieces are merged in pairs, so that four batches reach the second tier.
        return windows.write_hours(readings, path, checkpoint, _ONCE, fan_out=2)

    return windows.read_hours(spark, _followed(spark, d, label, start))


@job
def stream_rollup_hour(spark, d):
    return _shown(_hours_followed(spark, d, "rollup"))


@job
def stream_stats_24h(spark, d):
    return _shown(windows.stats_of_hours(_hours_followed(spark, d, "stats")))


@job
def stream_latest(spark, d):
    def start(events, path, checkpoint):
        return live.write_latest(v.readings_of(events), path, checkpoint, _ONCE)

    return _shown(live.read_latest(spark, _followed(spark, d, "latest", start)))


def _polls_followed(spark, d, label):
    def start(events, path, checkpoint):
        polls = documents.poll_success(v.attempts_of(events))
        return outage_log.write_polls(polls, path, checkpoint, _ONCE)

    return _followed(spark, d, label, start)


@job
def stream_outage(spark, d):
    return _shown(outage_log.read_outage_events(spark, _polls_followed(spark, d, "outage")))


@job
def stream_outage_runs(spark, d):
    runs = outage_log.read_outages(spark, _polls_followed(spark, d, "outages"))
    return _shown(runs.drop("is_open"))
