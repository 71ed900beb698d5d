"""Outages as polls come in.

A run of failures depends on the order of a device's polls, so a late one can split a run
or join two. The stream keeps two tables. ``polls`` has the outcome of every poll, some 25
bytes each, by date. ``days`` has what tells a device's day without its polls: its open
and long stretches and its events. A batch works out anew the days of the devices which it
touches, from their polls, and no others; the newest state of a day counts. Reading joins
the states up over days. Any order of arrival gives the answer of the polls in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltfleet.operators.outages import STATE, day_states, events_of_states, runs_of_stretches
from voltfleet.schema import OUTAGE_THRESHOLD
from voltfleet.sources.manifest import FAN_OUT, Table
from voltfleet.sources.tables import by_date

_POLLS = "device_id bigint, ts timestamp_ntz, seq bigint, ok boolean, log_date date"
_DAYS = f"device_id bigint, day date, made bigint, {STATE}"


def polls_table(spark: SparkSession, path: str, fan_out: int = FAN_OUT) -> Table:
    """The outcome of every poll."""
    return Table(spark, f"{path}/polls", _POLLS, layout=by_date, fan_out=fan_out)


def days_table(spark: SparkSession, path: str, fan_out: int = FAN_OUT) -> Table:
    """The states of days, a few rows each, not cut by date; merges keep the newest of each."""
    return Table(spark, f"{path}/days", _DAYS, _newest, fan_out=fan_out)


def _newest(states: DataFrame) -> DataFrame:
    """Of each device and day the rows which were made last."""
    of_day = Window.partitionBy("device_id", "day")
    latest = states.withColumn("latest", F.max("made").over(of_day))
    return latest.where("made = latest").drop("latest")


def write_polls(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    threshold: int = OUTAGE_THRESHOLD,
    fan_out: int = FAN_OUT,
) -> StreamingQuery:
    """Keep polls with a time (``device_id, ts, seq, ok``) and the states of their days.

    ``threshold`` is the number of failures in a row which make an outage. A batch that is
    run again adds no poll and makes the same states.
    """

    def save(rows: DataFrame, batch: int) -> None:
        keep_polls(rows, path, checkpoint, batch, threshold, fan_out)

    return (
        attempts.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"processingTime": "300 seconds"}))
        .start()
    )


def keep_polls(
    rows: DataFrame,
    path: str,
    writer: str,
    batch: int,
    threshold: int = OUTAGE_THRESHOLD,
    fan_out: int = FAN_OUT,
) -> None:
    """Take one batch of polls in."""
    spark = rows.sparkSession
    polls, days = polls_table(spark, path, fan_out), days_table(spark, path, fan_out)
    if days.version().writers.get(writer, -1) >= batch:
        return
    new = rows.where(F.col("ts").isNotNull()).select(
        "device_id", "ts", "seq", "ok", F.to_date("ts").alias("log_date")
    )
    new = new.persist()
    try:
        polls.append(new, writer, batch)
        version = polls.version()
        states = day_states(touched_polls(polls.read(version), new), threshold)
        made = states.select(
            "*", F.lit(version.number).cast("long").alias("made"),
            F.date_from_unix_date("slice").alias("day"),
        )
        days.append(made, writer, batch)
    finally:
        new.unpersist()


def touched_polls(polls: DataFrame, new: DataFrame) -> DataFrame:
    """All polls of the devices and days which ``new`` has polls of.

    The dates, of which there are few, prune folders; the span of the devices prunes within
    files, which are sorted by device; the join leaves the devices themselves.
    """
    seen = new.agg(F.collect_set("log_date"), F.min("device_id"), F.max("device_id")).first()
    near = F.col("device_id").between(seen[1], seen[2]) | F.col("device_id").isNull()
    days = new.select(F.col("device_id").alias("d"), F.col("log_date").alias("day")).distinct()
    same = F.col("device_id").eqNullSafe(F.col("d")) & (F.col("log_date") == F.col("day"))
    return polls.where(F.col("log_date").isin(seen[0]) & near).join(days, same, "left_semi")


def read_polls(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The polls so far, or those from a date on, which prunes the days before."""
    dates = None if since is None else lambda day: day >= since
    return polls_table(spark, path).read(dates=dates)


def _states(spark: SparkSession, path: str) -> DataFrame:
    states = _newest(days_table(spark, path).read())
    return states.withColumn("slice", F.unix_date("day"))


def _parts(states: DataFrame) -> DataFrame:
    return states.where("kind = 'stretch'").select(
        "device_id", "slice", "stretch", "last_stretch", "n", "start", "end"
    )


def read_outages(
    spark: SparkSession, path: str, threshold: int = OUTAGE_THRESHOLD, since: str | None = None
) -> DataFrame:
    """All outages so far, and whether they go on; no rows before the first batch.

    With ``since`` those which end on that date or later, with what they had before.
    ``threshold`` is not less than the one which the polls were kept with.
    """
    runs = runs_of_stretches(_parts(_states(spark, path)), None, threshold)
    runs = runs.where(F.col("n") >= threshold)
    return runs if since is None else runs.where(F.to_date("end") >= F.lit(since).cast("date"))


def read_outage_events(
    spark: SparkSession, path: str, threshold: int = OUTAGE_THRESHOLD, since: str | None = None
) -> DataFrame:
    """The alerts and recoveries so far, or those from a date on.

    A run which began before that date is carried in from the states of the days before.
    """
    states = _states(spark, path)
    shown = states.where("kind <> 'stretch'")
    if since is not None:
        shown = shown.where(F.col("day") >= F.lit(since).cast("date"))
    return events_of_states(shown, _parts(states), threshold)
