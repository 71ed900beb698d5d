"""Continuous ingest of device-state documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from voltfleet.sources.documents import corrupt_states, read_state
from voltfleet.sources.tables import readings_table
from voltfleet.streaming.folders import write_table

# Fixed value: the poll interval of a device.
POLL_TRIGGER = {"processingTime": "300 seconds"}


def stream_ingest(
    raw_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Documents to the reading table, each exactly once.

    Every batch is one version of the table, which other writers may append to, remove from
    and compact meanwhile. ``trigger`` defaults to the poll interval of the devices.
    """
    return write_table(
        raw_stream,
        lambda spark: readings_table(spark, path),
        checkpoint,
        read_state,
        trigger or POLL_TRIGGER,
    )


def stream_corrupt(
    raw_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """The payloads which :func:`stream_ingest` leaves out, to a quarantine folder."""
    return (
        corrupt_states(raw_stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL_TRIGGER))
        .start()
    )
