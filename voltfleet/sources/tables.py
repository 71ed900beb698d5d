"""The reading table: Parquet by ``log_date``, its live pieces named by a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.functions.timekeys import parse_local_time
from voltfleet.schema import READINGS
from voltfleet.sources import files
from voltfleet.sources.manifest import Table, is_table


def parse_time(df: DataFrame, text: str = "date_heure") -> DataFrame:
    """Add ``ts`` and ``log_date`` from the ISO text; both NULL where it is no local time."""
    return df.withColumn("ts", parse_local_time(F.col(text))).withColumn(
        "log_date", F.to_date("ts")
    )


def rejected_times(df: DataFrame, text: str = "date_heure") -> DataFrame:
    """Rows whose text is present but no local time, such as one with a zone offset."""
    return df.where(F.col(text).isNotNull() & parse_local_time(F.col(text)).isNull())


def readings_table(spark: SparkSession, path: str) -> Table:
    """The reading table at a path, to pin versions, compact or vacuum it."""
    return Table(spark, path, READINGS, layout=by_date)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scan the reading table with its fixed schema.

    The rows are those of the newest version at this moment, whatever is written later. A
    plain folder of Parquet files by ``log_date`` is read as it is.
    """
    if is_table(spark, path):
        return readings_table(spark, path).read()
    return spark.read.schema(READINGS).parquet(path)


def refuse_stream_table(spark: SparkSession, path: str) -> None:
    """Raise for a folder which a stream writes: its file list must not change unseen."""
    if files.exists(spark, f"{path}/_spark_metadata"):
        raise ValueError(f"{path} is written by a stream; write to another folder")


def by_date(df: DataFrame) -> DataFrame:
    """Lay rows out for a write which is partitioned by ``log_date``."""
    order = [c for c in ("log_date", "device_id", "ts") if c in df.columns]
    return df.hint("rebalance", "log_date").sortWithinPartitions(*order)


def append_readings(
    df: DataFrame, path: str, writer: str | None = None, batch: int = 0
) -> bool:
    """Append readings, columns matched by name; whether they were added.

    The rebalance hint gathers each date into few files and splits a date which
    holds too much for one task. Within a file rows go by device and time, so that a
    view of one device skips most pages. With a ``writer`` and the number of its
    ``batch``, a call that is run again adds nothing.
    """
    spark = df.sparkSession
    refuse_stream_table(spark, path)
    if not is_table(spark, path) and any(
        name.startswith("log_date=") for name in files.names(spark, path)
    ):
        raise ValueError(f"{path} holds plain files without a manifest; write to another folder")
    return readings_table(spark, path).append(df, writer, batch)


def export_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON record; a NULL stays in the record as null."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(record.alias(out))


def write_json(df: DataFrame, path: str) -> None:
    """Write the records of :func:`export_json` as JSON lines."""
    export_json(df).write.mode("errorifexists").text(path)
