"""Removal of the readings of an hour, a day or a month."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltfleet.operators.periods import (
    between,
    check_period,
    day_span,
    hour_span,
    month_span,
    on_dates,
)
from voltfleet.schema import READINGS
from voltfleet.sources import files
from voltfleet.sources.manifest import Table, is_table
from voltfleet.sources.tables import by_date, refuse_stream_table


def _span(period: str, key: str) -> tuple[date | datetime, date | datetime]:
    check_period(period)
    return {"hour": hour_span, "day": day_span, "month": month_span}[period](key)


def _doomed(period: str, key: str) -> Column:
    # A row without a time matches no period and is kept.
    return F.coalesce(between(*_span(period, key)), F.lit(False))


def survivors(df: DataFrame, period: str, key: str) -> DataFrame:
    """The readings left when those of the period are removed."""
    return df.where(~_doomed(period, key))


def delete_to_snapshot(
    spark: SparkSession,
    path: str,
    snapshot: str,
    period: str,
    key: str,
    schema: StructType = READINGS,
) -> int:
    """Write the survivors of the whole table to a new folder; the number removed.

    The old table is left alone, so a lost driver costs nothing. Use it for a table
    written by a stream, whose file list must not change behind its back.
    """
    if is_table(spark, path):
        table = Table(spark, path, schema).read()
    else:
        table = spark.read.schema(schema).parquet(path)
    removed = table.where(between(*_span(period, key))).count()
    (
        by_date(survivors(table, period, key))
        .write.mode("errorifexists")
        .partitionBy("log_date")
        .parquet(snapshot)
    )
    return removed


def delete_period(
    spark: SparkSession, path: str, period: str, key: str, schema: StructType = READINGS
) -> int:
    """Remove the readings of a period from the table; the number removed.

    Only the dates of the period are read: one, or those of a month. On a table with a
    manifest, which a stream may be writing, this counts the rows and puts a marker that
    readers apply and the next merge folds in; a lost driver leaves either all or nothing of
    it, and readings appended meanwhile stay.

    A plain folder, such as the hourly table, is changed in place: a date which
    keeps some rows is rewritten, a date which keeps none is dropped, since a dynamic
    overwrite without rows would leave it as it was. A folder with the file list of a
    stream is refused; use :func:`delete_to_snapshot`. With its own ``schema`` the
    hourly table takes the same call.
    """
    if is_table(spark, path):
        return Table(spark, path, schema, layout=by_date).remove(*_span(period, key))
    refuse_stream_table(spark, path)
    if period == "hour":
        dates, doomed = day_span(key[:10]), _doomed(period, key)
    else:
        # Whole dates go, so that only their row counts are read.
        dates, doomed = _span(period, key), F.lit(True)
    touched = spark.read.schema(schema).parquet(path).where(on_dates(*dates))
    # At most one row per date of a month.
    counts = (
        touched.groupBy("log_date")
        .agg(F.count_if(doomed).alias("removed"), F.count_if(~doomed).alias("kept"))
        .collect()
    )
    hit = [row for row in counts if row["removed"]]
    rewritten = [row["log_date"] for row in hit if row["kept"]]
    if rewritten:
        (
            by_date(touched.where(F.col("log_date").isin(rewritten) & ~doomed))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_date")
            .parquet(path)
        )
    for row in hit:
        if not row["kept"]:
            files.delete(spark, f"{path}/log_date={row['log_date']}")
    spark.catalog.refreshByPath(path)
    return sum(row["removed"] for row in hit)
