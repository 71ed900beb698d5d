"""The given tables seen as telemetry.

``events`` covers one month and gives readings, documents, polls and changes of
settings; ``orders`` covers some years and gives readings for the monthly views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.schema import READINGS

AS_OF = "2024-01-30 12:00:00"
AS_OF_MONTHS = "2001-08-31 10:00:00"
DAY = "2024-01-15"
HOUR = "2024-01-15 09"
NEXT_HOUR = "2024-01-16 09"
WEEK = "2024-W03"
MONTH = "2024-01"
MONTHS = "2000-12,2001-01,2001-02"
ONE_MONTH = "2000-12"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def measures() -> dict[str, Column]:
    """The nine measures of an event."""
    event = F.col("event_id")
    watts_in = F.get_json_object("props", "$.k").cast("double")
    watts_in = F.when(watts_in != 0, watts_in)
    return {
        "whOut": F.col("value") - 100,
        "whStored": ((event % 101) * 15).cast("double"),
        "socPercent": (event % 101).cast("double"),
        "wattsOut": F.col("value"),
        "ampsOut": F.col("value") / 12,
        "wattsIn": watts_in,
        "ampsIn": watts_in / 12,
        "temperature": F.lit(20.0) + (event % 200) / 10.0,
        "timeToEmptyFull": F.when(event % 7 == 0, -1.0)
        .when(event % 11 == 0, F.lit(None))
        .otherwise((event % 9000).cast("double")),
    }


def readings_of(source: DataFrame) -> DataFrame:
    """Readings from events, batch or stream."""
    return source.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date_heure"),
        "ts",
        *[value.alias(name) for name, value in measures().items()],
        F.to_date("ts").alias("log_date"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(events(spark, sf_dir))


def over_two_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings fifteen days later, so that they fall into two months."""
    later = F.col("ts") + F.expr("INTERVAL 15 DAYS")
    return readings_of(events(spark, sf_dir).withColumn("ts", later))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from orders; the measures which orders cannot give are NULL."""
    order = F.col("o_orderkey")
    given = {
        "device_id": F.col("o_custkey"),
        "seq": order,
        "date_heure": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "ts": F.col("o_orderdate"),
        "wattsOut": F.col("o_totalprice"),
        "wattsIn": F.when(order % 50 != 0, (order % 50).cast("double")),
        "temperature": (order % 30 + 20).cast("double"),
        "log_date": F.to_date("o_orderdate"),
    }
    return orders(spark, sf_dir).select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in READINGS.fields
        ]
    )


def _payload() -> Column:
    """A device-state document: some fields absent, some null, some texts broken."""
    event = F.col("event_id")
    left_out, nulled = event % 13 == 0, event % 17 == 0
    given = measures()
    given["wattsOut"] = F.when(~nulled, given["wattsOut"])
    given["usbPortStatus"] = F.when(~nulled, event % 3)
    optional = {
        "acPortStatus": event % 2,
        "v12PortStatus": F.when(~left_out, event % 2),
        "whOut": F.when(~left_out, given.pop("whOut")),
        "temperature": F.when(~left_out, given.pop("temperature")),
    }

    def profile(low: int, high: int | None, resume: int) -> Column:
        members = {"min": low, "max": high, "re": resume}
        return F.struct(*[F.lit(v).cast("int").alias(k) for k, v in members.items()])

    kind = event % 5
    optional["chargeProfile"] = (
        F.when(kind == 0, profile(20, 85, 25))
        .when(kind == 1, profile(0, 100, 95))
        .when(kind == 2, profile(10, 90, 30))
        .when(kind == 4, profile(20, None, 25))
    )

    def document(fields: dict[str, Column], ignore_nulls: str) -> Column:
        members = F.struct(*[value.alias(name) for name, value in fields.items()])
        return F.to_json(members, {"ignoreNullFields": ignore_nulls})

    whole = F.concat(
        F.rtrim(document(given, "false"), F.lit("}")),
        F.lit(","),
        F.ltrim(document(optional, "true"), F.lit("{")),
    )
    return F.when(event % 97 == 0, F.lit("bad")).otherwise(whole)


def state_raw_of(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.lit(200).alias("status_code"),
        _payload().alias("payload"),
    )


def state_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_raw_of(events(spark, sf_dir))


def attempts_of(source: DataFrame) -> DataFrame:
    """Polls: an error event is a poll which failed."""
    failed = F.col("event_type") == "error"
    busy = F.col("event_id") % 2 == 1
    payload = F.when(failed & busy, F.lit('{"error":"busy"}')).when(~failed, _payload())
    return source.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(failed, 503).otherwise(200).alias("status_code"),
        payload.alias("payload"),
    )


def poll_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(events(spark, sf_dir))


def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return (
        events(spark, sf_dir)
        .where(F.col("event_type").isin("signup", "click"))
        .select(
            F.col("user_id").alias("device_id"),
            F.col("ts").alias("at"),
            event.alias("seq"),
            F.when(F.col("event_type") == "signup", "hotspot").otherwise("reseau").alias("mode"),
            F.when(event % 5 == 0, "")
            .otherwise(F.concat(F.lit("192.168.1."), (event % 250).cast("string")))
            .alias("ip"),
            (event % 3 != 0).alias("success"),
        )
    )


def mode_of(device: Column) -> Column:
    """The connection mode by which a device is polled."""
    return F.when(device % 3 == 0, "hotspot").otherwise("reseau")
