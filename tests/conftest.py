import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from voltfleet.schema import MEASURES, READINGS  # noqa: E402
from voltfleet.session import build_session  # noqa: E402
from voltfleet.sources.tables import parse_time  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def readings(spark):
    """Readings from dicts: `t` is the text of the time, the rest are measures."""

    def make(rows):
        table = [
            (
                row.get("device_id", 1),
                row.get("seq", i),
                row.get("t"),
                *[None if row.get(m) is None else float(row[m]) for m in MEASURES],
            )
            for i, row in enumerate(rows)
        ]
        schema = "device_id long, seq long, date_heure string, " + ", ".join(
            f"{m} double" for m in MEASURES
        )
        return parse_time(spark.createDataFrame(table, schema)).select(*READINGS.names)

    return make


@pytest.fixture(scope="session")
def polls(spark):
    """Polls from (device, second, ok)."""

    def make(rows):
        table = [(d, i, s, ok) for i, (d, s, ok) in enumerate(rows)]
        raw = spark.createDataFrame(table, "device_id long, seq long, s long, ok boolean")
        ts = F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz")
        return raw.withColumn("ts", ts).drop("s")

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
