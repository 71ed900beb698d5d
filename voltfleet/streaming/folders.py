"""Tables which a stream writes batch by batch.

Each micro-batch is appended to a table with a manifest under its own number, so one which is
run again after a failure neither loses nor doubles a row. Rows are such that pieces can be put
together in any order: whatever comes late, in whichever batch, counts like any other row.
Pieces are merged in tiers as they add up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voltfleet.sources.manifest import Step, Table

Opened = Callable[[SparkSession], Table]


def write_table(
    stream: DataFrame, opened: Opened, checkpoint: str, part: Step, trigger: dict
) -> StreamingQuery:
    """Append ``part`` of each micro-batch to the table; the checkpoint names the writer."""

    def save(rows: DataFrame, batch: int) -> None:
        opened(rows.sparkSession).append(part(rows), checkpoint, batch)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**trigger)
        .start()
    )


def key_schema(keys, schema) -> str:
    """Keys of the reading table as the start of a schema text."""
    return "".join(f"{k} {schema[k].dataType.simpleString()}, " for k in keys)
