"""Words, lower case and shared tables, as all operators of this folder mean them."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voltfleet.session import working_dir

#: A word; ``bytes.split()`` splits UTF-8 text into the same words.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; letters beyond ASCII stay as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(slow)


LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    Later steps read files which outlive any executor, and never compute them anew.
    """
    path = working_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(each, schema)


def small_batches(
    batches: Iterator[pa.RecordBatch], size: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, or one row where that is longer.

    Keeps the output of a batch small where it is several times its input. After each batch
    its memory goes back to the system.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
            give_back()
    batch = None
    give_back()


def give_back() -> None:
    """Hand memory that is free again back to the system.

    Else Arrow and the C library keep what the largest batch so far took, in each Python
    worker for as long as it lives.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def arrow_schema(schema: str) -> pa.Schema:
    """A schema text as Arrow's schema; to be made on the driver and handed to tasks."""
    return to_arrow_schema(StructType.fromDDL(schema))
