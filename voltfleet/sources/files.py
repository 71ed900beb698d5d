"""Small files and folders of the shared file system, through Hadoop's interface.

Spark has no call of its own for these; every other module goes through this one.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder with the time of their last change in ms; none if there is no folder."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)}


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless there is one of that name; whether it was written.

    The file is written aside and renamed without overwriting, as Spark's streams commit
    their batches: of several writers, one succeeds.
    """
    folder, _, name = path.rpartition("/")
    aside, fs = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(aside, hadoop.Path(path), no_options)
    except Py4JJavaError as error:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
