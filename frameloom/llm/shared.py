"""Places and helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is a
    local one, as in tests, a temporary folder of this machine is set and used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", "")
        if not told and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or f"file://{tempfile.gettempdir()}/frameloom-shared")
    return spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, with the scheme by which Spark finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/frameloom/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, read back from the shared folder from now on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table below the shared folder, and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI, for files that executors write."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, content: bytes) -> None:
    """Write a file whole or not at all: a retried task replaces what an earlier one left."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, path)


def slot(slots: int = 64) -> Column:
    """A number that splits a hot key's rows; use it on rows that are then checkpointed."""
    return F.pmod(F.spark_partition_id(), F.lit(slots))


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to found, which has one row for each key; rows has a column ``slot``.

    However many rows share a key, its value is first brought to one row for each slot,
    so the join with the rows meets at most a slot's share of them in one task.
    """
    told = rows.select("slot", *keys).distinct().join(found, keys, how)
    return rows.join(told, ["slot", *keys])
