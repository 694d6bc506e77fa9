"""Session and table helpers shared by every query module."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("frameloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it by PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in known) or getattr(spark.sparkContext, "_frameloom_sent", False):
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/frameloom_package", "zip", root, "frameloom"))
    spark.sparkContext._frameloom_sent = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, with the scheme by which Spark finds it.

    It lies in ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = f"file://{tempfile.gettempdir()}/frameloom-shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{told.rstrip('/')}/frameloom/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, read back from the shared folder from now on."""
    shared_folder(df.sparkSession, "unused")
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df, read back from a new shared folder, and that folder, which remove_folder() takes away when it isn't needed any more."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session made by shared_folder().

    One of a file system that is mounted here is deleted by this machine's calls, as Hadoop asks its file system several times for each file.
    """
    if path.startswith("file:/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
