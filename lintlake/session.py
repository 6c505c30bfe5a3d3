"""Session helpers: table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only in local mode, as in tests, may the setting be empty: a folder of this machine is made and set. On a cluster
    executors would each write to and read from their own disks, so it has to be set there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lintlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a written table in the shared folder, in a folder of this application (see `clear_scratch`)."""
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lintlake-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables this application wrote to the shared folder.

    Results of queries read them, so this is for when the results have been collected or written.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, heavy_columns: tuple[str, ...] = ()) -> DataFrame:
    """Even out an input of few splits before per-row Python work.

    An input with at least two splits a core is left alone, so a large table is never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as a table in the shared folder and read again: cut lineage, columns pruned on reading."""
    at = scratch_path(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, but in local mode where its folder is on PYTHONPATH or the working folder.

    The archive is made by the driver and served by it, once per application.
    """
    package = Path(__file__).resolve().parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd().resolve()]
    context = spark.sparkContext
    if is_local(spark) and package.parent in known or getattr(context, "_lintlake_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lintlake-"), package.name), "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._lintlake_shipped = True
