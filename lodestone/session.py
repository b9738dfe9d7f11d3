"""Session helpers shared by scripts, tests and operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and single-machine runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, which every executor can reach.

    Only on one machine that names no such folder (tests) is a local temporary one set; a
    cluster without one is an error, since no folder of the driver's would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, once per application, wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent.parent
    context.addPyFile(shutil.make_archive(f"{folder}/lodestone", "zip", root, "lodestone"))
    context._lodestone_shipped = True


def kept(df: DataFrame, kind: str) -> DataFrame:
    """The rows written once to the shared folder and read from there."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """The rows over all cores: a small file of one row group would be read and worked on by one
    task. Larger tables come in many splits and stay as they are; only partitions differ."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= small else df
