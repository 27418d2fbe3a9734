"""Session helpers: a local session for tests and bench, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A single-node session; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("giurispark")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GIURISPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only on one machine, where it is unset, make one and drop it at the end."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            shared = tempfile.mkdtemp(prefix="giurispark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Materialise df once in the reliable checkpoint folder and go on from those files; release: the step's shuffle files go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if release:
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(name, None)
        spark.conf.set(name, "true")
        try:
            df = df.select("*")  # a frame takes the setting when it is made
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return df.checkpoint(eager=True)  # its files go with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy stages enough tasks when the scan yields fewer than the cluster has cores; large inputs pass unchanged."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)
