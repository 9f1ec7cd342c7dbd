"""Spark session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` where the cluster names one.

    A local master without it gets a private folder, removed when the driver ends. On any other master a folder of the
    driver's machine would not survive it, so that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="phraseworks-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def clear_checkpoints(spark: SparkSession) -> None:
    """Remove all checkpoints of this application, once no result that was read from them is needed any more.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes each by itself as soon as nothing refers to it.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(current.get())
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        for found in files.listStatus(path):
            files.delete(found.getPath(), True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so later stages neither recompute it nor depend on one executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def show_package_to_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it (clusters may ship it with ``--py-files`` instead)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_package_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
