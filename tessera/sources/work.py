"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folder from which this package is imported.
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it runs from a checkout that they see by the same path; else ship it with the job."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _work(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-held/{spark.sparkContext.applicationId}"


def clear_held(spark: SparkSession) -> None:
    """Deletes all that this application has held; call it once results are saved, as they read from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_path(spark: SparkSession, name: str) -> str:
    """A path of its own among what is held."""
    return f"{_work(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: what is built on it neither computes nor plans it again, and it outlives executors."""
    spark = df.sparkSession
    path = held_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
