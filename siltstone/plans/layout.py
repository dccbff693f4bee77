"""How inputs are spread over tasks."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files make fewer tasks than there are cores.

    A table of one row group is one task, however many cores wait.  Tables with more splits
    than cores, as on a cluster, are left as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, which only a
    session on one machine may leave unset; what it then writes goes when Python ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(folder or '/tmp/checkpoints').rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not folder:
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
