"""Tables that a plan reads more than once, written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What operators take to keep a table: ``save(df, name)`` gives the table to read on from.
Save = Callable[[DataFrame, str], DataFrame]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset in local mode one of our own, on a cluster an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lectern-core")


def planned(df: DataFrame, name: str) -> DataFrame:
    """Keeps nothing: the table is planned again wherever it is read."""
    return df


def store(spark: SparkSession) -> Save:
    """Keeps tables as Parquet in a folder of its own, which outlives executors."""
    root = f"{shared_dir(spark)}/core-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
