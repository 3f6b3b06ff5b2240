"""Tables of a job in the shared folder: written once, read back, so that a plan used twice is run once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for this call below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and return a scan of it; lost executors cost a rerun of tasks only."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # ids are hex, which snappy leaves as it is
    return df.sparkSession.read.schema(df.schema).parquet(path)
