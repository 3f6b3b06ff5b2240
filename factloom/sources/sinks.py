"""Sinks: write-once artifacts, appended records, partitioned and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.ingest import first_wins


def write_artifacts(artifacts: DataFrame, path: str) -> DataFrame:
    """Append artifacts that are not stored yet, by the first bytes of their digest; returns conflicts.

    Keys that come with another digest than the stored or first one are returned and not written. This
    is for one writer at a time; where several may write, ``commits.put_artifacts`` lets one of them win.
    """
    spark = artifacts.sparkSession
    try:
        stored = spark.read.parquet(path).select("artifact_id", F.col("sha256").alias("stored"))
    except Exception as missing:  # the first write finds no folder
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], "artifact_id string, stored string")
    first = first_wins(artifacts, "artifact_id", "sha256").select("artifact_id", F.col("sha256").alias("first"))
    judged = artifacts.join(stored, "artifact_id", "left").join(first, "artifact_id")
    conflicts = judged.filter(F.col("sha256") != F.coalesce("stored", "first")).select("artifact_id", "sha256", F.coalesce("stored", "first").alias("kept"))
    fresh = first_wins(artifacts, "artifact_id", "sha256").join(stored.select("artifact_id"), "artifact_id", "left_anti")
    placed = fresh.withColumn("d1", F.substring("sha256", 1, 2)).withColumn("d2", F.substring("sha256", 3, 2))
    placed.write.mode("append").partitionBy("d1", "d2").parquet(path)
    return conflicts


def append_run(parts: dict[str, DataFrame], folder: str) -> None:
    """Append one run's tables, each to its own folder; Spark's commit makes each append whole.

    ``commits.record_run`` makes all of them one commit.
    """
    for name, rows in parts.items():
        rows.write.mode("append").parquet(f"{folder}/{name}")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)
