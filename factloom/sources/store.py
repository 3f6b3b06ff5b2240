"""Reads of stored artifacts and records: verified against their digest, pruned by key, by existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys (artifact_id, sha256) with what is stored under them; folders of other digests are not read."""
    keys = wanted.select("artifact_id", F.lower("sha256").alias("declared")).distinct()
    keys = keys.withColumn("d1", F.substring("declared", 1, 2)).withColumn("d2", F.substring("declared", 3, 2))
    held = stored.select("artifact_id", F.col("sha256").alias("held"), "content", "d1", "d2")
    return keys.join(held, ["artifact_id", "d1", "d2"], "left")


def verified(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(artifact_id, sha256, actual, status, content) of wanted keys: ok, missing, or mismatch if the bytes have another digest.

    Content comes only with the status ok; what does not hold is a row, not an error.
    """
    found = by_key(stored, wanted).withColumn("actual", F.sha2("content", 256))
    status = F.when(F.col("held").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("declared")), "ok").otherwise("mismatch")
    return found.select("artifact_id", F.col("declared").alias("sha256"), "actual", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def one(stored: DataFrame, artifact_id: str, sha256: str) -> DataFrame:
    """The row of one key, read from the folder of its digest only."""
    digest = sha256.lower()
    return stored.filter((F.col("d1") == digest[:2]) & (F.col("d2") == digest[2:4]) & (F.col("artifact_id") == artifact_id) & (F.col("sha256") == digest))


def existing(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys (artifact_id, sha256) that are stored; contents are not read."""
    held = stored.select("artifact_id", "sha256")
    return wanted.join(held, ["artifact_id", "sha256"], "left_semi")


def record_of(records: DataFrame, key: str, value: str | int) -> DataFrame:
    """The records with this key; the filter reaches the scan. A run, its observations or a session by id."""
    return records.filter(F.col(key) == F.lit(value))


def with_surface(regions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Regions with the surface that their artifact shows; UNKNOWN where none is known."""
    known = surfaces.groupBy("artifact_id").agg(F.min("surface").alias("surface"))
    return regions.join(known, "artifact_id", "left").withColumn("surface", F.coalesce("surface", F.lit("UNKNOWN")))


def stored_status(found: Column) -> Column:
    """HTTP-like status of a verified read."""
    return F.when(found == "ok", 200).when(found == "missing", 404).otherwise(502)
