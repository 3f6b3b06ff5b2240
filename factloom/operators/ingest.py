"""Ingest: idempotent inserts, integrity and limits, as anti-joins, windows and reason columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T

MAX_ARTIFACTS = 24
MAX_BYTES = 40 * 1024 * 1024


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: what an insert that ignores existing keys leaves."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the batch to append: keys that are not there yet, the first of each."""
    return first_wins(batch, key, order).join(existing.select(key), key, "left_anti")


def immutable_conflicts(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, digests): keys that came with different contents."""
    return rows.groupBy(key).agg(F.count_distinct(digest).alias("digests")).filter("digests > 1")


def object_key(artifact_id: Column, sha256: Column) -> Column:
    """Content-addressed path of an artifact."""
    return F.concat(F.lit("artifacts/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), artifact_id, F.lit("-"), sha256, F.lit(".bin"))


def upload_status(uploads: DataFrame, sessions: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """HTTP-like status of each upload: 422 ids or digest, 409 no session, 413 too large, 400 empty, 201.

    uploads: artifact_id, capture_session_id, content, sha256 (declared; null: not declared).
    """
    known = sessions.select("capture_session_id").distinct().withColumn("has_session", F.lit(True))
    actual = F.sha2("content", 256)
    status = (
        F.when(~T.valid_id(F.col("artifact_id")) | ~T.valid_id(F.col("capture_session_id")), 422)
        .when(F.col("has_session").isNull(), 409)
        .when(F.length("content") > max_bytes, 413)
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, 400)
        .when(F.lower("sha256") != actual, 422)
        .otherwise(201)
    )
    return uploads.join(known, "capture_session_id", "left").select("artifact_id", "capture_session_id", actual.alias("sha256"), status.alias("status"))


def job_artifacts(images: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Check of every artifact that a job lists: 409 if unknown, 422 if its digest differs, else 200."""
    stored = artifacts.select("artifact_id", F.col("sha256").alias("stored"))
    status = F.when(F.col("stored").isNull(), 409).when(F.lower("sha256") != F.col("stored"), 422).otherwise(200)
    return images.join(stored, "artifact_id", "left").select("job_id", "artifact_id", status.alias("status"))


def session_problems(images: DataFrame, max_artifacts: int = MAX_ARTIFACTS) -> DataFrame:
    """(job_id, problem) of jobs with a repeated artifact or too many."""
    sized = images.groupBy("job_id").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("d"))
    found = F.array(F.when(F.col("n") != F.col("d"), "artifact listed twice"), F.when(F.col("n") > max_artifacts, "too many artifacts"))
    return sized.select("job_id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def missing_context(*flags: str) -> Column:
    """Names of the flags without an answer; false is an answer."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), f) for f in flags]), lambda f: f.isNotNull())


def usable_lines(lines: DataFrame, least: float = 0.30) -> DataFrame:
    """Lines that say something and were read with some confidence; a missing one counts as a half."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    return lines.filter(F.trim("text") != "").withColumn("confidence", confidence).filter(F.col("confidence") >= least)


def job_status(quarantined: Column, has_snapshot: Column, all_retake: Column, coverage_complete: Column) -> Column:
    return (
        F.when(quarantined, "QUARANTINED").when(~has_snapshot, "EXTRACTION_ERROR").when(all_retake, "NEEDS_RECAPTURE")
        .when(~coverage_complete, "INCOMPLETE_EVIDENCE").otherwise("EXTRACTION_READY")
    )


def run_status(quarantined: Column, completed: Column) -> Column:
    return F.when(quarantined, "quarantined").when(completed, "completed").otherwise("failed")


def quarantine_queue(quarantined: DataFrame, limit: int = 100) -> DataFrame:
    """Unreviewed runs, oldest first; the limit is the feature."""
    return quarantined.filter(F.col("reviewed_at").isNull()).orderBy("quarantined_at", "run_id").limit(limit)


def transport_outcome(status: Column) -> Column:
    """What an upload's HTTP status means: null is a network failure."""
    return F.when(status.between(200, 299), "succeeded").when(status.isNull() | status.isin(408, 429) | (status >= 500), "retry").otherwise("permanent")


#: What a job's answer says.
HELD_BACK = "The generated snapshot did not pass contract validation and has been quarantined for engineering review. No snapshot was released."
COMPLETE = "Extraction complete. Fact statuses: "


def job_message(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run_id, message): a run's status counts (run_id, status, n) as one line, or that it is held back (runs: run_id, quarantined)."""
    parts = counts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("c"))
    told = F.array_join(F.transform("c", lambda x: F.format_string("%s=%d", x["status"], x["n"])), ", ")
    message = F.when(F.col("quarantined"), HELD_BACK).otherwise(F.concat(F.lit(COMPLETE), F.coalesce(F.nullif(told, F.lit("")), F.lit("none"))))
    return runs.join(parts, "run_id", "left").select("run_id", message.alias("message"))


def session_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts of every session in their order: place counts from 1, those without an index first."""
    order = W.partitionBy("capture_session_id").orderBy(F.col("sequence_index").asc_nulls_first(), "artifact_id")
    return artifacts.withColumn("place", F.row_number().over(order))


def without_retakes(artifacts: DataFrame, verdicts: DataFrame, skip: bool = False) -> DataFrame:
    """Artifacts to read: all, or with ``skip`` those that no quality verdict (artifact_id, verdict) sends back."""
    return artifacts.join(verdicts.filter("verdict = 'RETAKE'").select("artifact_id"), "artifact_id", "left_anti") if skip else artifacts


def quarantine_detail(runs: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Every quarantined run with the reason and problems that its record holds, reviewed or not."""
    held = quarantined.select("run_id", "reason", "problems", "quarantined_at", "reviewed_at")
    return runs.filter("status = 'quarantined'").join(held, "run_id", "left")


def extraction_job(products: DataFrame, images: DataFrame, steps: DataFrame) -> DataFrame:
    """(product_id, payload): the JSON that asks for a product's extraction.

    products: product_id, required, resolved, captured, complete. images: product_id, sequence_index,
    artifact_id, surface, sha256. steps: product_id, surface_id, status, skip_reason, skip_note.
    """
    entry = F.struct("sequence_index", "artifact_id", "surface", "sha256")
    listed = images.groupBy("product_id").agg(F.array_sort(F.collect_list(entry)).alias("images"))
    of = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("surface_id"))))
    skipped = F.array_sort(F.collect_list(F.when(F.col("status") == "skipped", F.struct("surface_id", F.col("skip_reason").alias("reason"), F.col("skip_note").alias("note")))))
    told = steps.groupBy("product_id").agg(of("pending").alias("unresolved"), skipped.alias("skipped"), of("capturedNeedsReview").alias("review"))
    joined = products.join(listed, "product_id", "left").join(told, "product_id", "left")
    covered = F.struct(
        F.col("required").alias("required_surfaces"), F.col("resolved").alias("resolved_surfaces"), F.col("captured").alias("captured_surfaces"), F.col("complete"),
        F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved_surfaces"), F.col("skipped").alias("skipped_surfaces"), F.col("review").alias("surfaces_needing_manual_review"),
    )
    body = F.struct(F.concat(F.lit("CS-"), F.col("product_id")).alias("capture_session_id"), F.concat(F.lit("PKG-"), F.col("product_id")).alias("package_id"), F.col("images"), covered.alias("coverage"))
    return joined.select("product_id", F.to_json(body).alias("payload"))
