"""Which versions made a run, stamped on the run and on every fact, and evaluation reports as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import attribution, quality, resolution

PIPELINE = "factloom-1"
#: Columns of a run's version row, in their order.
VERSIONS = (
    "pipeline_version", "normalizer_version", "attribution_version", "resolver_version", "quality_pipeline_version", "quality_policy_version", "quality_policy_calibrated", "ocr_engine",
    "ocr_model_id", "ocr_model_version",
)


def run_versions(runs: DataFrame, policies: DataFrame) -> DataFrame:
    """One row a run (run_id, ``VERSIONS``, lineage_id): what its result rests on; equal rows have equal lineage ids.

    runs: run_id, ocr_engine, ocr_model_id, ocr_model_version, policy_version. A policy that is not in
    the table, or not marked as calibrated, counts as uncalibrated.
    """
    known = policies.groupBy("policy_version").agg(F.bool_and("calibrated").alias("calibrated"))
    told = {
        "pipeline_version": F.lit(PIPELINE), "normalizer_version": F.lit(text.VERSION), "attribution_version": F.lit(attribution.VERSION), "resolver_version": F.lit(resolution.VERSION),
        "quality_pipeline_version": F.lit(quality.VERSION), "quality_policy_version": F.col("policy_version"), "quality_policy_calibrated": F.coalesce("calibrated", F.lit(False)),
        **{c: F.coalesce(c, F.lit("unknown")) for c in VERSIONS[-3:]},
    }
    made = runs.join(F.broadcast(known), "policy_version", "left").select("run_id", *[told[c].alias(c) for c in VERSIONS])
    return made.withColumn("lineage_id", text.prefixed_id("LIN-", *[F.col(c) for c in VERSIONS]))


def stamped(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts with the versions of their run; facts of unknown runs keep nulls, so that they can be told."""
    return facts.join(versions, "run_id", "left")


def uncalibrated(versions: DataFrame) -> DataFrame:
    """(run_id, quality_policy_version) of runs whose verdicts are advice only."""
    return versions.filter(~F.col("quality_policy_calibrated")).select("run_id", "quality_policy_version")


def changed_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(version, before, after, runs): versions that differ between two runs of the same packages (package_id, ``VERSIONS``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("version"), F.col(f"b.{c}").cast("string").alias("before"), F.col(f"a.{c}").cast("string").alias("after")) for c in VERSIONS]))
    both = before.alias("b").join(after.alias("a"), "package_id").select(pairs.alias("p")).select("p.*")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).groupBy("version", "before", "after").agg(F.count("*").alias("runs"))


def _rounded(name: str, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.col(name), F.lit(0.0)).cast("double"), digits)


def benchmark_reports(engines: DataFrame, detection: DataFrame, fields: DataFrame) -> DataFrame:
    """(engine, report): each engine's evaluation as one JSON document.

    engines: engine, model_id, model_version, image_count, mean_cer, mean_wer, mean_latency_ms,
    p95_latency_ms, exact_match, notes (an array). detection: engine, precision, recall, hmean,
    true_positives, false_positives, false_negatives, mean_iou; an engine without a row has null there.
    fields: engine and the columns of ``metrics.field_scores``. Fields are keys in alphabetical order;
    a field of which no value was compared matches none.
    """
    d = detection.select(
        "engine",
        F.struct(
            *[_rounded(c).alias(c) for c in ("precision", "recall", "hmean")], "true_positives", "false_positives", "false_negatives", _rounded("mean_iou").alias("mean_iou")
        ).alias("detection"),
    )
    score = F.struct(
        "field", *[_rounded(c).alias(c) for c in ("precision", "recall", "f1")], F.round(F.coalesce(F.try_divide(F.col("value_matches").cast("double"), F.col("tp")), F.lit(0.0)), 4).alias("value_exact_match"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
    )
    f = fields.groupBy("engine").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", score)))).alias("fields"))
    joined = engines.join(d, "engine", "left").join(f, "engine", "left")
    none = F.create_map().cast(dict(f.dtypes)["fields"])
    body = F.struct(
        "engine", "model_id", "model_version", "image_count", "detection", F.struct(_rounded("mean_cer").alias("mean_cer"), _rounded("mean_wer").alias("mean_wer")).alias("recognition"),
        F.coalesce("fields", none).alias("fields"), F.struct(_rounded("exact_match").alias("snapshot_exact_match")).alias("end_to_end"),
        F.struct(_rounded("mean_latency_ms", 1).alias("mean_ms"), _rounded("p95_latency_ms", 1).alias("p95_ms")).alias("latency"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
    )
    return joined.select("engine", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def calibration_report(candidates: DataFrame) -> DataFrame:
    """Per feature and cutoff: how precise and how complete retakes under it would be (candidates: as of ``metrics.calibration_candidates``)."""
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    hit, false, missed = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return candidates.select(
        "feature", F.round("threshold", 4).alias("threshold"), ratio(hit, hit + false).alias("retake_precision"), ratio(hit, hit + missed).alias("retake_recall"), hit.alias("true_retakes"),
        false.alias("false_retakes"), missed.alias("missed_failures"), F.col("true_negative").alias("correctly_passed"),
    )
