"""Evaluation: error rates, detection and field scores, threshold sweeps, ROC-AUC, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import geometry as G

MATCH_IOU = 0.5


def character_error_rate(truth: Column, read: Column) -> Column:
    """Edits over characters of the truth; for an empty truth 0 if nothing was read, else 1."""
    t, r = F.coalesce(truth, F.lit("")), F.coalesce(read, F.lit(""))
    return F.when(F.char_length(t) > 0, F.levenshtein(t, r) / F.char_length(t)).otherwise(F.when(r == "", 0.0).otherwise(1.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def detection_scores(predictions: DataFrame, truths: DataFrame, least: float = MATCH_IOU) -> DataFrame:
    """Per image: greedy one-to-one matches by overlap, largest first, and the scores that follow.

    predictions and truths: image, ordinal, geom. Overlapping pairs of one image only are listed; the
    fold over them is ordered by (overlap, prediction, truth), all descending.
    """
    p = predictions.select("image", F.col("ordinal").alias("i"), F.col("geom").alias("pg"))
    t = truths.select("image", F.col("ordinal").alias("j"), F.col("geom").alias("tg"))
    pairs = p.join(t, "image").withColumn("overlap", G.iou(F.col("pg"), F.col("tg"))).filter(F.col("overlap") >= least)
    listed = pairs.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("overlap", "i", "j")), asc=False).alias("pairs"))
    taken = lambda kept, x: F.exists(kept, lambda k: (k["i"] == x["i"]) | (k["j"] == x["j"]))
    kind = dict(listed.dtypes)["pairs"]
    kept = F.aggregate("pairs", F.array().cast(kind), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    matched = listed.select("image", F.size(kept).alias("matched"), F.aggregate(kept, F.lit(0.0), lambda s, k: s + k["overlap"]).alias("overlap_sum"))
    n_p, n_t = p.groupBy("image").agg(F.count("*").alias("n_p")), t.groupBy("image").agg(F.count("*").alias("n_t"))
    every = n_p.join(n_t, "image", "full").join(matched, "image", "left").na.fill(0)
    precision, recall = _ratio(F.col("matched"), F.col("n_p")), _ratio(F.col("matched"), F.col("n_t"))
    return every.select(
        "image", precision.alias("precision"), recall.alias("recall"), _harmonic(precision, recall).alias("h_mean"), _ratio(F.col("overlap_sum"), F.col("matched")).alias("mean_iou")
    )


def best_truth(predictions: DataFrame, truths: DataFrame, least: float = MATCH_IOU) -> DataFrame:
    """(image, i, j): the truth region with the largest overlap, the last of equals."""
    p = predictions.select("image", F.col("ordinal").alias("i"), F.col("geom").alias("pg"))
    t = truths.select("image", F.col("ordinal").alias("j"), F.col("geom").alias("tg"))
    pairs = p.join(t, "image").withColumn("overlap", G.iou(F.col("pg"), F.col("tg"))).filter(F.col("overlap") >= least)
    return pairs.groupBy("image", "i").agg(F.max(F.struct("overlap", "j")).alias("best")).select("image", "i", F.col("best")["j"].alias("j"))


def field_scores(expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per field: presence counts, equal values, precision, recall and F1 (expected, resolved: image, field, value)."""
    joined = expected.withColumnRenamed("value", "want").join(resolved.withColumnRenamed("value", "got"), ["image", "field"], "full")
    w, g = F.col("want").isNotNull(), F.col("got").isNotNull()
    counts = joined.groupBy("field").agg(
        F.count_if(w & g).alias("tp"), F.count_if(~w & g).alias("fp"), F.count_if(w & ~g).alias("fn"), F.count_if(w & g & (F.col("want") == F.col("got"))).alias("value_matches")
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), _harmonic(precision, recall).alias("f1"))


def threshold_sweep(samples: DataFrame, keys: list[str], low_is_bad: bool = True) -> DataFrame:
    """Confusion counts at every distinct value as cutoff, strictly below (above) it being flagged.

    samples: keys, value, failed. Counts per distinct value are summed by a running window, so each
    sample is read once.
    """
    per = samples.groupBy(*keys, "value").agg(F.count_if("failed").alias("bad"), F.count_if(~F.col("failed")).alias("good"))
    order = F.col("value").asc() if low_is_bad else F.col("value").desc()
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    flagged = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return per.select(
        *keys, F.col("value").alias("threshold"), flagged("bad").alias("true_positive"), flagged("good").alias("false_positive"),
        (F.sum("bad").over(whole) - flagged("bad")).alias("false_negative"), (F.sum("good").over(whole) - flagged("good")).alias("true_negative"),
    )


def roc_auc(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that a failed sample's value lies below another's, ties a half; null if a class is empty.

    Counts per distinct value and a running sum: no pair of samples is ever formed.
    """
    per = samples.groupBy(*keys, "value").agg(F.count_if("failed").alias("bad"), F.count_if(~F.col("failed")).alias("good"))
    before = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    won = F.col("good") * F.coalesce(F.sum("bad").over(before), F.lit(0)) + F.col("good") * F.col("bad") / 2
    pairs = F.sum("bad") * F.sum("good")
    return per.withColumn("won", won).groupBy(*keys).agg(F.try_divide(F.sum("won"), pairs).alias("auc"), F.sum(F.col("bad") + F.col("good")).alias("samples"))


def latency_p95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at index floor(0.95 n) of the sorted values."""
    order = W.partitionBy(*keys).orderBy(value)
    ranked = rows.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    return ranked.filter(F.col("__i") == F.floor(F.col("__n") * 95 / 100)).select(*keys, F.col(value).alias("p95"))


def separates(auc: Column) -> Column:
    return F.abs(auc - 0.5) > 0.15


def engine_rollup(scored: DataFrame, latencies: DataFrame) -> DataFrame:
    """Per engine: mean error rates over matched lines, mean and 95th latency; 0 where there is nothing to average.

    scored: engine, cer, wer of every prediction that has a truth region; latencies: engine, ms.
    """
    rates = scored.groupBy("engine").agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.count("*").alias("matched"))
    times = latencies.groupBy("engine").agg(F.avg("ms").alias("mean_latency_ms")).join(latency_p95(latencies, ["engine"], "ms").withColumnRenamed("p95", "p95_latency_ms"), "engine")
    return rates.join(times, "engine", "full").na.fill(0)


#: Features of which a low value is bad; of all others a high one is.
LOW_IS_BAD = {
    "blur_laplacian_variance": True, "rms_contrast": True, "mean_luminance": True,
    "clipped_fraction": False, "largest_specular_blob_fraction": False, "dominant_edge_skew_degrees": False,
}


def calibration(samples: DataFrame) -> DataFrame:
    """Per feature: AUC, how many samples it rests on, and whether it tells failures from successes (samples: feature, value, failed)."""
    found = roc_auc(samples, ["feature"])
    return found.select("feature", F.round("auc", 4).alias("roc_auc"), F.col("samples").alias("sample_count"), F.coalesce(separates(F.col("auc")), F.lit(False)).alias("separates_failures"))


def calibration_candidates(samples: DataFrame) -> DataFrame:
    """Per feature and cutoff: confusion counts, the bad side being the feature's own."""
    low = F.col("feature").isin(*[f for f, is_low in LOW_IS_BAD.items() if not is_low])
    sides = [threshold_sweep(samples.filter(~low), ["feature"], True), threshold_sweep(samples.filter(low), ["feature"], False)]
    return sides[0].unionByName(sides[1])
