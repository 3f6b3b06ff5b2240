"""Image checks against policies that are rows of one table: measures to a verdict per check and a report per image.

A policy row names a measure, the check it belongs to and the bounds beyond which the check fails or
warns; a version says under which rows a report was made. Both sides' policies, that of the capture
device and that of the server, are rows of the same table, so a new version is new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.coverage import VERDICTS
from factloom.operators.quality import area_resize, largest_blob

SERVER, CLIENT = "server-1.0.0-uncalibrated", "client-1.0.0"
POLICY_SCHEMA = (
    "policy_version string, calibrated boolean, longest_edge int, place int, check_id string, measure string, fail_below double, fail_above double, "
    "warn_below double, warn_above double, reaching boolean"
)
#: Fixed values, by version: place, check, measure, bounds of failing and of warning, and whether reaching an upper bound is enough.
POLICIES = (
    (SERVER, False, 1024, 1, "blur", "sharpness", 60.0, None, 140.0, None, False),
    (SERVER, False, 1024, 2, "brightness", "luminance", 40.0, 220.0, 70.0, 195.0, False),
    (SERVER, False, 1024, 3, "clipped", "clipped", None, 0.25, None, 0.10, False),
    (SERVER, False, 1024, 4, "glare", "glare", None, 0.030, None, 0.015, False),
    (SERVER, False, 1024, 5, "contrast", "contrast", 18.0, None, 32.0, None, False),
    (CLIENT, False, 800, 1, "blur", "sharpness", 45.0, None, 110.0, None, False),
    (CLIENT, False, 800, 2, "brightness", "luminance", 45.0, 212.0, 78.0, 188.0, False),
    (CLIENT, False, 800, 3, "brightness", "shadow", None, None, None, 0.08, False),
    (CLIENT, False, 800, 4, "brightness", "highlight", None, None, None, 0.08, False),
    (CLIENT, False, 800, 5, "glare", "blob", None, 0.020, None, None, True),
    (CLIENT, False, 800, 6, "glare", "bright", None, None, None, 0.015, True),
    (CLIENT, False, 800, 7, "cropping", "touching", None, 0.0, None, None, False),
    (CLIENT, False, 800, 8, "cropping", "filled", 0.20, None, 0.36, None, False),
)
CLIENT_MEASURES = ("sharpness", "luminance", "shadow", "highlight", "blob", "bright", "boundary", "touching", "filled")
TRIM, MARGIN = 0.02, 0.012


def policies(spark: SparkSession) -> DataFrame:
    """The policy table as shipped; a deployment may read its own with this schema."""
    return spark.createDataFrame(list(POLICIES), POLICY_SCHEMA)


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def luma_plane(raw: np.ndarray, longest: int) -> np.ndarray:
    """Brightness of the averaged image in whole steps; rows hold blue, green and red, or one channel."""
    weights = np.array([0.114, 0.587, 0.299]) if raw.shape[2] >= 3 else np.array([1.0])
    small = np.stack([area_resize(raw[:, :, c], longest) for c in range(len(weights))], axis=2)
    return np.clip(np.floor(small @ weights + 0.5), 0, 255)


def _steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences of interior pixels."""
    return v[1:-1, 2:] - v[1:-1, :-2], v[2:, 1:-1] - v[:-2, 1:-1]


def silhouette(v: np.ndarray) -> tuple[int, float] | None:
    """(sides of the frame that are touched, filled share) of the box of strong edges, without the outermost of them."""
    height, width = v.shape
    if min(height, width) < 8:
        return None
    across = v[:-2] + 2 * v[1:-1] + v[2:]
    down = v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
    strength = np.hypot(across[:, 2:] - across[:, :-2], down[2:] - down[:-2])
    strong = np.floor(strength + 0.5) >= strength.mean() + strength.std()
    if not strong.any():
        return None
    budget = _half_up(strong.sum() * TRIM)

    def ends(energy: np.ndarray) -> tuple[int, int]:
        first, last = int((energy.cumsum() > budget).argmax()), int((energy[::-1].cumsum() > budget).argmax())
        return first + 1, len(energy) - last

    (left, right), (top, bottom) = ends(strong.sum(axis=0)), ends(strong.sum(axis=1))
    beside, above = max(1, _half_up(width * MARGIN)), max(1, _half_up(height * MARGIN))
    touched = (left <= beside) + (right >= width - 1 - beside) + (top <= above) + (bottom >= height - 1 - above)
    return int(touched), max(1, right - left + 1) * max(1, bottom - top + 1) / (width * height)


def client_values(v: np.ndarray) -> dict[str, float | None]:
    """The capture device's measures of one brightness plane; null where it is too small for one."""
    out: dict[str, float | None] = dict.fromkeys(CLIENT_MEASURES)
    bright = v >= 250
    out |= {"luminance": v.mean(), "shadow": (v <= 16).mean(), "highlight": (v >= 239).mean(), "bright": bright.mean(), "blob": largest_blob(bright, False) / v.size, "boundary": 0.0}
    if min(v.shape) >= 3:
        inner = v[1:-1, :-2] + v[1:-1, 2:] + v[:-2, 1:-1] + v[2:, 1:-1] - 4 * v[1:-1, 1:-1]
        dark = ~bright
        rim = bright[1:-1, 1:-1] & (dark[1:-1, :-2] | dark[1:-1, 2:] | dark[:-2, 1:-1] | dark[2:, 1:-1])
        out["sharpness"] = inner.var()
        out["boundary"] = np.hypot(*_steps(v))[rim].mean() if rim.any() else 0.0
    if box := silhouette(v):
        out["touching"], out["filled"] = float(box[0]), box[1]
    return {k: None if x is None else float(x) for k, x in out.items()}


def client_measures(images: DataFrame, longest: int = 800) -> DataFrame:
    """The capture device's measures of (image_id, height, width, channels, data), with source and analysed sizes.

    Images that don't fit their size have sizes of 0 and no measures.
    """
    sizes = ("source_width", "source_height", "analysed_width", "analysed_height")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, w, c, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                if data is None or not h * w * c or h * w * c != len(data):
                    rows.append((i, 0, 0, 0, 0, *[None] * len(CLIENT_MEASURES)))
                    continue
                v = luma_plane(np.frombuffer(data, dtype=np.uint8).reshape(h, w, c), longest)
                rows.append((i, w, h, v.shape[1], v.shape[0], *client_values(v).values()))
            yield pd.DataFrame(rows, columns=["image_id", *sizes, *CLIENT_MEASURES])

    schema = "image_id string, " + ", ".join(f"{s} int" for s in sizes) + "".join(f", {m} double" for m in CLIENT_MEASURES)
    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(measure, schema)


def _rule_verdict(rule: Column, value: Column) -> Column:
    over = lambda bound: F.when(rule["reaching"], value >= bound).otherwise(value > bound)
    fails = F.coalesce(value < rule["fail_below"], F.lit(False)) | F.coalesce(over(rule["fail_above"]), F.lit(False))
    warns = F.coalesce(value < rule["warn_below"], F.lit(False)) | F.coalesce(over(rule["warn_above"]), F.lit(False))
    return F.when(value.isNull(), "unavailable").when(fails, "fail").when(warns, "warn").otherwise("pass")


def _worst(verdicts: Column) -> Column:
    ranked = F.transform(verdicts, lambda v: F.array_position(F.array(*[F.lit(x) for x in VERDICTS]), v))
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in VERDICTS]), (F.array_max(ranked) - 1).cast("int")), F.lit("unavailable"))


def judged(measures: DataFrame, policy: DataFrame, version: str, more: DataFrame | None = None) -> DataFrame:
    """One row an image: its verdict on every check of a policy version, the overall verdict and the first failing check.

    The version's rules are one row that is broadcast; nothing is shuffled. ``more`` adds checks that
    pixels can't tell (image_id, check_id, verdict, value), such as whether texts could be read.
    """
    rules = policy.filter(F.col("policy_version") == version)
    rule = F.struct("place", "check_id", "measure", "fail_below", "fail_above", "warn_below", "warn_above", "reaching")
    one = rules.groupBy("policy_version").agg(F.array_sort(F.collect_list(rule)).alias("rules"), F.bool_and("calibrated").alias("calibrated"))
    have = [m for m in dict.fromkeys(r[5] for r in POLICIES) if m in measures.columns]
    values = F.create_map(*[x for m in have for x in (F.lit(m), F.col(m).cast("double"))])
    joined = measures.withColumn("policy_version", F.lit(version)).join(F.broadcast(one), "policy_version").withColumn("values", values)
    told = F.transform("rules", lambda r: F.struct(r["check_id"].alias("check_id"), F.try_element_at("values", r["measure"]).alias("value"), _rule_verdict(r, F.try_element_at("values", r["measure"])).alias("verdict")))
    names = F.array_distinct(F.transform("rules", lambda r: r["check_id"]))

    def check(name: Column) -> Column:
        own = F.filter("told", lambda t: t["check_id"] == name)
        return F.struct(name.alias("check_id"), _worst(F.transform(own, lambda t: t["verdict"])).alias("verdict"), own[0]["value"].alias("value"))

    made = joined.withColumn("told", told).withColumn("checks", F.transform(names, check))
    if more is not None:
        added = more.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("check_id", "verdict", F.col("value").cast("double").alias("value")))).alias("added"))
        made = made.join(added, "image_id", "left").withColumn("checks", F.when(F.col("added").isNull(), F.col("checks")).otherwise(F.concat("checks", "added"))).drop("added")
    failing = F.filter("checks", lambda c: c["verdict"] == "fail")
    overall = _worst(F.transform("checks", lambda c: c["verdict"]))
    return made.withColumn("overall", overall).withColumn("reason", F.get(failing, F.lit(0))["check_id"]).drop("rules", "values", "told")


def server_verdict(reports: DataFrame) -> Column:
    """RETAKE if a check fails, ABSTAIN without any measure, else PASS: the server sends nothing back for a mere concern."""
    none = F.forall("checks", lambda c: c["verdict"] == "unavailable")
    return F.when(none, "ABSTAIN").when(F.col("reason").isNotNull(), "RETAKE").otherwise("PASS")


def client_scores(reports: DataFrame) -> DataFrame:
    """Reports with a score from 0 to 1 in every check of the capture device; null where a check is unavailable."""
    clamp = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    scores = {
        "blur": clamp(F.col("sharpness") / 300), "brightness": clamp(1 - F.abs(F.col("luminance") - 128) / 128), "glare": clamp(1 - F.col("blob") / 0.020),
        "cropping": F.when(F.col("touching") > 0, 0.0).otherwise(clamp(F.col("filled") / 0.36)),
    }
    known = reports.withColumn("scores", F.create_map(*[x for name, s in scores.items() for x in (F.lit(name), s)]))
    scored = F.transform("checks", lambda c: c.withField("score", F.when(c["verdict"] != "unavailable", F.try_element_at("scores", c["check_id"]))))
    return known.withColumn("checks", scored).drop("scores")


def check_rows(reports: DataFrame) -> DataFrame:
    """One row an image and check: what a report lists."""
    return reports.select("image_id", "policy_version", "overall", F.explode("checks").alias("c")).select("image_id", "policy_version", "overall", "c.*")
