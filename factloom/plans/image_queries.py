"""Image checks over pictures drawn from table rows, and over measures that tables hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import image_checks, quality
from factloom.plans.registry import query, table


#: Pictures that a task draws and passes on at a time.
DRAWN_ROWS = 16


def _drawn(rows: DataFrame, size: int, pixel) -> DataFrame:
    """Square pictures of one channel: ``pixel`` gives the brightness at (x, y)."""
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    shade = F.transform(at, lambda i: F.lpad(F.hex(pixel(i % size, F.floor(i / size)).cast("long")), 2, "0"))
    side = F.lit(size).alias
    return rows.select("image_id", side("height"), side("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(shade, "")).alias("data"))


def _stripes(batches: Iterator[pd.DataFrame], size: int = 340) -> Iterator[pd.DataFrame]:
    """Pictures of tilted stripes of batches of (image_id, tilt), ``DRAWN_ROWS`` at a time: a batch's rows are narrow, its pictures are not."""
    y, x = np.mgrid[:size, :size]
    for pdf in batches:
        for at in range(0, len(pdf), DRAWN_ROWS):
            part = pdf.iloc[at : at + DRAWN_ROWS]
            tilt = np.radians(part["tilt"].to_numpy(float))
            data = [(np.floor((y * np.cos(t) - x * np.sin(t) + 0.5) / 20) % 2 * 255).astype(np.uint8).tobytes() for t in tilt]
            yield pd.DataFrame({"image_id": part["image_id"], "height": size, "width": size, "channels": 1, "data": data})


def _striped(rows: DataFrame) -> DataFrame:
    """A picture of tilted stripes for each (image_id, tilt)."""
    return rows.mapInPandas(_stripes, "image_id string, height int, width int, channels int, data binary")


@query("SELECT s_suppkey AS image_id, (s_suppkey % 61 - 30)::INT AS drawn, true AS within FROM supplier")
def image_skew(spark, d):
    """Stripes tilted by -30 to 30 degrees: the measured skew is within one degree of the drawn one."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), (F.col("s_suppkey") % 61 - 30).alias("tilt"))
    key = F.col("image_id").cast("long")
    told = quality.measure_images(_striped(rows.repartition(16))).select(key.alias("image_id"), (key % 61 - 30).cast("int").alias("drawn"), "skew")
    return told.select("image_id", "drawn", F.coalesce(F.abs(F.col("skew") - F.col("drawn")) <= 1, F.lit(False)).alias("within"))


_BOXES = """px AS (SELECT s_suppkey AS image, x, y, CASE WHEN x >= s_suppkey % 20 AND x < s_suppkey % 20 + 10 + s_suppkey % 40 AND y >= s_suppkey // 3 % 20 AND y < s_suppkey // 3 % 20 + 10 + s_suppkey // 2 % 40
  THEN CASE WHEN s_suppkey * 91 % 256 < 250 AND (x * 7 + y * 13 + s_suppkey) % 5 = 0 THEN 20 ELSE s_suppkey * 91 % 256 END ELSE s_suppkey * 37 % 250 END AS v FROM supplier, range(64) a(x), range(64) b(y)),
 w AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS n FROM px WINDOW r AS (PARTITION BY image, y ORDER BY x)),
 g AS (SELECT *, lag(n - l) OVER c + 2 * (n - l) + lead(n - l) OVER c AS gx, lead(l + 2 * v + n) OVER c - lag(l + 2 * v + n) OVER c AS gy, lag(v) OVER c + lead(v) OVER c + l + n - 4 * v AS lap FROM w WINDOW c AS (PARTITION BY image, x ORDER BY y)),
 i AS (SELECT *, sqrt(gx * gx + gy * gy) AS mag FROM g WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62),
 m AS (SELECT image, avg(mag) + stddev_pop(mag) AS cut, var_pop(lap) AS sharpness FROM i GROUP BY 1),
 e AS (SELECT image, x, y FROM i JOIN m USING (image) WHERE floor(mag + 0.5) >= cut),
 ends AS (SELECT image, axis, min(k) FILTER (up > budget) AS first, max(k) FILTER (down > budget) AS last FROM (SELECT image, axis, k, sum(n) OVER (p ORDER BY k) AS up, sum(n) OVER (p ORDER BY k DESC) AS down, floor(sum(n) OVER p * 0.02 + 0.5) AS budget
   FROM (SELECT image, 'x' AS axis, x AS k, count(*) AS n FROM e GROUP BY 1, 3 UNION ALL SELECT image, 'y', y, count(*) FROM e GROUP BY 1, 3) WINDOW p AS (PARTITION BY image, axis)) GROUP BY 1, 2),
 box AS (SELECT image, product(last - first + 1) / 4096 AS filled, sum((first <= 1)::INT + (last >= 62)::INT) AS touching FROM ends GROUP BY 1),
 s AS (SELECT image, avg(v) AS luminance, avg((v <= 16)::INT) AS shadow, avg((v >= 239)::INT) AS highlight, avg((v >= 250)::INT) AS bright FROM px GROUP BY 1),
 all_of AS (SELECT *, CASE WHEN touching > 0 OR filled < 0.20 THEN 'fail' WHEN filled < 0.36 THEN 'warn' ELSE 'pass' END AS cropping FROM s JOIN m USING (image) JOIN box USING (image))"""


@query(f"""WITH {_BOXES}
 SELECT image AS image_id, 'blur' AS check_id, CASE WHEN sharpness < 45 THEN 'fail' WHEN sharpness < 110 THEN 'warn' ELSE 'pass' END AS verdict, round(sharpness, 5)::DOUBLE AS value, round(least(sharpness / 300, 1), 6)::DOUBLE AS score FROM all_of
 UNION ALL SELECT image, 'brightness', CASE WHEN luminance < 45 OR luminance > 212 THEN 'fail' WHEN luminance < 78 OR luminance > 188 OR shadow > 0.08 OR highlight > 0.08 THEN 'warn' ELSE 'pass' END, round(luminance, 5), round(greatest(1 - abs(luminance - 128) / 128, 0), 6) FROM all_of
 UNION ALL SELECT image, 'glare', CASE WHEN bright >= 0.02 THEN 'fail' WHEN bright >= 0.015 THEN 'warn' ELSE 'pass' END, round(bright, 5), round(greatest(1 - bright / 0.02, 0), 6) FROM all_of
 UNION ALL SELECT image, 'cropping', cropping, touching, CASE WHEN touching > 0 THEN 0 ELSE round(least(filled / 0.36, 1), 6) END FROM all_of""")
def client_reports(spark, d):
    """A speckled box on plain ground a supplier, from pixels to the capture device's verdict and score on every check."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.col("s_suppkey").alias("s"))
    s = F.col("s")
    left, top, shade = s % 20, F.floor(s / 3) % 20, s * 91 % 256

    def pixel(x: Column, y: Column) -> Column:
        inside = (x >= left) & (x < left + 10 + s % 40) & (y >= top) & (y < top + 10 + F.floor(s / 2) % 40)
        return F.when(inside, F.when((shade < 250) & ((x * 7 + y * 13 + s) % 5 == 0), 20).otherwise(shade)).otherwise(s * 37 % 250)

    measures = image_checks.client_measures(_drawn(rows.repartition(16), 64, pixel))
    reports = image_checks.client_scores(image_checks.judged(measures, image_checks.policies(spark), image_checks.CLIENT))
    return image_checks.check_rows(reports).select(F.col("image_id").cast("long").alias("image_id"), "check_id", "verdict", F.round("value", 5).alias("value"), F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_quantity * 4 END AS sharpness, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 200 END AS luminance, CASE WHEN l_linenumber <> 7 THEN l_discount * 3 END AS clipped,
   CASE WHEN l_linenumber <> 7 THEN l_tax END AS glare, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS contrast FROM lineitem),
 r AS (SELECT *, CASE WHEN sharpness < 60 THEN 'blur' WHEN luminance < 40 OR luminance > 220 THEN 'brightness' WHEN clipped > 0.25 THEN 'clipped' WHEN glare > 0.03 THEN 'glare' WHEN contrast < 18 THEN 'contrast' END AS reason FROM m)
 SELECT l_orderkey, l_linenumber, CASE WHEN sharpness IS NULL THEN 'ABSTAIN' WHEN reason IS NOT NULL THEN 'RETAKE' ELSE 'PASS' END AS verdict, reason, CASE WHEN sharpness IS NULL THEN 'unavailable' WHEN reason IS NOT NULL THEN 'fail'
  WHEN sharpness < 140 OR luminance < 70 OR luminance > 195 OR clipped > 0.10 OR glare > 0.015 OR contrast < 32 THEN 'warn' ELSE 'pass' END AS overall FROM r""")
def server_reports(spark, d):
    """Measures that line items hold, judged by the server's policy rows; seventh lines could not be measured."""
    kept = lambda c, name: F.when(F.col("l_linenumber") != 7, c.cast("double")).alias(name)
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", kept(q * 4, "sharpness"), kept(F.col("l_extendedprice") / 200, "luminance"), kept(F.col("l_discount") * 3, "clipped"), kept(F.col("l_tax"), "glare"), kept(q, "contrast")
    )
    reports = image_checks.judged(rows, image_checks.policies(spark), image_checks.SERVER)
    return reports.select("l_orderkey", "l_linenumber", image_checks.server_verdict(reports).alias("verdict"), "reason", "overall")
