"""Geometry over boxes that line items define."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.operators import metrics, neighbours
from factloom.plans.registry import query, table


def boxes(spark, d):
    """A box per line item: place by line number and quantity, size by tax and discount."""
    x, y = (F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", G.bbox(x + 30 + F.round(F.col("l_tax") * 100), y + 20, x, y).alias("geom")
    )


_BOXES = """boxes AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10.0 AS l, l_quantity AS t, l_linenumber * 10.0 + 30 + round(l_tax * 100) AS r,
 l_quantity + 20 AS b FROM lineitem)"""
_SHARED = "greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0)"


@query(f"""WITH {_BOXES}, p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, {_SHARED} AS s, (a.r - a.l) * (a.b - a.t) AS aa,
 (b.r - b.l) * (b.b - b.t) AS ab FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
 SELECT l_orderkey, i, j, round(s / (aa + ab - s), 9) AS iou, round(s / ab, 9) AS inside, round(s / least(aa, ab), 9) AS smaller FROM p""")
def iou_pairs(spark, d):
    b = boxes(spark, d)
    a = b.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("geom").alias("g"))
    pairs = a.join(b.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("geom").alias("h")), "l_orderkey").filter("i < j")
    g, h = F.col("g"), F.col("h")
    return pairs.select(
        "l_orderkey", "i", "j", F.round(G.iou(g, h), 9).alias("iou"), F.round(G.contains_fraction(g, h), 9).alias("inside"), F.round(G.smaller_overlap(g, h), 9).alias("smaller")
    )


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 5.0 AS area, round(CASE WHEN l_quantity >= 10 AND l_quantity >= sqrt(l_quantity * l_quantity + 100) THEN 0.0
 WHEN l_quantity < 10 OR true THEN (degrees(atan2(10, -l_quantity)) + 90) % 180 - 90 END, 6) AS angle, true AS valid FROM lineitem""")
def polygon_area_rotation(spark, d):
    """Right triangles (0, 0), (quantity, 0), (0, 10): the long side is the hypotenuse."""
    zero = F.lit(0.0)
    g = G.geometry("POLYGON", F.array(G.point(zero, zero), G.point(F.col("l_quantity"), zero), G.point(zero, F.lit(10.0))))
    rows = table(spark, d, "lineitem").withColumn("g", g)
    return rows.select("l_orderkey", "l_linenumber", G.area(F.col("g")).alias("area"), F.round(G.rotation_degrees(F.col("g")), 6).alias("angle"), G.is_valid(F.col("g")).alias("valid"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber * 10.0 / 2 + 50 AS l, l_quantity / 2 + 50 AS t, (l_linenumber * 10.0 + 30 + round(l_tax * 100)) / 2 + 50 AS r,
 (l_quantity + 20) / 2 + 50 AS b FROM lineitem""")
def transform_to_source(spark, d):
    """Boxes of a crop by (50, 50) that was doubled, back in the source image."""
    crop = F.struct(F.lit("crop").alias("kind"), F.array(*[F.lit(float(v)) for v in (1, 0, -50, 0, 1, -50, 0, 0, 1)]).alias("matrix"))
    scale = F.struct(F.lit("scale").alias("kind"), F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 2, 0, 0, 0, 1)]).alias("matrix"))
    back = boxes(spark, d).withColumn("b", G.bounds(G.to_source(F.col("geom"), F.array(crop, scale))))
    return back.select("l_orderkey", "l_linenumber", "b.l", "b.t", "b.r", "b.b")


@query("""WITH lines AS (SELECT l_orderkey AS run_id, l_linenumber AS seq, l_linenumber * 5.0 + 5 AS x, min(l_quantity) * 3.0 + 10 AS y FROM lineitem GROUP BY 1, 2),
 pairs AS (SELECT a.run_id, a.seq, b.seq AS o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM lines a JOIN lines b ON a.run_id = b.run_id AND a.seq <> b.seq),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY d, o) AS rank FROM pairs WHERE d <= 50)
 SELECT l.run_id, l.seq, coalesce(string_agg('line ' || o, ',' ORDER BY rank) FILTER (rank <= 6), '') AS near FROM lines l LEFT JOIN ranked r USING (run_id, seq) GROUP BY ALL""")
def neighbours_topk(spark, d):
    x, y = F.col("l_linenumber") * 5.0, F.col("l_quantity") * 3.0
    bounds = F.struct(x.alias("l"), y.alias("t"), (x + 10).alias("r"), (y + 20).alias("b"))
    once = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    lines = once.select(
        F.col("l_orderkey").alias("run_id"), F.lit("a").alias("artifact_id"), F.col("l_linenumber").alias("seq"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("clean"), bounds.alias("bounds"),
    )
    return neighbours.with_neighbours(lines).select("run_id", "seq", F.array_join("near", ",").alias("near"))


@query("""WITH p AS (SELECT l_orderkey AS image, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS m, count(*) FILTER (l_linenumber % 3 <> 0) AS t,
 count(*) FILTER (l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1), s AS (SELECT image,
 CASE WHEN m > 0 THEN k / m ELSE 0 END AS precision, CASE WHEN t > 0 THEN k / t ELSE 0 END AS recall, CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END AS mean_iou FROM p WHERE m + t > 0)
 SELECT image, precision::DOUBLE AS precision, recall::DOUBLE AS recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END::DOUBLE AS h_mean, mean_iou::DOUBLE AS mean_iou FROM s""")
def detection_scores(spark, d):
    """Disjoint boxes by line: predictions on even lines, truths where the line is no multiple of three."""
    x = F.col("l_linenumber") * 100.0
    once = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = once.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ordinal"), G.bbox(x, F.lit(0.0), x + 50, F.lit(20.0)).alias("geom"))
    return metrics.detection_scores(rows.filter("ordinal % 2 = 0"), rows.filter("ordinal % 3 <> 0"))
