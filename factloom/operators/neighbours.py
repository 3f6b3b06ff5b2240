"""Neighbour join: the nearest lines of the same artifact within a radius of a line's own height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIUS = 2.5
MOST = 6


def with_neighbours(lines: DataFrame, *, radius: float = RADIUS, most: int = MOST) -> DataFrame:
    """Add ``near``, the texts of a line's neighbours, nearest first.

    lines: run_id, artifact_id, seq, clean and bounds (l, t, r, b). Distance is between box centres;
    a tie goes to the smaller seq; blank texts take a place among the nearest and are then dropped.
    All is one shuffle on (run_id, artifact_id): a line looks at those of its artifact within the largest
    radius there above and below it, a sliding frame, so a dense panel doesn't meet itself whole.
    """
    b = F.col("bounds")
    x, y = (b["l"] + b["r"]) / 2, (b["t"] + b["b"]) / 2
    own = F.struct(x.alias("x"), y.alias("y"), (F.greatest(b["b"] - b["t"], F.lit(1.0)) * radius).alias("reach"))
    panel = W.partitionBy("run_id", "artifact_id")
    placed = lines.withColumn("own", own).withColumn("band", F.col("own")["y"] / (F.max("own.reach").over(panel) * 1.0001))
    frame = panel.orderBy("band").rangeBetween(-1, 1)
    around = placed.withColumn("around", F.collect_list(F.struct("seq", "clean", "own.x", "own.y")).over(frame))
    o, me = F.col("own"), F.col("seq")
    distance = lambda n: F.sqrt((n["x"] - o["x"]) * (n["x"] - o["x"]) + (n["y"] - o["y"]) * (n["y"] - o["y"]))
    others = F.transform(F.filter("around", lambda n: n["seq"] != me), lambda n: F.struct(distance(n).alias("distance"), n["seq"].alias("seq"), n["clean"].alias("clean")))
    nearest = F.slice(F.array_sort(F.filter(others, lambda n: n["distance"] <= o["reach"])), 1, most)
    near = F.transform(F.filter(nearest, lambda n: n["clean"] != ""), lambda n: n["clean"])
    return around.withColumn("near", near).drop("own", "band", "around")
