"""Geometry as Column functions over struct(type, points array<struct(x, y)>, space)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGINAL = "original_image_px"
GEOMETRY = "struct<type:string,points:array<struct<x:double,y:double>>,space:string>"


def _let(value: Column, body) -> Column:
    """Evaluate a value once per row and pass it on."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, points: Column, space: str = ORIGINAL) -> Column:
    return F.struct(F.lit(kind).alias("type"), points.alias("points"), F.lit(space).alias("space"))


def bbox(x1: Column, y1: Column, x2: Column, y2: Column, space: str = ORIGINAL) -> Column:
    """An upright box from any two opposite corners."""
    left, right, top, bottom = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    return geometry("BBOX", F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom)), space)


def is_valid(g: Column) -> Column:
    """At least three points, and exactly four in a quadrilateral."""
    n = F.size(g["points"])
    return F.coalesce((n >= 3) & ((g["type"] != "QUADRILATERAL") | (n == 4)), F.lit(False))


def bounds(g: Column) -> Column:
    xs, ys = F.transform(g["points"], lambda p: p["x"]), F.transform(g["points"], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"))


def to_bbox(g: Column) -> Column:
    b = bounds(g)
    points = F.array(point(b["l"], b["t"]), point(b["r"], b["t"]), point(b["r"], b["b"]), point(b["l"], b["b"]))
    return F.struct(F.lit("BBOX").alias("type"), points.alias("points"), g["space"].alias("space"))


def _edges(points: Column) -> Column:
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % n).alias("b")))


def area(g: Column) -> Column:
    """Shoelace area of the ring."""
    cross = F.transform(_edges(g["points"]), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def rotation_degrees(g: Column) -> Column:
    """Angle of the longest edge, the first of equals, in [-90, 90); upright boxes have none."""
    edges = F.transform(
        _edges(g["points"]),
        lambda e, i: F.struct(
            F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]).alias("size"),
            (-i).alias("first"),
            F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"])).alias("angle"),
        ),
    )
    angle = F.pmod(F.array_max(edges)["angle"] + 90, F.lit(180.0)) - 90
    return F.when(g["type"] == "BBOX", F.lit(0.0)).otherwise(angle)


def _box_area(b: Column) -> Column:
    return (b["r"] - b["l"]) * (b["b"] - b["t"])


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection area of two bounds."""
    wide = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    high = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    shared = box_overlap(a, b)
    union = _box_area(a) + _box_area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of the bounding boxes; 0 across coordinate spaces."""
    return F.when(a["space"] == b["space"], box_iou(bounds(a), bounds(b))).otherwise(F.lit(0.0))


def contains_fraction(a: Column, b: Column) -> Column:
    """Share of b's box that lies in a's."""
    whole = _box_area(bounds(b))
    return F.when((a["space"] == b["space"]) & (whole > 0), box_overlap(bounds(a), bounds(b)) / whole).otherwise(F.lit(0.0))


def smaller_overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    least = F.least(_box_area(bounds(a)), _box_area(bounds(b)))
    return F.when(least > 0, box_overlap(bounds(a), bounds(b)) / least).otherwise(F.lit(0.0))


def identity() -> Column:
    return F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])


def matmul(a: Column, b: Column) -> Column:
    """Product of two row-major 3 x 3 matrices."""
    cell = lambda r, c: sum((F.get(a, F.lit(3 * r + k)) * F.get(b, F.lit(3 * k + c)) for k in range(1, 3)), F.get(a, F.lit(3 * r)) * F.get(b, F.lit(c)))
    return F.array(*[cell(r, c) for r in range(3) for c in range(3)])


def combined(steps: Column) -> Column:
    """One matrix for a chain of steps (kind, matrix), the first applied first."""
    return F.aggregate(steps, identity(), lambda acc, s: matmul(s["matrix"], acc))


def invert(m: Column) -> Column:
    """Inverse of a row-major 3 x 3 matrix by cofactors; null if it is as good as singular."""
    e = [F.get(m, F.lit(i)) for i in range(9)]
    minor = lambda r, c: (
        e[3 * ((r + 1) % 3) + (c + 1) % 3] * e[3 * ((r + 2) % 3) + (c + 2) % 3]
        - e[3 * ((r + 1) % 3) + (c + 2) % 3] * e[3 * ((r + 2) % 3) + (c + 1) % 3]
    )
    det = e[0] * minor(0, 0) + e[1] * minor(0, 1) + e[2] * minor(0, 2)
    cells = F.array(*[minor(c, r) for r in range(3) for c in range(3)])
    return _let(det, lambda d: F.when(F.abs(d) >= 1e-12, F.transform(cells, lambda c: c / d)))


def to_source(g: Column, steps: Column) -> Column:
    """The geometry in the source image: its points under the chain's inverse; null if there is none."""

    def move(back: Column) -> Column:
        def apply(p: Column) -> Column:
            row = lambda r: F.get(back, F.lit(3 * r)) * p["x"] + F.get(back, F.lit(3 * r + 1)) * p["y"] + F.get(back, F.lit(3 * r + 2))
            return F.struct(F.try_divide(row(0), row(2)).alias("x"), F.try_divide(row(1), row(2)).alias("y"))

        moved = F.struct(g["type"].alias("type"), F.transform(g["points"], apply).alias("points"), F.lit(ORIGINAL).alias("space"))
        return F.when(back.isNotNull(), moved)

    return F.when(F.size(steps) == 0, g).otherwise(_let(_let(combined(steps), invert), move))


def to_json(g: Column) -> Column:
    return F.to_json(g)


def from_json(text: Column) -> Column:
    """Geometry from JSON; a missing space means the original image."""
    g = F.from_json(text, GEOMETRY)
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), g["points"].alias("points"), F.coalesce(g["space"], F.lit(ORIGINAL)).alias("space")))
