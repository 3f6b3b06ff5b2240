"""Image quality: pixel statistics, verdict precedence, region quality, measurability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "factloom-quality-1"
LONGEST_EDGE = 1024
#: Thresholds of the uncalibrated policy, as a table row would hold them.
POLICY = {"blur": 60.0, "dark": 40.0, "bright": 220.0, "clipped": 0.25, "glare": 0.03, "contrast": 18.0}
#: Beyond these a passing image is of concern.
CONCERN = {"blur": 140.0, "dark": 70.0, "bright": 195.0, "clipped": 0.10, "glare": 0.015, "contrast": 32.0}


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 brightness."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Per image: mean, RMS contrast and clipped share of (image, y, x, v)."""
    clipped = F.avg(F.when((F.col("v") <= 16) | (F.col("v") >= 239), 1.0).otherwise(0.0))
    return pixels.groupBy("image").agg(F.avg("v").alias("luminance"), F.stddev_pop("v").alias("contrast"), clipped.alias("clipped"))


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    """Per image: variance of the four-neighbour Laplacian over interior pixels.

    Each pixel sends its value to its neighbours and itself; sums per position replace self-joins.
    """
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in ((0, 0, -4), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1))]))
    sent = pixels.select("image", "y", "x", "v", moves.alias("m"))
    laid = sent.groupBy("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).agg(
        F.sum(F.col("v") * F.col("m.w")).alias("l"), F.count("*").alias("n")
    )
    return laid.filter("n = 5").groupBy("image").agg(F.var_pop("l").alias("sharpness"))


def area_resize(image: np.ndarray, longest: int = LONGEST_EDGE) -> np.ndarray:
    """Mean over the source area of each target pixel, if the longest edge is too long."""
    h, w = image.shape
    if max(h, w) <= longest:
        return image.astype(np.float64)
    scale = longest / max(h, w)
    th, tw = max(1, round(h * scale)), max(1, round(w * scale))

    def shrink(a: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, a.shape[1])), a.cumsum(axis=0)])
        edges = np.linspace(0, a.shape[0], n + 1)
        low = np.minimum(edges.astype(int), a.shape[0] - 1)
        at = total[low] + (edges - low)[:, None] * a[low]
        return np.diff(at, axis=0) / np.diff(edges)[:, None]

    return shrink(shrink(image.astype(np.float64), th).T, tw).T


def largest_blob(mask: np.ndarray, diagonal: bool) -> int:
    """Size of the largest connected region of a mask, by 4 or 8 neighbours: runs joined by union-find."""
    parent: list[int] = []
    size: list[int] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above: list[tuple[int, int, int]] = []
    reach = int(diagonal)
    for row in mask:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        runs = []
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            size.append(end - start)
            for s, e, other in above:
                if s < end + reach and start < e + reach:
                    a, b = find(me), find(other)
                    if a != b:
                        parent[a] = b
                        size[b] += size[a]
            runs.append((start, end, me))
        above = runs
    return max((size[i] for i in range(len(parent)) if parent[i] == i), default=0)


def framing(image: np.ndarray, trim: float = 0.02) -> tuple[float, bool]:
    """(filled share, touches edge): box of strong Sobel gradients after trimming their energy's tails."""
    v = image.astype(np.float64)
    if min(v.shape) < 3:
        return 0.0, False
    smooth_x, smooth_y = v[:-2] + 2 * v[1:-1] + v[2:], v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
    magnitude = np.hypot(smooth_x[:, 2:] - smooth_x[:, :-2], smooth_y[2:] - smooth_y[:-2])
    strong = np.where(magnitude > magnitude.mean() + magnitude.std(), magnitude, 0.0)
    if not strong.any():
        return 0.0, False

    def span(energy: np.ndarray) -> tuple[int, int]:
        budget = trim * energy.sum()
        return int((energy.cumsum() > budget).argmax()), len(energy) - 1 - int((energy[::-1].cumsum() > budget).argmax())

    (y0, y1), (x0, x1) = span(strong.sum(axis=1)), span(strong.sum(axis=0))
    filled = (y1 - y0 + 1) * (x1 - x0 + 1) / strong.size
    return filled, bool(y0 == 0 or x0 == 0 or y1 == strong.shape[0] - 1 or x1 == strong.shape[1] - 1)


def boundary_gradient(image: np.ndarray) -> float:
    """Mean absolute step across the image's outermost rows and columns."""
    v = image.astype(np.float64)
    if min(v.shape) < 2:
        return 0.0
    steps = (v[0] - v[1], v[-1] - v[-2], v[:, 0] - v[:, 1], v[:, -1] - v[:, -2])
    return float(np.abs(np.concatenate(steps)).mean())


def edge_pixels(grey: np.ndarray, low: float = 60.0, high: float = 180.0) -> np.ndarray:
    """Thin edges: ridges of the gradient above ``low`` that are connected with one above ``high``."""
    v = np.pad(grey.astype(np.float64), 1, mode="edge")
    across, down = v[:-2] + 2 * v[1:-1] + v[2:], v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
    gx, gy = across[:, 2:] - across[:, :-2], down[2:] - down[:-2]
    strength = np.abs(gx) + np.abs(gy)
    around = np.pad(strength, 1)
    at = lambda dy, dx: around[1 + dy : 1 + dy + strength.shape[0], 1 + dx : 1 + dx + strength.shape[1]]
    flat, steep = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) >= np.abs(gx) * np.tan(3 * np.pi / 8)
    falling = gx * gy >= 0
    before = np.select([flat, steep, falling], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, falling], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    ridge = (strength > before) & np.where(flat | steep, strength >= after, strength > after)
    weak = np.pad(ridge & (strength > low), 1).ravel()
    row = strength.shape[1] + 2
    front = np.flatnonzero(np.pad(ridge & (strength > high), 1))
    found = np.zeros_like(weak)
    found[front] = True
    steps = np.array([-row - 1, -row, -row + 1, -1, 1, row - 1, row, row + 1])
    while len(front):
        front = np.unique((front[:, None] + steps).ravel())
        front = front[weak[front] & ~found[front]]
        found[front] = True
    return found.reshape(-1, row)[1:-1, 1:-1]


def line_votes(edges: np.ndarray) -> np.ndarray:
    """Votes by (whole degree of the normal, distance): how many edge pixels lie on each line."""
    y, x = np.nonzero(edges)
    reach = sum(edges.shape)
    angles = np.deg2rad(np.arange(180))
    return np.stack([np.bincount(np.rint(x * np.cos(a) + y * np.sin(a)).astype(np.int64) + reach, minlength=2 * reach + 1) for a in angles])


def dominant_skew(grey: np.ndarray, votes: int = 160, most: int = 60) -> float | None:
    """Median angle of the ``most`` strongest straight lines in degrees, folded to [-45, 45); None without lines.

    A line is a local peak of more than ``votes`` votes. Diagnostic only: no verdict rests on it.
    """
    table = np.pad(line_votes(edge_pixels(grey)), 1)
    own = table[1:-1, 1:-1]
    peak = (own > votes) & (own > table[1:-1, :-2]) & (own >= table[1:-1, 2:]) & (own > table[:-2, 1:-1]) & (own >= table[2:, 1:-1])
    degrees, _ = np.nonzero(peak)
    if not len(degrees):
        return None
    strongest = degrees[np.argsort(-own[peak], kind="stable")[:most]]
    return float(np.median((strongest - 90 + 45) % 90 - 45))


def measure_images(images: DataFrame) -> DataFrame:
    """Measurements of (image_id, height, width, channels, data), bytes in rows, blue first.

    One decode per image serves every measure; images that don't fit their size give nulls, which
    the verdict turns into ABSTAIN.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, w, c, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                if data is None or h * w * c != len(data) or h * w == 0:
                    rows.append((i, *[None] * 9))
                    continue
                raw = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c).astype(np.float64)
                grey = area_resize(raw[:, :, 0] if c == 1 else raw[:, :, :3] @ np.array([0.114, 0.587, 0.299]))
                inner = grey[1:-1, :-2] + grey[1:-1, 2:] + grey[:-2, 1:-1] + grey[2:, 1:-1] - 4 * grey[1:-1, 1:-1] if min(grey.shape) > 2 else np.zeros((1, 1))
                filled, touches = framing(grey)
                rows.append((
                    i, float(inner.var()), float(grey.mean()), float(((grey <= 16) | (grey >= 239)).mean()), float(grey.std()),
                    largest_blob(grey >= 250, True) / grey.size, filled, touches, boundary_gradient(grey), dominant_skew(np.rint(grey)),
                ))
            yield pd.DataFrame(rows, columns=["image_id", "sharpness", "luminance", "clipped", "contrast", "glare", "filled", "touches_edge", "boundary", "skew"])

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(
        measure, "image_id string, sharpness double, luminance double, clipped double, contrast double, glare double, filled double, touches_edge boolean, boundary double, skew double"
    )


def verdict(policy: dict = POLICY) -> Column:
    """RETAKE with the first failing reason in order, PASS, or ABSTAIN without measurements."""
    c = F.col
    reason = (
        F.when(c("sharpness") < policy["blur"], "blur").when((c("luminance") < policy["dark"]) | (c("luminance") > policy["bright"]), "brightness")
        .when(c("clipped") > policy["clipped"], "clipped").when(c("glare") > policy["glare"], "glare").when(c("contrast") < policy["contrast"], "contrast")
    )
    return F.struct(F.when(c("sharpness").isNull(), "ABSTAIN").when(reason.isNotNull(), "RETAKE").otherwise("PASS").alias("verdict"), reason.alias("reason"))


def region_quality(sharpness: Column, contrast: Column, saturated: Column) -> Column:
    """Overall quality of a region: weighted sharpness and contrast, less where it is blown out."""
    base = 0.6 * F.least(sharpness / 150, F.lit(1.0)) + 0.4 * F.least(contrast / 50, F.lit(1.0))
    return F.coalesce(F.greatest(base * (1 - F.least(2 * saturated, F.lit(0.8))), F.lit(0.05)), F.lit(1.0))


def measurability(source: Column, validated: Column, error_mm: Column) -> Column:
    """Why a size can't be measured; null if it can."""
    return (
        F.when(source.isNull() | (source == "none"), "no scale").when(~F.coalesce(validated, F.lit(False)), "scale not validated")
        .when(F.coalesce(error_mm, F.lit(0.0)) <= 0, "no error bound")
    )


def letter_height_mm(pixels: Column, mm_per_pixel: Column) -> Column:
    return pixels * mm_per_pixel
