"""Skew against a plain Hough vote, the device's measures against plain loops, and reports of odd images."""

import math

import numpy as np
import pandas as pd
import pytest

from factloom.operators import image_checks as I
from factloom.operators import quality as Q
from factloom.plans import image_queries

IMAGE = "image_id string, height int, width int, channels int, data binary"


def striped(angle, size=400):
    y, x = np.mgrid[:size, :size]
    a = np.radians(angle)
    return (np.floor((y * np.cos(a) - x * np.sin(a) + 0.5) / 20) % 2 * 255).astype(float)


@pytest.mark.parametrize("angle", range(-44, 45, 8))
def test_skew_of_drawn_stripes(angle):
    assert abs(Q.dominant_skew(striped(angle)) - angle) <= 1
    assert abs(Q.dominant_skew(striped(angle).T) + angle) <= 1


def test_votes_and_fold():
    edges = np.random.default_rng(0).random((40, 30)) < 0.1
    votes = Q.line_votes(edges)
    for degree in (0, 17, 90, 133):
        want = {}
        for y, x in zip(*np.nonzero(edges), strict=True):
            rho = round(x * math.cos(math.radians(degree)) + y * math.sin(math.radians(degree)))
            want[rho] = want.get(rho, 0) + 1
        assert {int(r) - 70: int(votes[degree, r]) for r in np.flatnonzero(votes[degree])} == want
    assert Q.dominant_skew(np.full((300, 300), 90.0)) is None
    # many lines: only the 60 strongest count, which here are those of one direction
    mixed = np.vstack([striped(0, 1400)[:1300], striped(20, 1400)[:40]])
    assert Q.dominant_skew(mixed) == 0


def test_hysteresis_keeps_what_is_connected():
    v = np.full((20, 60), 100.0)
    v[:, 30:] = np.where(np.arange(20) < 10, 118, 190)[:, None]  # a weak upper half joins the strong lower one
    edges = Q.edge_pixels(v)
    assert edges[3, 29:31].any() and edges[15, 29:31].any()
    alone = np.full((20, 60), 100.0)
    alone[:, 30:] = 118
    assert not Q.edge_pixels(alone).any()


def test_device_measures_by_plain_loops():
    rng = np.random.default_rng(4)
    v = np.full((30, 40), 90.0)
    v[8:22, 9:33] = rng.integers(0, 256, (14, 24))
    v[10:14, 12:18] = 255
    got = I.client_values(v)
    lap = [v[y, x - 1] + v[y, x + 1] + v[y - 1, x] + v[y + 1, x] - 4 * v[y, x] for y in range(1, 29) for x in range(1, 39)]
    assert got["sharpness"] == pytest.approx(np.var(lap)) and got["luminance"] == pytest.approx(v.mean())
    seen, best = set(), 0
    for start in zip(*np.nonzero(v >= 250), strict=True):
        stack, size = [start], 0
        while stack:
            at = stack.pop()
            if at in seen or not (0 <= at[0] < 30 and 0 <= at[1] < 40) or v[at] < 250:
                continue
            seen.add(at)
            size += 1
            stack += [(at[0] + dy, at[1] + dx) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        best = max(best, size)
    assert got["blob"] == pytest.approx(best / v.size)
    rim = [
        math.hypot(v[y, x + 1] - v[y, x - 1], v[y + 1, x] - v[y - 1, x])
        for y in range(1, 29) for x in range(1, 39)
        if v[y, x] >= 250 and min(v[y, x - 1], v[y, x + 1], v[y - 1, x], v[y + 1, x]) < 250
    ]
    assert got["boundary"] == pytest.approx(np.mean(rim)) and got["touching"] == 0 and 0.2 < got["filled"] < 0.36
    assert I.client_values(np.zeros((2, 2)))["sharpness"] is None and I.client_values(np.zeros((7, 9)))["filled"] is None


def test_reports_of_odd_images_and_new_policies(spark):
    rng = np.random.default_rng(2)
    good = rng.integers(60, 200, (900, 1200, 3)).astype(np.uint8)
    rows = [("good", 900, 1200, 3, bytearray(good.tobytes())), ("cut", 9, 9, 3, bytearray(b"x")), ("none", None, None, None, None), ("tiny", 1, 1, 1, bytearray(b"\x80"))]
    images = spark.createDataFrame(rows, IMAGE)
    measures = I.client_measures(images).cache()
    text = spark.createDataFrame([("good", "legibility", "fail", 0.2)], "image_id string, check_id string, verdict string, value double")
    got = {r.image_id: r for r in I.client_scores(I.judged(measures, I.policies(spark), I.CLIENT, text)).collect()}
    assert (got["good"].source_width, got["good"].analysed_width, got["good"].analysed_height) == (1200, 800, 600)
    assert got["good"].overall == "fail" and got["good"].checks[-1].check_id == "legibility" and [c.verdict for c in got["cut"].checks] == ["unavailable"] * 4
    assert got["none"].overall == "unavailable" and {c.check_id: c.verdict for c in got["tiny"].checks}["brightness"] == "pass"
    assert {c.check_id: c.verdict for c in got["tiny"].checks}["blur"] == "unavailable" and got["tiny"].overall == "unavailable"
    strict = I.policies(spark).union(spark.createDataFrame([("mine", True, 800, 1, "blur", "sharpness", 1e9, None, None, None, False)], I.POLICY_SCHEMA))
    again = {r.image_id: r for r in I.judged(measures, strict, "mine").collect()}
    assert again["good"].reason == "blur" and again["good"].calibrated and len(again["good"].checks) == 1
    measures.unpersist()


def test_pictures_are_drawn_a_few_at_a_time():
    rows = pd.DataFrame({"image_id": [str(i) for i in range(100)], "tilt": range(100)})
    made = list(image_queries._stripes(iter([rows, rows[:0], rows[:1]])))
    assert max(map(len, made)) <= image_queries.DRAWN_ROWS
    assert [i for m in made for i in m["image_id"]] == [*rows["image_id"], "0"] and {len(x) for m in made for x in m["data"]} == {340 * 340}
