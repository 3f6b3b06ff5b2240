"""Classes are dealt in parts: every pair is measured, and integers do not travel by the pair."""

import os

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import audio_fingerprint as af


def recordings(spark, rows):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, pcm binary")


def sharing(n, passage, own):
    """Recordings with one passage in common."""
    noise = np.random.default_rng(5)
    shared = noise.integers(97, 123, passage, dtype=np.uint8).tobytes()
    return [(i, noise.integers(97, 123, own, dtype=np.uint8).tobytes() + shared) for i in range(n)]


def near_copies(n, size):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, size, dtype=np.uint8)
    out = []
    for i in range(n):
        own = base.copy()
        own[rng.integers(0, size, 3)] = 65 + i % 26
        out.append((i, own.tobytes()))
    return out


def stages(spark):
    """Bytes that each stage has shuffled, by its number."""
    gateway, store = spark.sparkContext._gateway, spark._jsc.sc().statusStore()
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def test_integers_do_not_travel_by_the_pair(spark):
    media = recordings(spark, sharing(120, 2_048, 8_192))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    before = max(stages(spark), default=-1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = af.match_recordings(media, "pcm", F.col("doc_id") < 60).filter("query_id is not null").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len({(r.query_id, r.class_id) for r in got}) == len(got) == 60 * 119  # each class has 1.2 kB of integers
    moved = sum(n for k, n in stages(spark).items() if k > before)
    assert 1e6 < moved < 6.5e6  # it was 9.1e6 with integers in every pair
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [f for f in os.listdir(folder) if f.startswith("fingerprints-")]


def test_parts_change_nothing(spark, monkeypatch):
    rows = near_copies(30, 4_000)
    rng = np.random.default_rng(4)
    rows += [(7, rng.integers(97, 123, 2_000, dtype=np.uint8).tobytes() + rows[0][1][:2_000]), (40, b""), (41, b"short")]  # an id twice, with another sound
    run = lambda: sorted(af.match_recordings(recordings(spark, rows), "pcm", F.col("doc_id") % 5 == 0).collect(), key=str)
    monkeypatch.setattr(af, "PART_BYTES", 1 << 40)
    one = run()
    monkeypatch.setattr(af, "PART_BYTES", 1)
    assert run() == one
    assert len([r for r in one if r.query_id is None]) == len(rows)
    assert len([r for r in one if (r.query_id, r.class_id) == (0, 7)]) == 2
