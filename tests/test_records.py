"""Sinks, streaming, image measures and the registered queries' names."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import quality
from factloom.plans import record_queries
from factloom.sources import files, sinks
from factloom.streaming import queue_state


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    rows = lambda *r: spark.createDataFrame(list(r), "artifact_id string, sha256 string")
    assert sinks.write_artifacts(rows(("a", "aa11"), ("b", "bb22"), ("b", "cc33")), path).count() >= 1
    sinks.write_artifacts(rows(("a", "aa11"), ("d", "dd44")), path)
    assert sorted(r.artifact_id for r in spark.read.parquet(path).collect()) == ["a", "b", "d"]


def test_queue_state(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "check"
    source.mkdir()
    schema = "task_id string, seq int, outcome string"
    outcomes = [("t1", 1, "retry"), ("t1", 2, "retry"), ("t2", 1, "permanent"), ("t2", 2, "succeeded"), ("t3", 1, "succeeded")]
    pd.DataFrame(outcomes, columns=["task_id", "seq", "outcome"]).astype({"seq": "int32"}).to_parquet(source / "a.parquet")
    stream = queue_state.task_states(spark.readStream.schema(schema).parquet(str(source)))
    run = stream.writeStream.outputMode("update").format("memory").queryName("tasks").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.task_id: (r.status, r.attempts, r.wait_cap) for r in spark.table("tasks").collect()}
    assert got == {"t1": ("queued", 2, 10.0), "t2": ("failedPermanent", 1, 0.0), "t3": ("succeeded", 1, 0.0)}


def test_batches_and_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    times = pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 05:00"])
    pd.DataFrame({"k": ["a", "a", "b"], "ts": times.astype("datetime64[us]")}).to_parquet(source / "a.parquet")
    stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    run = queue_state.run_batches(queue_state.deduplicated(stream, "k", "ts"), lambda b: b.select("k"), str(tmp_path / "out"), str(tmp_path / "c"))
    run.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_image_measures(spark):
    flat = np.full((20, 30, 3), 128, np.uint8)
    edge = flat.copy()
    edge[:, 15:] = 255
    rows = [(name, 20, 30, 3, bytearray(a.tobytes())) for name, a in (("flat", flat), ("edge", edge))] + [("bad", 20, 30, 3, bytearray(b"x"))]
    measured = quality.measure_images(spark.createDataFrame(rows, "image_id string, height int, width int, channels int, data binary"))
    got = {r.image_id: r for r in measured.select("*", quality.verdict().alias("v")).collect()}
    assert got["flat"].sharpness == 0 and abs(got["flat"].luminance - 128) < 1e-6 and got["flat"].v.verdict == "RETAKE"
    assert got["edge"].glare == 0.5 and got["bad"].v.verdict == "ABSTAIN"


@pytest.mark.parametrize("diagonal,size", [(True, 3), (False, 2)])
def test_largest_blob(diagonal, size):
    mask = np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0]], bool)
    assert quality.largest_blob(mask, diagonal) == size


def test_area_resize_keeps_the_mean():
    image = np.random.default_rng(0).integers(0, 255, (90, 130))
    small = quality.area_resize(image, 64)
    assert max(small.shape) == 64 and abs(small.mean() - image.mean()) < 1


def test_words_without_confidence_are_left_out(spark):
    words = [("i", 1, 1, 1, 1, s, t, c, 10 * s, 0, 8, 5) for s, (t, c) in enumerate([("Net", 90.0), ("", 90.0), ("Wt", 80.0), ("x", -1.0)])]
    line = files.words_to_lines(spark.createDataFrame(words, "image string, page int, block int, par int, line int, seq int, text string, confidence double, x int, y int, w int, h int")).first()
    assert (line.text, line.l, line.r, line.confidence) == ("Net Wt", 0, 28, 0.85)


def test_word_error_rates_of_whole_documents(spark, tmp_path):
    from factloom.plans.record_queries import word_error_rates

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    text = lambda n: "\n".join(" ".join(rng.choice(["a", "b", "c", "d"], 6)) for _ in range(n))
    docs, items = [(i, text(i % 30)) for i in range(60)] + [(99, None)], [(i, text(i)) for i in range(18)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.wer for r in word_error_rates(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want, read = (t or "").split(), dict(items).get(i % 20, "").split()
        assert got[i] == (plain(want, read) / len(want) if want else float(bool(read)))


def test_engines():
    assert files.build_engine("words") is files.words_to_lines
    with pytest.raises(KeyError):
        files.build_engine("none")


def test_every_oracle_has_its_query():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_legibility_is_alike_however_lines_are_dealt(spark, tmp_path):
    """0.2 + 0.4 + 0.9 depends on its order, and its mean lies on a bound: the table's order decides, in whatever parts it is read."""
    told = [0.02, 0.04, 0.09]
    part = lambda *at: spark.createDataFrame([(k, told[(k + i) % 3], 20.0) for i in at for k in range(300)], "l_orderkey long, l_discount double, l_quantity double").coalesce(1)
    part(0).write.parquet(f"{tmp_path}/lineitem.parquet/p=0")
    part(1, 2).write.parquet(f"{tmp_path}/lineitem.parquet/p=1")  # a task of its own adds up the last two
    means = {k: (told[k % 3] * 10 + told[(k + 1) % 3] * 10 + told[(k + 2) % 3] * 10) / 3 for k in range(300)}
    assert len({x < 0.5 for x in means.values()}) == 2
    got = {}
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        got[most] = {r.capture_id: r.verdict for r in record_queries.legibility(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["128m"] == got["1k"] == {k: "fail" if x < 0.5 else "warn" for k, x in means.items()}


def test_entries_are_parsed_in_one_place_and_no_window(spark):
    quad = "[[1,2],[3.5,2],[3,4],[1,4]]"
    odd = '[null,"x",{"a":1},[[%s,["a",NaN]],[[[1,2],["3",2],[3,4],[1,4]],["b",1]],[[[1,2],[3,2],7,[1,4]],["c",1]],[[[1,2,"z"],[3,2],[3,4],[1,null]],["d",1]],[%s,[5,"0.5"],9],[%s,["e"]],5,null]]' % (quad, quad, quad)
    rows = [("i", 1, "hi", '[[[%s,["last",true]]]]' % quad), ("i", 0, "en", odd), ("j", 0, "en", "[[oops"), ("k", 0, "en", None)]
    found = files.recognised_entries(spark.createDataFrame(rows, "image string, pass int, language string, result string"))
    got = sorted((r.image, r.seq, r.text, r.language, repr(r.confidence)) for r in found.collect())
    assert got == [("i", 0, "a", "en", "nan"), ("i", 1, "5", "en", "0.5"), ("i", 2, "last", "hi", "None")]
    assert [(p.x, p.y) for p in found.filter("seq = 0").first().geom.points] == [(1, 2), (3.5, 2), (3, 4), (1, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and sum("from_json" in line for line in plan.splitlines()) == 1


def test_entries_without_a_text_have_no_corners_parsed(spark):
    """What can be no array is not parsed, and corners only where something was read; both were exceptions or work for nothing."""
    result = '["odd",7,[["no",["blank",1]],"odd",[[[1,2],[3,2],[3,4],[1,4]],["  ",1]],["broken",["none"]],[[[1,2],[3,2],[3,4],[1,4]],["a",0.5]]]]'
    found = files.recognised_entries(spark.createDataFrame([("i", 0, "en", result), ("j", 0, "en", "none"), ("k", 0, "en", "\n [[[[[1,2],[3,2],[3,4],[1,4]],[\"b\",1]]]]")], "image string, pass int, language string, result string"))
    assert sorted((r.image, r.seq, r.text) for r in found.collect()) == [("i", 0, "a"), ("k", 0, "b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") + plan.count("contains(") >= 3
