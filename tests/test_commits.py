"""Commits of several tables: failure between tables, races, retries, streams; puts and verified reads."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from factloom.sources import commits, store
from factloom.sources.commits import CommitLog

RUN = "run_id string, status string"
OBJECT = "artifact_id string, sha256 string, content binary"


def run_tables(spark, *ids):
    runs = spark.createDataFrame([(i, "completed") for i in ids], RUN)
    return {"runs": runs, "observations": runs.select("run_id", F.lit("{}").alias("payload")), "quarantined": runs.filter("false").select("run_id", F.lit("x").alias("reason"))}


def objects(spark, *named):
    rows = [(name, hashlib.sha256(data).hexdigest(), bytearray(data)) for name, data in named]
    return spark.createDataFrame(rows, OBJECT)


def ids(log, table="runs"):
    found = log.read(table)
    return sorted(r.run_id for r in found.collect()) if found is not None else []


def test_a_failure_between_tables_leaves_nothing(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/store")
    assert commits.record_run(log, "one", **run_tables(spark, "r1"))
    broken = run_tables(spark, "r2")
    broken["observations"] = broken["observations"].withColumn("payload", F.raise_error(F.lit("lost the node")))
    with pytest.raises(Exception, match="lost the node"):
        commits.record_run(log, "two", **broken)
    assert ids(log) == ["r1"] and ids(log, "observations") == ["r1"] and len(log.unpublished()) >= 1
    assert commits.record_run(log, "two", **run_tables(spark, "r2")) and not commits.record_run(log, "two", **run_tables(spark, "r2"))
    assert ids(log) == ids(log, "observations") == ["r1", "r2"] and ids(log, "quarantined") == []


def test_a_version_is_published_once(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"file://{tmp_path}/store")
    log.publish("a", [], 0)
    with pytest.raises(commits.Lost):
        log.publish("b", [], 0)
    assert [(e.version, e.batch_id) for e in log.entries()] == [(0, "a")]
    # a writer that looked before another one published takes the next number
    seen, real = [], CommitLog.entries
    monkeypatch.setattr(CommitLog, "entries", lambda self: seen.append(1) or ([] if len(seen) == 1 else real(self)))
    assert log.commit("c", run_tables(spark, "r9"))
    assert [(e.version, e.batch_id) for e in real(log)] == [(0, "a"), (1, "c")] and len(seen) == 2


def test_writers_at_once(spark, tmp_path):
    log, done = CommitLog(spark, f"file://{tmp_path}/store"), []
    many = [threading.Thread(target=lambda k=k: done.append(log.commit(f"b{k % 3}", run_tables(spark, f"r{k % 3}")))) for k in range(6)]
    for t in many:
        t.start()
    for t in many:
        t.join(240)
    assert sorted(done) == [False] * 3 + [True] * 3 and ids(log) == ["r0", "r1", "r2"]


def test_two_writers_of_a_key_leave_one(spark, tmp_path):
    log, found = CommitLog(spark, f"file://{tmp_path}/store"), {}
    wait = threading.Barrier(2)

    def put(name, data):
        rows = objects(spark, ("a", data), (name, b"own"))
        wait.wait()
        found[name] = commits.put_artifacts(log, rows).collect()

    both = [threading.Thread(target=put, args=x) for x in (("x", b"first"), ("y", b"second"))]
    for t in both:
        t.start()
    for t in both:
        t.join(240)
    held = {r.artifact_id: bytes(r.content) for r in log.read("artifacts").collect()}
    assert sorted(held) == ["a", "x", "y"] and log.read("artifacts").count() == 3
    loser = "y" if held["a"] == b"first" else "x"
    assert {n: len(c) for n, c in found.items()} == {loser: 1, ({"x", "y"} - {loser}).pop(): 0}
    assert commits.put_artifacts(log, objects(spark, ("a", held["a"]))).count() == 0 and log.read("artifacts").count() == 3


def test_stream_of_runs_is_committed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("r1", "completed"), ("r2", "quarantined")], RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = CommitLog(spark, f"file://{tmp_path}/store")
    plan = lambda b: {"runs": b, "quarantined": b.filter("status = 'quarantined'").select("run_id")}
    for checkpoint in ("c1", "c1", "c2"):  # the third run has lost its checkpoint and replays batch 0
        commits.record_stream(spark.readStream.schema(RUN).parquet(str(tmp_path / "in")), log, plan, str(tmp_path / checkpoint)).awaitTermination(120)
    assert ids(log) == ["r1", "r2"] and ids(log, "quarantined") == ["r2"] and len(log.entries()) == 1


def test_verified_and_pruned_reads(spark, tmp_path, capsys):
    log = CommitLog(spark, f"file://{tmp_path}/store")
    commits.put_artifacts(log, objects(spark, *[(f"a{i}", f"data {i}".encode()) for i in range(20)]))
    stored, digest = log.read("artifacts"), hashlib.sha256(b"data 3").hexdigest()
    commits.put_artifacts(log, spark.createDataFrame([("bad", digest, bytearray(b"changed"))], OBJECT))
    wanted = spark.createDataFrame([("a3", digest.upper()), ("a4", digest), ("gone", digest), ("bad", digest)], "artifact_id string, sha256 string")
    got = {r.artifact_id: (r.status, r.content and bytes(r.content)) for r in store.verified(log.read("artifacts"), wanted).collect()}
    assert got == {"a3": ("ok", b"data 3"), "a4": ("missing", None), "gone": ("missing", None), "bad": ("mismatch", None)}
    row = store.one(stored, "a3", digest)
    assert bytes(row.first().content) == b"data 3"
    row.explain("formatted")
    plan = capsys.readouterr().out
    assert f"(d1#" in plan.split("PartitionFilters")[1].split("\n")[0] and f"= {digest[2:4]}" in plan.split("PartitionFilters")[1].split("\n")[0]
    there = store.existing(stored, wanted.withColumn("sha256", F.lower("sha256")))
    there.explain("formatted")
    plan = capsys.readouterr().out
    assert [r.artifact_id for r in there.collect()] == ["a3"] and "content" not in "".join(x for x in plan.split("\n") if "ReadSchema" in x)
    store.record_of(stored, "artifact_id", "a5").explain("formatted")
    assert "EqualTo(artifact_id,a5)" in capsys.readouterr().out
