"""The queue's timers by a real clock: from enqueue to success after two retries, with a restart in between."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from factloom.operators import upload_queue
from factloom.streaming import due_tasks as D

BASE = 0.8


def test_queue_rules():
    q = D.Queue()
    now = 1_000_000
    put = lambda event, task, kind=None, outcome=None, at=now, seq=0: q.apply(event, task, kind, seq, outcome, 1.0, at, 5.0)
    put("enqueue", "j1", "extractionJob", seq=1)
    put("enqueue", "a1", "artifact", seq=2)
    put("enqueue", "s1", "captureSession", seq=3)
    put("enqueue", "s2", "captureSession", seq=4)
    put("enqueue", "j2", "extractionJob", seq=5)
    assert [t["id"] for t in q.tasks] == ["a1", "s1", "j2"]  # one session a product, the latest unfinished job
    assert q.due(now)["id"] == "s1" and q.due(now) is None and q.wait(now) is None
    put("outcome", "s1", outcome="retry")
    assert q.due(now) is None and q.wait(now) == 5000 and q.due(now + 4999) is None
    q = D.Queue(q.text())  # state is text
    assert q.due(now + 5000)["attempts"] == 2
    put("restart", None)
    assert q.due(now + 5000)["attempts"] == 3
    put("outcome", "s1", outcome="succeeded", at=now + 5000)
    assert q.due(now + 5000)["id"] == "a1"
    put("outcome", "a1", outcome="permanent", at=now + 5000)
    assert q.due(now + 9000) is None and q.wait(now + 9000) is None  # the job waits for the artifact, which waits for a person
    put("retry", "a1", at=now + 9000)
    assert q.due(now + 9000)["id"] == "a1"
    put("outcome", "a1", outcome="succeeded", at=now + 9000)
    assert q.due(now + 9000)["id"] == "j2"


@pytest.mark.parametrize("attempts,jitter", [(1, 0.5), (3, 1.0), (9, 0.9), (60, 0.1), (1, 0.0)])
def test_backoff_equals_the_batch_form(spark, attempts, jitter):
    from pyspark.sql import functions as F

    want = spark.range(1).select(upload_queue.backoff(F.lit(attempts), F.lit(jitter))).first()[0]
    assert D.backoff_ms(attempts, jitter) == round(want * 1000)


def test_from_enqueue_to_success_after_two_retries(spark, tmp_path):
    source, checkpoint, seen = tmp_path / "in", f"file://{tmp_path}/check", []
    source.mkdir()
    sent, kinds = [0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in D.EVENTS.split(", ")])

    def tell(*rows):
        sent[0] += 1
        values = zip(*[("p1", sent[0] * 10 + i, *r) for i, r in enumerate(rows)], strict=True)
        pq.write_table(pa.Table.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, fields, strict=True)], schema=fields), tmp_path / f"draft{sent[0]}")
        (tmp_path / f"draft{sent[0]}").rename(source / f"{sent[0]:03d}.parquet")

    def start():
        stream = D.due_tasks(spark.readStream.schema(D.EVENTS).parquet(str(source)), BASE)
        put = lambda batch, n: seen.extend(r.asDict() for r in batch.collect())
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()

    def until(count):
        ends = time.time() + 90
        while len(seen) < count and time.time() < ends and run.isActive:
            time.sleep(0.05)
        assert len(seen) >= count, run.exception()

    run = start()
    try:
        tell(("enqueue", "job", "extractionJob", None, None), ("enqueue", "img", "artifact", None, None), ("enqueue", "ses", "captureSession", None, None))
        until(1)
        tell(("outcome", "ses", None, "retry", 1.0))
        until(2)
        tell(("outcome", "ses", None, "retry", 1.0))
        time.sleep(0.3)
        run.stop()  # the wait goes on while nothing runs; state and timer are in the checkpoint
        run.awaitTermination(60)
        run = start()
        tell(("restart", None, None, None, None))  # what a sender says when it starts again; the first batch looks at all timers
        until(3)
        tell(("outcome", "ses", None, "succeeded", None))
        until(4)
        tell(("outcome", "img", None, "succeeded", None))
        until(5)
        tell(("outcome", "job", None, "succeeded", None))
        time.sleep(2)
    finally:
        run.stop()
    assert [(r["task_id"], r["attempt"]) for r in seen] == [("ses", 1), ("ses", 2), ("ses", 3), ("img", 1), ("job", 1)]
    assert all(r["now_ms"] >= r["due_ms"] for r in seen)
    assert seen[1]["due_ms"] - seen[0]["now_ms"] >= BASE * 1000 and seen[2]["due_ms"] - seen[1]["now_ms"] >= 2 * BASE * 1000
