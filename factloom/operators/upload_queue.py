"""Upload queue: prerequisites, due tasks, transitions, backoff and counters in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE_SECONDS, CAP_SECONDS, FLOOR_SECONDS, MAX_EXPONENT = 5, 600, 1, 20
KINDS = {"captureSession": 0, "artifact": 1, "extractionJob": 2}
TERMINAL = ("succeeded", "failedPermanent")


def kind_order(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind)


def recovered(status: Column) -> Column:
    """What was in flight when the process ended is queued again."""
    return F.when(status == "inFlight", "queued").otherwise(status)


def backoff_cap(attempts: Column) -> Column:
    """Upper end of the jittered wait after so many attempts, in seconds."""
    return F.least(F.lit(BASE_SECONDS) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(MAX_EXPONENT))), F.lit(float(CAP_SECONDS)))


def backoff(attempts: Column, uniform: Column) -> Column:
    """Full jitter: a share of the cap, at least the floor; ``uniform`` is in [0, 1)."""
    return F.greatest(uniform * backoff_cap(attempts), F.lit(float(FLOOR_SECONDS)))


def deduplicate(tasks: DataFrame) -> DataFrame:
    """One session task a product, and of its unfinished extraction jobs only the latest."""
    session = W.partitionBy("product_id", "kind").orderBy("seq")
    live = ~F.col("status").isin(*TERMINAL)
    latest = W.partitionBy("product_id", "kind", live).orderBy(F.col("seq").desc())
    ranked = tasks.withColumn("__first", F.row_number().over(session)).withColumn("__last", F.row_number().over(latest))
    kept = ranked.filter(((F.col("kind") != "captureSession") | (F.col("__first") == 1)) & ((F.col("kind") != "extractionJob") | ~live | (F.col("__last") == 1)))
    return kept.drop("__first", "__last")


def with_blocked(tasks: DataFrame) -> DataFrame:
    """Add ``blocked``: an artifact waits for its session, a job for all else of its product."""
    product = W.partitionBy("product_id")
    session_done = F.coalesce(F.bool_or((F.col("kind") == "captureSession") & (F.col("status") == "succeeded")).over(product), F.lit(False))
    rest_done = F.coalesce(F.bool_and((F.col("kind") == "extractionJob") | (F.col("status") == "succeeded")).over(product), F.lit(False))
    blocked = F.when(F.col("kind") == "artifact", ~session_done).when(F.col("kind") == "extractionJob", ~rest_done).otherwise(F.lit(False))
    return tasks.withColumn("blocked", blocked)


def due_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """The next task of each product: queued, unblocked, its time come; lowest kind, then queue order."""
    ready = with_blocked(tasks).filter((F.col("status") == "queued") & ~F.col("blocked") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    order = W.partitionBy("product_id").orderBy(kind_order(F.col("kind")), "seq")
    return ready.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def after_attempt(outcome: Column, attempts: Column) -> Column:
    """(status, attempt_count) after one attempt with this outcome."""
    status = F.when(outcome == "succeeded", "succeeded").when(outcome == "permanent", "failedPermanent").otherwise("queued")
    return F.struct(status.alias("status"), (attempts + 1).alias("attempt_count"))


def retried(status: Column) -> Column:
    """Manual retry of what failed; what succeeded stays."""
    return F.when(status == "failedPermanent", "queued").otherwise(status)


def counters(tasks: DataFrame, *keys: str) -> DataFrame:
    one = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return tasks.groupBy(*keys).agg(one("queued", "pending"), one("inFlight", "in_flight"), one("succeeded", "succeeded"), one("failedPermanent", "failed"))


def enqueue_artifacts(tasks: DataFrame, captures: DataFrame, now: Column) -> DataFrame:
    """The queue with a task for every accepted capture that has none yet, due at once, behind what is queued.

    tasks: task_id, seq, product_id, kind, status, attempts, next_attempt_at, capture_id, payload;
    captures: capture_id, product_id, captured_at, payload (its metadata bundle).
    """
    new = captures.join(tasks.filter("kind = 'artifact'").select("capture_id"), "capture_id", "left_anti")
    last = tasks.groupBy("product_id").agg(F.max("seq").alias("last"))
    place = F.row_number().over(W.partitionBy("product_id").orderBy("captured_at", "capture_id"))
    placed = new.withColumn("place", place).join(last, "product_id", "left")
    made = {
        "task_id": F.concat(F.lit("UP-"), F.col("capture_id").cast("string")), "seq": F.coalesce("last", F.lit(0)) + F.col("place"), "product_id": F.col("product_id"), "kind": F.lit("artifact"),
        "status": F.lit("queued"), "attempts": F.lit(0), "next_attempt_at": now, "capture_id": F.col("capture_id"), "payload": F.col("payload"),
    }
    kinds = dict(tasks.dtypes)
    return tasks.unionByName(placed.select(*[made[c].cast(kinds[c]).alias(c) if c in made else F.lit(None).cast(kinds[c]).alias(c) for c in tasks.columns]))
