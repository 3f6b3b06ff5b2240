"""Streaming forms: artifact ingest without duplicates, and the upload queue as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.upload_queue import BASE_SECONDS, CAP_SECONDS, MAX_EXPONENT

TASK_STATE = "status string, attempts int"
TASK_OUTPUT = "task_id string, status string, attempts int, wait_cap double"


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once while the watermark allows for late repeats."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def task_states(attempts: DataFrame) -> DataFrame:
    """Status of every task after each batch of its attempts (task_id, seq, outcome).

    Terminal states stay; a retry queues the task again with a longer wait, whose cap is put out (the
    jitter is the sender's). State is one small row a task and survives restarts in the checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, count = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for outcome in rows["outcome"]:
            if status in ("succeeded", "failedPermanent"):
                break
            count += 1
            status = {"succeeded": "succeeded", "permanent": "failedPermanent"}.get(outcome, "queued")
        state.update((status, count))
        cap = float(min(BASE_SECONDS * 2.0 ** min(count - 1, MAX_EXPONENT), CAP_SECONDS)) if status == "queued" and count else 0.0
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempts": [count], "wait_cap": [cap]})

    return attempts.groupBy("task_id").applyInPandasWithState(step, TASK_OUTPUT, TASK_STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and key; windows close when the watermark has passed them."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply a batch plan to every micro-batch and append its result, once per batch id."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
