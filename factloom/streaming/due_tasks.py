"""The upload queue with its timers: tasks are put out when they are due, by keyed state and processing time.

One product's tasks are one key: its session, at most some dozens of artifacts, and its extraction job.
Events enqueue tasks and tell what became of attempts; the stream puts out which task is to be attempted
now. A task waits for what it depends on and for the end of its backoff, for which a timer is set; only
one task of a product is under way at a time, the lowest kind first, then queue order. Clock and timers
are the stream's processing time, and both state and timers are in its checkpoint. A stream that is started
again looks at its timers with its first batch, so a sender that starts again says so by an event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.upload_queue import BASE_SECONDS, CAP_SECONDS, FLOOR_SECONDS, KINDS, MAX_EXPONENT, TERMINAL

#: Events: enqueue a task, tell the outcome of its attempt (succeeded, retry, permanent), retry what failed, or restart the sender.
EVENTS = "product_id string, seq long, event string, task_id string, kind string, outcome string, jitter double"
DUE = "product_id string, task_id string, kind string, attempt int, due_ms long, now_ms long"
TASK_STATUS = "queued", "inFlight", *TERMINAL


def backoff_ms(attempts: int, jitter: float | None, base_seconds: float = BASE_SECONDS) -> int:
    """Wait after so many attempts: a share of the doubled base up to the cap, at least the floor."""
    cap = min(base_seconds * 2.0 ** min(max(attempts - 1, 0), MAX_EXPONENT), CAP_SECONDS)
    floor = FLOOR_SECONDS * min(1.0, base_seconds / BASE_SECONDS)
    return round(1000 * max(cap * (1.0 if jitter is None else jitter), floor))


class Queue:
    """The tasks of one product, as kept in the state."""

    def __init__(self, text: str | None = None):
        self.tasks: list[dict] = json.loads(text) if text else []

    def text(self) -> str:
        return json.dumps(self.tasks)

    def _find(self, task_id: str) -> dict | None:
        return next((t for t in self.tasks if t["id"] == task_id), None)

    def apply(self, event: str, task_id: str, kind: str, seq: int, outcome: str, jitter: float | None, now: int, base_seconds: float) -> None:
        task = self._find(task_id)
        if event == "enqueue":
            session_again = kind == "captureSession" and any(t["kind"] == kind for t in self.tasks)
            if task is None and not session_again:
                if kind == "extractionJob":  # an unfinished earlier request is replaced
                    self.tasks = [t for t in self.tasks if t["kind"] != kind or t["status"] in TERMINAL]
                self.tasks.append({"id": task_id, "kind": kind, "seq": seq, "status": "queued", "attempts": 0, "next": now})
        elif event == "restart":
            for t in self.tasks:
                t["status"] = "queued" if t["status"] == "inFlight" else t["status"]
        elif event == "retry" and task is not None and task["status"] == "failedPermanent":
            task.update(status="queued", next=now)
        elif event == "outcome" and task is not None and task["status"] == "inFlight":
            if outcome in ("succeeded", "permanent"):
                task["status"] = "succeeded" if outcome == "succeeded" else "failedPermanent"
            else:
                task.update(status="queued", next=now + backoff_ms(task["attempts"], jitter, base_seconds))

    def _free(self, task: dict) -> bool:
        """Whether what a task depends on is done."""
        if task["kind"] == "artifact":
            return any(t["kind"] == "captureSession" and t["status"] == "succeeded" for t in self.tasks)
        if task["kind"] == "extractionJob":
            return all(t["kind"] == "extractionJob" or t["status"] == "succeeded" for t in self.tasks)
        return True

    def due(self, now: int) -> dict | None:
        """Take the next task that is due, if none is under way."""
        if any(t["status"] == "inFlight" for t in self.tasks):
            return None
        ready = [t for t in self.tasks if t["status"] == "queued" and t["next"] <= now and self._free(t)]
        if not ready:
            return None
        task = min(ready, key=lambda t: (KINDS[t["kind"]], t["seq"]))
        task["status"], task["attempts"] = "inFlight", task["attempts"] + 1
        return task

    def wait(self, now: int) -> int | None:
        """Milliseconds until a task may become due with no more events; None if events have to come first."""
        if any(t["status"] == "inFlight" for t in self.tasks):
            return None
        waits = [t["next"] - now for t in self.tasks if t["status"] == "queued" and self._free(t)]
        return max(1, min(waits)) if waits else None


def due_tasks(events: DataFrame, base_seconds: float = BASE_SECONDS) -> DataFrame:
    """Stream of tasks to attempt, as they become due; events have the columns of ``EVENTS``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, now = Queue(state.get[0] if state.exists else None), state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples(index=False):
                jitter = None if pd.isna(r.jitter) else float(r.jitter)
                queue.apply(r.event, r.task_id, r.kind, int(r.seq), r.outcome, jitter, now, base_seconds)
        task = queue.due(now)
        state.update((queue.text(),))
        wait = queue.wait(now)
        if wait is not None:
            state.setTimeoutDuration(wait)
        out = [] if task is None else [(key[0], task["id"], task["kind"], task["attempts"], task["next"], now)]
        yield pd.DataFrame(out, columns=["product_id", "task_id", "kind", "attempt", "due_ms", "now_ms"]).astype({"attempt": "int32", "due_ms": "int64", "now_ms": "int64"})

    return events.groupBy("product_id").applyInPandasWithState(step, DUE, "tasks string", "append", GroupStateTimeout.ProcessingTimeTimeout)
