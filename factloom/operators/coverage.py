"""Capture coverage: step states, acceptance, product and inspection roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RETRY_LIMIT = 3
#: Verdicts in the order of severity.
VERDICTS = ("pass", "unavailable", "warn", "fail")


def overall_verdict(rows: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """Worst verdict of each group; unavailable where there is none."""
    rank = F.when(F.col(verdict).isNull(), None)
    for i, v in enumerate(VERDICTS):
        rank = rank.when(F.col(verdict) == v, i)
    worst = F.max(rank)
    return rows.groupBy(*keys).agg(F.coalesce(F.get(F.array(*[F.lit(v) for v in VERDICTS]), worst), F.lit("unavailable")).alias("overall"))


def step_states(steps: DataFrame, captures: DataFrame, retry_limit: int = RETRY_LIMIT) -> DataFrame:
    """Failed attempts, attempts left and status of every surface step.

    steps: product_id, surface_id, ordinal, is_required, accepted_capture_id, skip_reason.
    captures: product_id, surface_id, capture_id, attempt, verdict.
    """
    tried = captures.groupBy("product_id", "surface_id").agg(F.count_if(F.col("verdict") == "fail").alias("failed"))
    accepted = captures.select(F.col("capture_id").alias("accepted_capture_id"), F.col("verdict").alias("accepted_verdict"))
    joined = steps.join(tried, ["product_id", "surface_id"], "left").join(accepted, "accepted_capture_id", "left")
    failed = F.coalesce("failed", F.lit(0))
    status = (
        F.when(F.col("accepted_capture_id").isNotNull() & (F.col("accepted_verdict") == "fail"), "capturedNeedsReview")
        .when(F.col("accepted_capture_id").isNotNull(), "captured").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("pending")
    )
    return joined.select(
        "product_id", "surface_id", "ordinal", "is_required", failed.cast("long").alias("failed_attempts"),
        F.greatest(F.lit(retry_limit) - failed, F.lit(0)).cast("long").alias("attempts_left"), status.alias("status"),
    )


def product_coverage(states: DataFrame) -> DataFrame:
    """Counts, completeness, steps for manual review and the next step of every product."""
    done = F.col("status") != "pending"
    return states.groupBy("product_id").agg(
        F.count_if("is_required").alias("required"), F.count_if(F.col("is_required") & done).alias("required_done"),
        F.bool_and(~F.col("is_required") | done).alias("complete"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "capturedNeedsReview", F.col("surface_id")))).alias("review"),
        F.min(F.when(F.col("is_required") & ~done, F.struct("ordinal", "surface_id"))).alias("n"),
    ).select("product_id", "required", "required_done", "complete", "review", F.col("n")["surface_id"].alias("next_step"))


def inspection_rollup(products: DataFrame) -> DataFrame:
    return products.groupBy("inspection_id").agg(F.count_if("complete").alias("complete_products"), F.bool_or(~F.col("complete")).alias("has_incomplete"))


def acceptance(verdict: Column, failed_attempts: Column, retry_limit: int = RETRY_LIMIT) -> Column:
    """Disposition on accept: a failing capture is blocked until enough attempts have failed."""
    return F.when(verdict != "fail", "accepted").when(failed_attempts >= retry_limit, "acceptedUnderManualReview").otherwise("blocked")


def accepted_sequence(states: DataFrame) -> DataFrame:
    """Accepted steps with sequence_index 1..n in the order of the steps."""
    order = W.partitionBy("product_id").orderBy("ordinal", "surface_id")
    return states.filter(F.col("status").startswith("captured")).withColumn("sequence_index", F.row_number().over(order))


def distinct_lines(lines: DataFrame, overlap: float = 0.6) -> DataFrame:
    """Lines of every capture without repeats: of two that overlap by more than ``overlap`` of the smaller one the larger stays.

    lines: capture_id, seq, left, top, right, bottom. A capture is one photograph, so its lines are
    few; they are folded in one row, the largest first and the first read of equals.
    """
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])

    def repeats(a: Column, b: Column) -> Column:
        width = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
        height = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
        smaller = F.least(area(a), area(b))
        return (width > 0) & (height > 0) & (smaller > 0) & (width * height / smaller > overlap)

    sides = [F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")]
    here = F.struct(*sides)
    row = F.struct((-area(here)).alias("minus"), F.col("seq").cast("long").alias("seq"), *sides)
    listed = lines.groupBy("capture_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda done, r: F.when(F.exists(done, lambda d: repeats(d, r)), done).otherwise(F.concat(done, F.array(r))))
    return listed.select("capture_id", F.explode(kept).alias("r")).select("capture_id", "r.seq", "r.left", "r.top", "r.right", "r.bottom")


def legibility(lines: DataFrame, min_lines: int = 3, order: str | None = None) -> DataFrame:
    """(capture_id, n, score, verdict): too few lines fail with half their legible share, else the mean confidence, or without any the legible share, decides.

    A sum of doubles depends on its order, and a mean may lie on a bound: with the column ``order`` lines are added up by it, so that every rerun decides alike.
    """
    total = F.sum("confidence")
    if order:
        lines = lines.withColumn("so_far", total.over(W.partitionBy("capture_id").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))
        total = F.max_by("so_far", order)
    stats = lines.groupBy("capture_id").agg(
        F.count("*").alias("n"), (total / F.count("confidence")).alias("mean"), F.avg(F.when(F.col("legible"), 1.0).otherwise(0.0)).alias("share")
    )
    few, told = F.col("n") < min_lines, F.coalesce("mean", "share")
    low, high = F.when(F.col("mean").isNull(), 0.30).otherwise(0.50), F.when(F.col("mean").isNull(), 0.60).otherwise(0.70)
    verdict = F.when(few | (told < low), "fail").when(told < high, "warn").otherwise("pass")
    score = F.when(few, F.col("share") * 0.5).otherwise(F.greatest(F.least(told, F.lit(1.0)), F.lit(0.0)))
    return stats.select("capture_id", "n", score.alias("score"), verdict.alias("verdict"))


def skip_is_valid(reason: Column, note: Column) -> Column:
    """Any reason but "other" stands alone; "other" needs a note that says something."""
    return reason.isNotNull() & ((reason != "other") | (F.trim(F.coalesce(note, F.lit(""))) != ""))


def manual_entry_allowed(failures: Column, seconds: Column) -> Column:
    return (failures >= 3) | (seconds >= 15)


def context_declared(revisions: DataFrame, *flags: str) -> DataFrame:
    """(product_id, declared_at): the first revision with every flag answered."""
    answered = None
    for f in flags:
        answered = F.col(f).isNotNull() if answered is None else answered & F.col(f).isNotNull()
    return revisions.groupBy("product_id").agg(F.min(F.when(answered, F.col("revised_at"))).alias("declared_at"))


def apply_step_events(events: DataFrame) -> DataFrame:
    """(product_id, surface_id, accepted_capture_id, skip_reason) after all events, applied in the order of seq.

    events: product_id, surface_id, seq, action (accept, retake, skip, clear), capture_id, reason. To
    accept sets the capture and lifts a skip; to skip sets the reason and drops the capture; to clear
    lifts a skip; to retake drops the capture if it is the accepted one. Only what lies after the
    last event that sets or drops a part matters, so two windows say it without a fold.
    """
    step = W.partitionBy("product_id", "surface_id").orderBy("seq")
    so_far = step.rowsBetween(W.unboundedPreceding, -1)
    action = F.col("action")
    setter = F.when(action == "accept", F.col("capture_id")).when(action == "skip", F.lit(""))
    standing = F.last(setter, ignorenulls=True).over(so_far)
    drops = (action == "retake") & (standing == F.col("capture_id"))
    dropped = events.withColumn("__set", F.coalesce(setter, F.when(drops, F.lit(""))))
    reason = F.when(action == "skip", F.coalesce("reason", F.lit("other"))).when(action.isin("accept", "clear"), F.lit(""))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    final = dropped.withColumn("__reason", reason).groupBy("product_id", "surface_id").agg(last(F.col("__set")).alias("c"), last(F.col("__reason")).alias("r"))
    return final.select("product_id", "surface_id", F.nullif("c", F.lit("")).alias("accepted_capture_id"), F.nullif("r", F.lit("")).alias("skip_reason"))


def finish_gate(states: DataFrame, context_complete: DataFrame) -> DataFrame:
    """(product_id, outstanding, may_finish): required steps and a context still open; finishing needs none of them.

    states: product_id, ordinal, surface_id, is_required, status; context_complete: product_id, complete.
    """
    waiting = F.when(F.col("is_required") & (F.col("status") == "pending"), F.struct("ordinal", "surface_id"))
    steps = states.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(waiting)), lambda s: s["surface_id"]).alias("open"))
    joined = steps.join(context_complete, "product_id", "left")
    also = F.when(F.coalesce("complete", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("context")))
    return joined.select("product_id", F.concat("open", also).alias("outstanding")).withColumn("may_finish", F.size("outstanding") == 0)


def accept_gate(disposition: Column) -> Column:
    """Whether a capture may be accepted as it is: all but a blocked one."""
    return disposition != "blocked"
