"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow randomised trees are grown on a bounded sample of labelled documents; every path from a
root is a rule, a conjunction of comparisons on statistics. A logistic model with lasso penalty
weighs the rules, most weights become zero, and what is left is compiled into one Spark expression
that scores every document on the JVM.

Only the fit sees labels, and only of rows whose crc32(id) mod ``FOLDS`` is not ``HELD_OUT``. The fit
takes at most ``MAX_FIT_ROWS`` of them, in the order of a hash of the id; all documents are scored.
Labels are counted first, and only those whose hash lies below the share that the bound leaves are
sorted and sent to the driver, so what it gets does not grow with the labels.

Defined cases: null and empty texts have all statistics zero and get a score like any other; without
labels of both kinds the score is the smoothed share of label 1; repeated rows get repeated results;
an empty table gives an empty result; ids, languages, sources and lengths in other columns are not
read as statistics, whatever the columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, let, materialise, table
from factloom.llm.quality_rules import text_statistics

FOLDS = 4
HELD_OUT = 2
MAX_FIT_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 48
MIN_SUPPORT = 0.004
LASSO = 0.0008
STEPS = 400
SEED = 11
CUTOFF = 0.7
FEATURES = (
    "n_words", "word_len", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words", "bare",
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"


def statistics(text: Column) -> Column:
    """Struct of the statistics that rules compare; all zero for a text without words."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x: F.char_length(x) == 1)).alias("single"),
        ),
    )
    bare = lambda drop: F.char_length(F.translate(whole, drop, ""))
    raw = F.struct(
        text_statistics(text).alias("t"), of_words.alias("w"), F.char_length(whole).alias("n"),
        bare(UPPER).alias("no_upper"), bare("0123456789").alias("no_digits"), bare(MARKS).alias("no_marks"),
    )

    def ratios(x: Column) -> Column:
        words, chars, lines = (F.greatest(x["t"][k], F.lit(1)).cast("double") for k in ("n_words", "word_chars", "n_lines"))
        return F.struct(
            x["t"]["n_words"].cast("double").alias("n_words"),
            (x["t"]["word_chars"] / words).alias("word_len"),
            (x["t"]["n_symbols"] / chars).alias("symbols"),
            (x["t"]["n_dup_lines"] / lines).alias("dup_lines"),
            (x["t"]["n_repeat_words"] / words).alias("repeats"),
            ((x["n"] - x["no_upper"]) / chars).alias("upper"),
            ((x["n"] - x["no_digits"]) / chars).alias("digits"),
            ((x["n"] - x["no_marks"]) / chars).alias("marks"),
            (x["w"]["distinct"] / words).alias("distinct"),
            (x["t"]["n_words"] / lines).alias("line_words"),
            (x["w"]["single"] / words).alias("bare"),
        )

    return let(raw, ratios)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of=F.col) -> Column:
        return of(self.feature) > self.threshold if self.above else of(self.feature) <= self.threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions and an intercept; the score is the logistic of their sum."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def column(self, of=F.col) -> Column:
        """The score as one Spark expression; ``of`` gives the column of a statistic's name."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [c.column(of) for c in conditions])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rng, out: set) -> None:
    """Add to ``out`` every path below this node; a path is a tuple of (feature, above, bin)."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, -1, -1)
    for f in rng.choice(bins.shape[1], size=max(2, bins.shape[1] // 2), replace=False):
        counts = np.bincount(bins[rows, f], minlength=BINS).cumsum()[:-1]
        ones = np.bincount(bins[rows, f], weights=y[rows], minlength=BINS).cumsum()[:-1]
        rest, rest_ones = len(rows) - counts, y[rows].sum() - ones
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = np.nan_to_num(ones * (counts - ones) / counts) + np.nan_to_num(rest_ones * (rest - rest_ones) / rest)
        total = y[rows].sum()
        gain = total * (len(rows) - total) / len(rows) - impurity
        gain[(counts < 5) | (rest < 5)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], int(f), at)
    _, f, at = best
    if f >= 0:
        above = bins[rows, f] > at
        _grow(bins, y, rows[above], (*path, (f, True, at)), depth - 1, rng, out)
        _grow(bins, y, rows[~above], (*path, (f, False, at)), depth - 1, rng, out)


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES) -> RuleEnsemble:
    """Fit on a matrix of statistics and 0/1 labels; the same input gives the same ensemble."""
    n, ones = len(y), float(y.sum())
    share = (ones + 1) / (n + 2)
    if n < 20 or ones in (0.0, float(n)):
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # A cut between two values that occur: rules then don't hang on the sample's exact values.
    cuts = []
    for f, e in enumerate(edges):
        values = np.unique(x[:, f])
        after = values[np.minimum(np.searchsorted(values, e, side="right"), len(values) - 1)]
        cuts.append(np.unique((e + after) / 2))
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    paths: set = set()
    for _ in range(TREES):
        _grow(bins, y, rng.integers(0, n, size=n), (), DEPTH, rng, paths)
    kept, columns, seen = [], [], set()
    for path in sorted(paths, key=lambda p: (len(p), p)):
        holds = np.logical_and.reduce([(bins[:, f] > at) == above for f, above, at in path])
        if MIN_SUPPORT <= holds.mean() <= 1 - MIN_SUPPORT and (mark := holds.tobytes()) not in seen:
            seen.add(mark)
            kept.append(path)
            columns.append(holds)
    if not kept:
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    weights, intercept = _lasso(np.stack(columns, axis=1).astype(np.float32), y.astype(np.float32))
    rules = tuple(
        (tuple(Condition(names[f], above, float(cuts[f][at])) for f, above, at in path), float(w))
        for path, w in zip(kept, weights, strict=True)
        if abs(w) > 1e-6 and all(at < len(cuts[f]) for f, _, at in path)
    )
    return RuleEnsemble(rules, intercept)


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on scaled rules, by accelerated proximal gradient."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    v = np.ones(z.shape[1], dtype=np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(z.T @ (z @ v)) + len(y))
    w = last = np.zeros(z.shape[1], dtype=np.float32)
    b = last_b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(STEPS):
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, at_b = w + (t - 1) / t2 * (w - last), b + (t - 1) / t2 * (b - last_b)
        error = 1 / (1 + np.exp(-(z @ at + at_b))) - y
        last, last_b, t = w, b, t2
        moved = at - step * (z.T @ error) / len(y)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        b = at_b - step * float(error.mean())
    weights = w / scale
    return weights, float(b - (weights * mean).sum())


def score_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out and score of every row; ``labels`` (doc_id, label) mark some ids."""
    measured = materialise(docs.select("doc_id", statistics(F.col(text)).alias("s")).select("doc_id", "s.*"), "quality-statistics")
    model = fit_from(measured, labels, label=label, max_fit_rows=max_fit_rows)
    return measured.select("doc_id", (_fold() == HELD_OUT).alias("held_out"), model.column().alias("score"))


def _fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _marked(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled rows that a fit may see."""
    return labels.select("doc_id", F.col(label).cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0) & (_fold() != HELD_OUT))


def _first(rows: DataFrame, most: int, *ties: str) -> DataFrame:
    """The first ``most`` rows in the order of a hash of their ids; hardly more than these are sorted."""
    share = most / max(rows.count(), 1)
    order = F.xxhash64("doc_id")
    if share < 0.5:  # a hash is even: six standard deviations on top never leave too few
        bound = int(2**64 * (share + 6 * (share / max(most, 1)) ** 0.5 * share**0.5)) - 2**63
        some = rows.filter(order <= F.lit(min(bound, 2**63 - 1)).cast("long"))
        rows = some if some.count() >= most else rows  # one id may repeat beyond all evenness
    return rows.orderBy(order, "doc_id", *ties).limit(most)


def _fit(sample: DataFrame) -> RuleEnsemble:
    rows = sample.select("label", *FEATURES).toPandas()
    return fit_rules(rows[list(FEATURES)].to_numpy(dtype=np.float64).reshape(-1, len(FEATURES)), rows["label"].to_numpy(dtype=np.float64))


def fit_from(measured: DataFrame, labels: DataFrame, *, label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    """Fit on measured rows: at most ``max_fit_rows`` labelled ones outside the held-out fold."""
    found = _marked(labels, label).join(measured, "doc_id")
    return _fit(_first(found, max_fit_rows, "label", *FEATURES))


def fit_sample(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    """Fit on texts: measures only those documents that at most ``max_fit_rows`` labels pick."""
    picked = _first(_marked(labels, label), max_fit_rows, "label")
    measured = docs.select("doc_id", F.col(text).alias("__text")).join(F.broadcast(picked), "doc_id")
    measured = measured.select("doc_id", "label", statistics(F.col("__text")).alias("s")).select("doc_id", "label", "s.*")
    return _fit(_first(materialise(measured, "quality-sample"), max_fit_rows, "label", *FEATURES))


def op6_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int"))
