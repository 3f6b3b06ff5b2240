"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Text statistics are exact and come from built-in functions only. The documents that pass the fixed
base rules feed one quantile sketch per language, source and statistic: a log-linear histogram,
``SUB_BUCKETS`` buckets an octave, so a quantile is off by at most one part in ``SUB_BUCKETS``. Two
sketches merge by adding counts, in any order.

A group's bounds come from its own sketch. Its upper bound is its 90th percentile and ``SPREADS``
times what lies between that and its median; the lower one mirrors it at the 10th percentile. What
lies outside the bounds of the next wider level (its language; for a language, everything) is left
out of a group's sketch first if it is at most one part in ``CLIPPED`` of it, so that junk does not
hide itself, while a source that differs as a whole keeps bounds of its own. Percentiles shrink
towards the wider level's as if ``PRIOR_DOCS`` documents had been seen there: small groups lean on
their language, large ones don't, and there is no switch between the two.

A share that is bounded above is judged by its count: ``ALLOWANCE`` standard deviations of a count of
that rate are allowed on top, so a short text with one or two marks passes even where the rest has none.

Defined cases: a null text has no words and fails the base rules; null languages and sources form
groups of their own; repeated rows give repeated results; an empty table gives an empty result;
only the five named columns are read, extra ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, WORD, let, materialise, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUB_BUCKETS = 32
SPREADS = 6
CLIPPED = 4
PRIOR_DOCS = 100
ALLOWANCE = 6
#: Counts and what they are shares of; bounds of shares are in parts per million.
SHARES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Percentiles that a sketch is asked for.
PERCENTILES = (10, 50, 90)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which occurs at least twice in the text.

    Windows are sorted with their positions; equal neighbours are repeats; the sorted positions of
    repeats then cover three words each, less what the next one covers too.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - 3
        gram = lambda i: F.struct(
            F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("g"), i.alias("p")
        )
        return F.when(last >= 1, F.sort_array(F.transform(F.sequence(F.lit(0), last), gram)))

    def same(grams: Column, row: Column, j: Column) -> Column:
        return F.coalesce(F.get(grams, j)["g"] == row["g"], F.lit(False))

    def covered(grams: Column) -> Column:
        repeated = F.filter(grams, lambda row, j: same(grams, row, j - 1) | same(grams, row, j + 1))
        starts = F.sort_array(F.transform(repeated, lambda row: row["p"]))
        step = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return let(starts, lambda at: F.aggregate(step(at), F.lit(0), lambda a, b: a + b))

    return F.coalesce(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered), F.lit(0))


def text_statistics(text: Column) -> Column:
    """Struct of the exact counts of one text; see the module's contract for nulls."""
    whole = F.coalesce(text, F.lit(""))
    dense = F.translate(whole, SPACES, "")
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), dense.alias("c")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            F.char_length(x["c"]).cast("long").alias("word_chars"),
            (F.char_length(x["c"]) - F.char_length(F.translate(x["c"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"),
            x["w"]["r"].cast("long").alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
        ),
    )


def _metrics() -> dict[str, Column]:
    """Statistics of a row: shares in parts per million and the mean word length in thousandths."""
    ratio = lambda part, whole, scale: F.expr(f"{part} * {scale} div greatest({whole}, 1)")
    return {k: ratio(*of, 1_000_000) for k, of in SHARES.items()} | {"word_len": ratio("word_chars", "n_words", 1_000)}


def _bucket_sql(value: str) -> str:
    """Log-linear bucket of a whole number >= 0: exact below 2 * SUB_BUCKETS."""
    shift = f"greatest(length(bin({value})) - {SUB_BUCKETS.bit_length()}, 0)"
    return f"({shift} * {SUB_BUCKETS} + shiftright({value}, {shift}))"


def _bucket_low_sql(bucket: str) -> str:
    """Least value that falls into a bucket."""
    shift = f"greatest({bucket} div {SUB_BUCKETS} - 1, 0)"
    return f"shiftleft({bucket} - {shift} * {SUB_BUCKETS}, cast({shift} as int))"


def build_sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per language, source and statistic."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in _metrics().items()]))
    long_form = stats.select("lang", "source", pairs.alias("m")).select("lang", "source", "m.metric", "m.value")
    return long_form.withColumn("bucket", F.expr(_bucket_sql("value"))).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], wider: DataFrame | None = None) -> DataFrame:
    """Percentiles of every merged sketch, shrunk towards those of ``wider``, and its bounds.

    wider: the same for a part of the keys; what lies outside its bounds is left out if it is a minority.
    """
    group = W.partitionBy(*keys, "metric")
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("value", F.expr(_bucket_low_sql("bucket")))
    if wider is not None:
        shared = [c for c in wider.columns if c in (*keys, "metric")]
        merged = merged.join(wider.select(*shared, "low", "high", *[F.col(f"p{i}").alias(f"w{i}") for i in PERCENTILES]), shared)
        inside = F.col("value").between(F.col("low"), F.col("high"))
        merged = merged.withColumns({"inside": inside, "out": F.sum(F.when(~inside, F.col("n")).otherwise(0)).over(group), "all": F.sum("n").over(group)})
        merged = merged.filter(F.col("inside") | (F.col("out") * CLIPPED > F.col("all")))
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    found = ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("below") * 100 >= F.col("total") * i, F.col("value"))).alias(f"p{i}") for i in PERCENTILES],
        *([F.min(f"w{i}").alias(f"w{i}") for i in PERCENTILES] if wider is not None else []),
    )
    if wider is not None:
        shrunk = {f"p{i}": F.expr(f"(total * p{i} + {PRIOR_DOCS} * w{i}) div (total + {PRIOR_DOCS})") for i in PERCENTILES}
        found = found.withColumns(shrunk)
    return found.select(
        *keys, "metric", *[f"p{i}" for i in PERCENTILES],
        (F.col("p10") - SPREADS * (F.col("p50") - F.col("p10"))).alias("low"), (F.col("p90") + SPREADS * (F.col("p90") - F.col("p50"))).alias("high"),
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per language and source with an upper bound for each share and two bounds for word_len."""
    overall = sketch_quantiles(sketches, [])
    by_lang = sketch_quantiles(sketches, ["lang"], overall)
    bounds = sketch_quantiles(sketches, ["lang", "source"], by_lang)
    pick = lambda k, side: F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{k}_{side}")
    return bounds.groupBy("lang", "source").agg(*[pick(k, "high") for k in (*SHARES, "word_len")], pick("word_len", "low"))


def apply_quality_rules(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Statistics, base verdict and adaptive verdict of every document (doc_id, text, lang, source)."""
    none = "\x00"  # stands for a null language or source in groups and joins
    stats = materialise(
        docs.select(
            "doc_id", F.coalesce("lang", F.lit(none)).alias("lang"), F.coalesce("source", F.lit(none)).alias("source"),
            text_statistics(F.col(text)).alias("s"),
        ).select("doc_id", "lang", "source", "s.*"),
        "quality-stats",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # Written first: its size is then known, and it is sent to all tasks only if it is small.
    limits = materialise(thresholds(materialise(build_sketches(stats.filter(~failed)), "quality-sketches")), "quality-limits")
    word_len = _metrics()["word_len"]
    bad = [(word_len > F.col("word_len_high")) | (word_len < F.col("word_len_low"))]
    for k, (part, whole) in SHARES.items():
        expected = F.col(whole) * F.col(f"{k}_high") / F.lit(1e6)
        bad.append(F.col(part) > expected + F.lit(float(ALLOWANCE)) * F.sqrt(expected + F.lit(1.0)))
    outside = F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False))
    judged = stats.join(limits, ["lang", "source"], "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outside).alias("kept"),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source,
         coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c
  FROM base, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY rid),
stats AS (
  SELECT b.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines
  FROM base b LEFT JOIN covered c USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS word_len
  FROM stats),
long_form AS (
  UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_len FROM judged WHERE NOT base_failed)
  ON symbols, dup_lines, repeats, word_len INTO NAME metric VALUE value),
shifts AS (SELECT *, greatest(length(bin(value)) - 6, 0) AS sh FROM long_form),
sketch AS (SELECT lang, source, metric, sh * 32 + (value >> sh) AS bucket, ((value >> sh) << sh) AS low_value, count(*) AS n FROM shifts GROUP BY ALL),
all_ranked AS (
  SELECT metric, low_value, sum(sum(n)) OVER (PARTITION BY metric ORDER BY low_value) AS below, sum(sum(n)) OVER (PARTITION BY metric) AS total
  FROM sketch GROUP BY metric, low_value),
all_bounds AS (
  SELECT *, p10 - 6 * (p50 - p10) AS low, p90 + 6 * (p90 - p50) AS high FROM (
    SELECT metric, min(low_value) FILTER (100 * below >= 10 * total) AS p10, min(low_value) FILTER (100 * below >= 50 * total) AS p50,
           min(low_value) FILTER (100 * below >= 90 * total) AS p90 FROM all_ranked GROUP BY metric)),
lang_cells AS (
  SELECT s.lang, s.metric, s.low_value, sum(s.n) AS n, any_value(a.p10) AS w10, any_value(a.p50) AS w50, any_value(a.p90) AS w90,
         bool_and(s.low_value BETWEEN a.low AND a.high) AS inside
  FROM sketch s JOIN all_bounds a USING (metric) GROUP BY s.lang, s.metric, s.low_value),
lang_kept AS (
  SELECT * FROM (SELECT *, coalesce(sum(n) FILTER (NOT inside) OVER g, 0) AS n_out, sum(n) OVER g AS n_all FROM lang_cells WINDOW g AS (PARTITION BY lang, metric))
  WHERE inside OR 4 * n_out > n_all),
lang_ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY low_value) AS below, sum(n) OVER (PARTITION BY lang, metric) AS total FROM lang_kept),
lang_bounds AS (
  SELECT *, p10 - 6 * (p50 - p10) AS low, p90 + 6 * (p90 - p50) AS high FROM (
    SELECT lang, metric, (total * q10 + 100 * w10) // (total + 100) AS p10, (total * q50 + 100 * w50) // (total + 100) AS p50, (total * q90 + 100 * w90) // (total + 100) AS p90
    FROM (SELECT lang, metric, max(total) AS total, min(low_value) FILTER (100 * below >= 10 * total) AS q10, min(low_value) FILTER (100 * below >= 50 * total) AS q50,
                 min(low_value) FILTER (100 * below >= 90 * total) AS q90, min(w10) AS w10, min(w50) AS w50, min(w90) AS w90 FROM lang_ranked GROUP BY lang, metric))),
cells AS (SELECT s.*, l.p10 AS w10, l.p50 AS w50, l.p90 AS w90, s.low_value BETWEEN l.low AND l.high AS inside FROM sketch s JOIN lang_bounds l USING (lang, metric)),
kept_cells AS (
  SELECT * FROM (SELECT *, coalesce(sum(n) FILTER (NOT inside) OVER g, 0) AS n_out, sum(n) OVER g AS n_all FROM cells WINDOW g AS (PARTITION BY lang, source, metric))
  WHERE inside OR 4 * n_out > n_all),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY low_value) AS below, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM kept_cells),
bounds AS (
  SELECT lang, source, metric, p10 - 6 * (p50 - p10) AS low, p90 + 6 * (p90 - p50) AS high FROM (
    SELECT lang, source, metric, (total * q10 + 100 * w10) // (total + 100) AS p10, (total * q50 + 100 * w50) // (total + 100) AS p50, (total * q90 + 100 * w90) // (total + 100) AS p90
    FROM (SELECT lang, source, metric, max(total) AS total, min(low_value) FILTER (100 * below >= 10 * total) AS q10, min(low_value) FILTER (100 * below >= 50 * total) AS q50,
                 min(low_value) FILTER (100 * below >= 90 * total) AS q90, min(w10) AS w10, min(w50) AS w50, min(w90) AS w90 FROM ranked GROUP BY lang, source, metric))),
outside AS (
  SELECT DISTINCT j.rid FROM judged j JOIN bounds b USING (lang, source)
  WHERE (b.metric = 'word_len' AND (j.word_len > b.high OR j.word_len < b.low))
     OR (b.metric = 'symbols' AND n_symbols > word_chars * b.high / 1e6::DOUBLE + 6 * sqrt(word_chars * b.high / 1e6::DOUBLE + 1))
     OR (b.metric = 'dup_lines' AND n_dup_lines > n_lines * b.high / 1e6::DOUBLE + 6 * sqrt(n_lines * b.high / 1e6::DOUBLE + 1))
     OR (b.metric = 'repeats' AND n_repeat_words > n_words * b.high / 1e6::DOUBLE + 6 * sqrt(n_words * b.high / 1e6::DOUBLE + 1)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept
FROM judged
"""
