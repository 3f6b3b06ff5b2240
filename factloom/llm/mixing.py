"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a random-looking key from a hash of its id. Within a source the rows are ordered by
that key; the range of keys is cut into equal buckets, so a source's prefix sums come from two
levels: bucket totals (at most ``2**bucket_bits`` rows a source) and a window within a bucket. No
task ever holds a whole source, however large it is.

Defined cases: null or empty texts have size 0 and take 0; a null source is a source of its own and
comes last; rows with equal ids and sizes tie and are interchangeable; an empty table gives an
empty result; columns other than id, source and size are ignored here, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
KEY_HEX_DIGITS = 13
BUCKET_BITS = 12


def hash_key(doc_id: Column, seed: str) -> Column:
    """A 52-bit key from the md5 of seed and id: the same on every run and engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_HEX_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filled targets of a (src, src_null, source_size) table: one row a source.

    Sources sorted by cap over weight are capped while the common level exceeds their cap; the
    first that is not capped sets the level for all that follow.
    """
    names = W.orderBy("src_null", "src")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cyclic = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cyclic, (F.row_number().over(names) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "src_null", "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before")))
    # The level at the first source that is not capped; null only if every source is capped.
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "src_null", "src", "level"))).over(everything)
    ranked = ranked.withColumn("free", free)
    capped = F.col("free").isNull() | (F.col("ratio") < F.col("free.level"))
    return ranked.select(
        "src", "src_null", "source_size",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("weight")).alias("target"),
    )


def mix_sources(
    sized: DataFrame, *, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """Take of every row of ``sized`` (doc_id, source, size) its part of its source's target.

    Returns doc_id, source, size, source_size, target and taken. Whole epochs are taken as often as
    they fit, then the hash-random order is cut at exactly the rest of the target, within a row if
    need be, so a source's taken words are the floor of its target.
    """
    key = hash_key(F.col("doc_id"), seed)
    rows = materialise(
        sized.select(
            "doc_id", "source", F.col("size").cast("long").alias("size"),
            F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"), key.alias("key"),
        ),
        "mix-rows",
    ).withColumn("bucket", F.shiftright("key", 4 * KEY_HEX_DIGITS - bucket_bits))
    by_bucket = materialise(rows.groupBy("src", "src_null", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(by_bucket.groupBy("src", "src_null").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    earlier = W.partitionBy("src", "src_null").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_bucket.select("src", "src_null", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")).join(
        targets, ["src", "src_null"]
    )
    inside = W.partitionBy("src", "src_null", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["src", "src_null", "bucket"])
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - (F.col("offset") + F.col("within")), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (n - 1) % 3]::DOUBLE AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT max(level) AS level FROM (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, n LIMIT 1)),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN a.level IS NULL OR l.ratio < a.level THEN l.cap::DOUBLE ELSE a.level * l.weight END AS target
  FROM levels l CROSS JOIN free a),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         floor(t.target + 1e-6)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END::BIGINT AS taken
FROM placed
"""
