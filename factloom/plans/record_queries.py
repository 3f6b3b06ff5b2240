"""Ingest, capture coverage, queue, quality and evaluation over table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.udfs import word_error_rate
from factloom.operators import coverage, ingest, metrics, quality, upload_queue
from factloom.plans.registry import query, table


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS version FROM orders WHERE o_orderkey % 4 <> 0""")
def idempotent_insert(spark, d):
    """A batch that lists every key twice, against keys that exist already."""
    keys = table(spark, d, "orders").select("o_orderkey")
    first = keys.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("version"), F.lit(1).alias("seq"))
    batch = first.unionByName(first.withColumn("version", F.lit("late")).withColumn("seq", F.lit(2)))
    return ingest.insert_new(keys.filter("o_orderkey % 4 = 0"), batch, "o_orderkey", "seq").drop("seq")


@query("SELECT o_orderkey AS artifact_id, 2::BIGINT AS digests FROM orders WHERE o_orderkey % 5 = 0")
def immutable_conflicts(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"))
    again = keys.withColumn("sha256", F.sha2(F.when(F.col("artifact_id") % 5 == 0, "other").otherwise("same"), 256))
    return ingest.immutable_conflicts(keys.withColumn("sha256", F.sha2(F.lit("same"), 256)).unionByName(again), "artifact_id", "sha256")


@query("""SELECT l_orderkey AS job_id, l_partkey AS artifact_id, CASE WHEN l_partkey % 7 = 0 THEN 409 WHEN l_linenumber = 3 THEN 422 ELSE 200 END::INT AS status FROM lineitem""")
def job_artifact_check(spark, d):
    stored = table(spark, d, "part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("artifact_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    digest = F.sha2(F.when(F.col("l_linenumber") == 3, "changed").otherwise(F.col("l_partkey").cast("string")), 256)
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("artifact_id"), F.upper(digest).alias("sha256"))
    return ingest.job_artifacts(images, stored)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 422 WHEN c_nationkey % 5 = 0 THEN 409 WHEN c_custkey % 6 = 1 THEN 413 WHEN c_custkey % 6 = 2 THEN 400
 WHEN c_custkey % 6 = 3 THEN 422 ELSE 201 END::INT AS status FROM customer""")
def upload_status(spark, d):
    k = F.col("c_custkey") % 6
    content = F.when(k == 1, F.repeat(F.lit("x"), 100)).when(k == 2, "").otherwise(F.col("c_name")).cast("binary")
    uploads = table(spark, d, "customer").select(
        F.when(k == 0, "bad id").otherwise(F.concat(F.lit("IMG-"), F.col("c_custkey").cast("string"))).alias("artifact_id"), F.concat(F.lit("CS-"), F.col("c_nationkey").cast("string")).alias("capture_session_id"),
        content.alias("content"), F.when(k == 3, F.sha2(F.lit("else"), 256)).otherwise(F.sha2(content, 256)).alias("sha256"), "c_custkey",
    )
    sessions = table(spark, d, "nation").filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("CS-"), F.col("n_nationkey").cast("string")).alias("capture_session_id"))
    keyed = uploads.withColumn("artifact_id", F.when(k == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).otherwise(F.col("artifact_id")))
    found = ingest.upload_status(keyed, sessions, max_bytes=50)
    return found.select(F.regexp_extract("artifact_id", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "status")


@query("""SELECT l_orderkey AS job_id, unnest(list_filter([CASE WHEN count(*) <> count(DISTINCT l_linenumber) THEN 'artifact listed twice' END, CASE WHEN count(*) > 6 THEN 'too many artifacts' END], lambda x: x IS NOT NULL)) AS problem
 FROM lineitem GROUP BY 1""")
def session_problems(spark, d):
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("artifact_id"))
    return ingest.session_problems(images, max_artifacts=6)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 0.5 ELSE l_discount * 10 END::DOUBLE AS confidence FROM lineitem
 WHERE l_linenumber <> 5 AND (l_linenumber = 4 OR l_discount * 10 >= 0.30)""")
def usable_lines(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 5, "  ").otherwise("text").alias("text"), F.when(F.col("l_linenumber") != 4, F.col("l_discount") * 10).alias("confidence")
    )
    return ingest.usable_lines(rows).drop("text")


@query("""WITH g AS (SELECT l_orderkey AS job_id, bool_or(l_tax > 0.07) AS q, bool_and(l_returnflag = 'R') AS r, count(*) > 2 AS c, l_orderkey % 11 <> 0 AS s FROM lineitem GROUP BY l_orderkey)
 SELECT job_id, CASE WHEN q THEN 'QUARANTINED' WHEN NOT s THEN 'EXTRACTION_ERROR' WHEN r THEN 'NEEDS_RECAPTURE' WHEN NOT c THEN 'INCOMPLETE_EVIDENCE' ELSE 'EXTRACTION_READY' END AS status,
 CASE WHEN q THEN 'quarantined' WHEN s THEN 'completed' ELSE 'failed' END AS run FROM g""")
def job_status(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.bool_or(F.col("l_tax") > 0.07).alias("q"), F.bool_and(F.col("l_returnflag") == "R").alias("r"), (F.count("*") > 2).alias("c")
    )
    has = F.col("job_id") % 11 != 0
    return g.select("job_id", ingest.job_status(F.col("q"), has, F.col("r"), F.col("c")).alias("status"), ingest.run_status(F.col("q"), has).alias("run"))


@query("""SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def quarantine_queue(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("quarantined_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("reviewed_at"))
    return ingest.quarantine_queue(runs).select("run_id")


@query("""SELECT o_custkey AS package_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders""")
def runs_for_package(spark, d):
    """Every package's runs, newest first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("run_id"), F.row_number().over(order).alias("place"))


@query("""SELECT o_orderkey, status, CASE WHEN status BETWEEN 200 AND 299 THEN 'succeeded' WHEN status IS NULL OR status IN (408, 429) OR status >= 500 THEN 'retry' ELSE 'permanent' END AS outcome
 FROM (SELECT o_orderkey, [200, 204, 408, 429, 409, 401, 500, NULL][1 + o_orderkey % 8]::INT AS status FROM orders)""")
def transport_outcomes(spark, d):
    codes = F.array(*[F.lit(c) for c in (200, 204, 408, 429, 409, 401, 500, None)])
    rows = table(spark, d, "orders").select("o_orderkey", F.get(codes, (F.col("o_orderkey") % 8).cast("int")).alias("status"))
    return rows.withColumn("outcome", ingest.transport_outcome(F.col("status")))


@query("""SELECT l_orderkey, ['pass', 'unavailable', 'warn', 'fail'][1 + max(l_linenumber % 4)] AS overall FROM lineitem GROUP BY 1""")
def overall_verdict(spark, d):
    verdict = F.get(F.array(*[F.lit(v) for v in coverage.VERDICTS]), F.col("l_linenumber") % 4)
    return coverage.overall_verdict(table(spark, d, "lineitem").withColumn("verdict", verdict), ["l_orderkey"])


def _steps(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("int").alias("q"))
    rows = rows.withColumn("surface_id", F.concat(F.lit("s"), F.col("n").cast("string"))).withColumn("capture", F.concat(F.col("product_id").cast("string"), F.lit("/"), F.col("surface_id")))
    steps = rows.select(
        "product_id", "surface_id", F.col("n").alias("ordinal"), (F.col("n") <= 4).alias("is_required"), F.when(F.col("q") % 3 == 0, F.col("capture")).alias("accepted_capture_id"),
        F.when(F.col("q") % 3 == 1, "notPresent").alias("skip_reason"),
    )
    tries = F.explode(F.sequence(F.lit(0), F.col("q") % 5))
    captures = rows.select("product_id", "surface_id", "capture", tries.alias("t"), "q").select(
        "product_id", "surface_id", F.when(F.col("t") == 0, F.col("capture")).otherwise(F.concat("capture", F.lit("-"), F.col("t").cast("string"))).alias("capture_id"),
        F.when((F.col("t") > 0) | (F.col("q") % 2 == 1), "fail").otherwise("pass").alias("verdict"),
    )
    return coverage.step_states(steps, captures)


_STEPS = """steps AS (SELECT l_orderkey AS product_id, l_linenumber AS ordinal, 's' || l_linenumber AS surface_id, l_linenumber <= 4 AS is_required, min(l_quantity)::INT AS q FROM lineitem GROUP BY ALL),
 states AS (SELECT product_id, surface_id, ordinal, is_required, (q % 5 + q % 2)::BIGINT AS failed_attempts, greatest(3 - q % 5 - q % 2, 0)::BIGINT AS attempts_left,
 CASE WHEN q % 3 = 0 AND q % 2 = 1 THEN 'capturedNeedsReview' WHEN q % 3 = 0 THEN 'captured' WHEN q % 3 = 1 THEN 'skipped' ELSE 'pending' END AS status FROM steps)"""


@query(f"WITH {_STEPS} SELECT * FROM states")
def step_status(spark, d):
    return _steps(spark, d)


@query(f"""WITH {_STEPS} SELECT product_id, count(*) FILTER (is_required) AS required, count(*) FILTER (is_required AND status <> 'pending') AS required_done,
 bool_and(NOT is_required OR status <> 'pending') AS complete, coalesce(string_agg(surface_id, ',' ORDER BY surface_id) FILTER (status = 'capturedNeedsReview'), '') AS review,
 arg_min(surface_id, ordinal) FILTER (is_required AND status = 'pending') AS next_step FROM states GROUP BY 1""")
def product_coverage(spark, d):
    return coverage.product_coverage(_steps(spark, d)).withColumn("review", F.array_join("review", ","))


@query(f"""WITH {_STEPS}, p AS (SELECT product_id, bool_and(NOT is_required OR status <> 'pending') AS complete FROM states GROUP BY 1)
 SELECT product_id % 10 AS inspection_id, count(*) FILTER (complete) AS complete_products, bool_or(NOT complete) AS has_incomplete FROM p GROUP BY 1""")
def inspection_rollup(spark, d):
    products = coverage.product_coverage(_steps(spark, d)).withColumn("inspection_id", F.col("product_id") % 10)
    return coverage.inspection_rollup(products)


@query(f"""WITH {_STEPS} SELECT product_id, surface_id, row_number() OVER (PARTITION BY product_id ORDER BY ordinal, surface_id)::INT AS sequence_index FROM states WHERE status LIKE 'captured%'""")
def accepted_sequence(spark, d):
    return coverage.accepted_sequence(_steps(spark, d)).select("product_id", "surface_id", "sequence_index")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN 'accepted' WHEN l_linenumber >= 3 THEN 'acceptedUnderManualReview' ELSE 'blocked' END AS disposition FROM lineitem""")
def acceptance(spark, d):
    verdict = F.when(F.col("l_returnflag") == "R", "fail").otherwise("warn")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", coverage.acceptance(verdict, F.col("l_linenumber")).alias("disposition"))


@query("""SELECT l_orderkey AS capture_id, count(*) AS n, round(CASE WHEN count(*) < 3 THEN avg((l_quantity > 10)::INT) * 0.5 ELSE least(avg(l_discount * 10), 1.0) END, 9)::DOUBLE AS score, CASE WHEN count(*) < 3 OR avg(l_discount * 10) < 0.5 THEN 'fail' WHEN avg(l_discount * 10) < 0.7 THEN 'warn' ELSE 'pass' END AS verdict FROM lineitem GROUP BY 1""")
def legibility(spark, d):
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture_id"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_quantity") > 10).alias("legible"), place)
    return coverage.legibility(lines, order="place").withColumn("score", F.round("score", 9))


def _tasks(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in upload_queue.KINDS]), (F.col("event_id") % 3).cast("int"))
    status = F.get(F.array(*[F.lit(s) for s in ("queued", "inFlight", "succeeded", "failedPermanent", "succeeded")]), (F.floor(F.col("event_id") / 3) % 5).cast("int"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("product_id"), kind.alias("kind"), status.alias("status"), (F.col("event_id") % 7 + 1).alias("attempts"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("next_attempt_at"),
    )


_TASKS = """tasks AS (SELECT event_id AS seq, user_id AS product_id, event_id % 3 AS k, ['queued', 'inFlight', 'succeeded', 'failedPermanent', 'succeeded'][1 + (event_id // 3) % 5] AS status,
 event_id % 7 + 1 AS attempts, CASE WHEN event_id % 2 = 0 THEN ts END AS next_attempt_at FROM events),
 flagged AS (SELECT *, CASE k WHEN 1 THEN NOT bool_or(k = 0 AND status = 'succeeded') OVER p WHEN 2 THEN NOT bool_and(k = 2 OR status = 'succeeded') OVER p ELSE false END AS blocked FROM tasks WINDOW p AS (PARTITION BY product_id))"""


@query(f"WITH {_TASKS} SELECT seq, blocked FROM flagged")
def queue_blocked(spark, d):
    return upload_queue.with_blocked(_tasks(spark, d)).select("seq", "blocked")


@query(f"""WITH {_TASKS} SELECT product_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY k, seq) AS n FROM flagged
 WHERE status = 'queued' AND NOT blocked AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15 00:00:00')) WHERE n = 1""")
def queue_due(spark, d):
    return upload_queue.due_tasks(_tasks(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("product_id", "seq")


@query(f"WITH {_TASKS} SELECT seq, least(5 * pow(2, least(attempts * 4 - 1, 20)), 600)::DOUBLE AS cap, greatest(0.25 * least(5 * pow(2, least(attempts * 4 - 1, 20)), 600), 1)::DOUBLE AS wait FROM tasks")
def queue_backoff(spark, d):
    n = F.col("attempts") * 4
    return _tasks(spark, d).select("seq", upload_queue.backoff_cap(n).alias("cap"), upload_queue.backoff(n, F.lit(0.25)).alias("wait"))


@query(f"""WITH {_TASKS} SELECT product_id, count(*) FILTER (status = 'queued') AS pending, count(*) FILTER (status = 'inFlight') AS in_flight,
 count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failedPermanent') AS failed FROM tasks GROUP BY 1""")
def queue_counters(spark, d):
    return upload_queue.counters(_tasks(spark, d), "product_id")


@query(f"""WITH {_TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id, k ORDER BY seq) AS f, status IN ('succeeded', 'failedPermanent') AS over,
 row_number() OVER (PARTITION BY product_id, k, status IN ('succeeded', 'failedPermanent') ORDER BY seq DESC) AS l FROM tasks)
 SELECT seq, CASE WHEN status = 'inFlight' THEN 'queued' ELSE status END AS status FROM r WHERE (k <> 0 OR f = 1) AND (k <> 2 OR over OR l = 1)""")
def queue_deduplicated(spark, d):
    return upload_queue.deduplicate(_tasks(spark, d)).select("seq", upload_queue.recovered(F.col("status")).alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'no scale' WHEN p_size % 3 = 0 THEN 'scale not validated' WHEN p_size % 5 = 0 THEN 'no error bound' END AS reason, p_size * 0.25 AS height FROM part""")
def measurability(spark, d):
    s = F.col("p_size")
    reason = quality.measurability(F.when(s % 4 == 0, "none").otherwise("reference_object"), s % 3 != 0, F.when(s % 5 != 0, 0.1).otherwise(0.0))
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"), quality.letter_height_mm(s, F.lit(0.25)).alias("height"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 4 < 60 THEN 'blur' WHEN l_extendedprice / 200 < 40 OR l_extendedprice / 200 > 220 THEN 'brightness' WHEN l_discount * 3 > 0.25 THEN 'clipped'
 WHEN l_tax > 0.03 THEN 'glare' WHEN l_quantity < 18 THEN 'contrast' END AS reason,
 round(greatest((0.6 * least(l_quantity * 4 / 150, 1) + 0.4 * least(l_quantity / 50, 1)) * (1 - least(2 * l_discount, 0.8)), 0.05), 9)::DOUBLE AS region FROM lineitem""")
def measure_verdict(spark, d):
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (q * 4).alias("sharpness"), (F.col("l_extendedprice") / 200).alias("luminance"), (F.col("l_discount") * 3).alias("clipped"), F.col("l_tax").alias("glare"), q.alias("contrast"), "l_discount"
    )
    region = quality.region_quality(F.col("sharpness"), F.col("contrast"), F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", quality.verdict()["reason"].alias("reason"), F.round(region, 9).alias("region"))


_PIXELS = """px AS (SELECT l_orderkey // 100 AS image, l_orderkey % 100 AS y, l_linenumber AS x, (min(l_quantity) * 5)::INT AS v FROM lineitem GROUP BY ALL)"""


def _pixels(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").groupBy(F.floor(k / 100).alias("image"), (k % 100).alias("y"), F.col("l_linenumber").alias("x")).agg((F.min("l_quantity") * 5).cast("int").alias("v"))


@query(f"""WITH {_PIXELS} SELECT image, round(avg(v), 9) AS luminance, round(stddev_pop(v), 9) AS contrast, round(avg(CASE WHEN v <= 16 OR v >= 239 THEN 1.0 ELSE 0.0 END), 9) AS clipped FROM px GROUP BY 1""")
def pixel_statistics(spark, d):
    s = quality.pixel_statistics(_pixels(spark, d))
    return s.select("image", *[F.round(c, 9).alias(c) for c in ("luminance", "contrast", "clipped")])


@query(f"""WITH {_PIXELS}, l AS (SELECT p.image, a.v + b.v + c.v + e.v - 4 * p.v AS l FROM px p JOIN px a ON a.image = p.image AND a.y = p.y AND a.x = p.x - 1 JOIN px b ON b.image = p.image AND b.y = p.y AND b.x = p.x + 1
 JOIN px c ON c.image = p.image AND c.y = p.y - 1 AND c.x = p.x JOIN px e ON e.image = p.image AND e.y = p.y + 1 AND e.x = p.x) SELECT image, round(var_pop(l), 6) AS sharpness FROM l GROUP BY 1""")
def pixel_laplacian(spark, d):
    return quality.laplacian_variance(_pixels(spark, d)).select("image", F.round("sharpness", 6).alias("sharpness"))


@query("""SELECT doc_id, round(levenshtein(t, b) / length(t), 9)::DOUBLE AS cer FROM (SELECT doc_id, regexp_replace(d.text, '[^ -~]', '', 'g') AS t, regexp_replace(b.text, '[^ -~]', '', 'g') AS b
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 20) WHERE length(t) > 0""")
def character_error_rate(spark, d):
    """Whole texts; only printable ASCII, as engines differ on whether other characters count as one edit."""
    ascii_only = lambda c: F.regexp_replace(c, "[^ -~]", "")
    items = table(spark, d, "benchmark").filter("item_id BETWEEN 0 AND 19").withColumnRenamed("text", "b")  # 20 rows at most
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 20).join(F.broadcast(items), "item_id")
    texts = rows.select("doc_id", ascii_only("text").alias("t"), ascii_only("b").alias("b")).filter("t != ''")
    return texts.select("doc_id", F.round(metrics.character_error_rate(F.col("t"), F.col("b")), 9).alias("cer"))


@query()
def word_error_rates(spark, d):
    """Words of each whole document against those of a benchmark item; a document without an item is read as nothing."""
    items = table(spark, d, "benchmark").filter("item_id BETWEEN 0 AND 19").select("item_id", F.col("text").alias("read"))  # 20 rows at most
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 20).join(F.broadcast(items), "item_id", "left")
    return rows.select("doc_id", word_error_rate("text", "read").alias("wer"))


@query("""WITH s AS (SELECT quality AS k, n_chars AS value, toxic = 1 AS failed FROM labels JOIN documents USING (doc_id)), per AS (SELECT k, value, count(*) FILTER (failed) AS bad, count(*) FILTER (NOT failed) AS good FROM s GROUP BY ALL)
 SELECT k, value AS threshold, coalesce(sum(bad) OVER b, 0)::BIGINT AS true_positive, coalesce(sum(good) OVER b, 0)::BIGINT AS false_positive, (sum(bad) OVER (PARTITION BY k) - coalesce(sum(bad) OVER b, 0))::BIGINT AS false_negative,
 (sum(good) OVER (PARTITION BY k) - coalesce(sum(good) OVER b, 0))::BIGINT AS true_negative FROM per WINDOW b AS (PARTITION BY k ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_samples(spark, d), ["k"])


def _samples(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("k"), F.col("n_chars").alias("value"), (F.col("toxic") == 1).alias("failed"))


@query("""WITH s AS (SELECT quality AS k, n_chars AS value, toxic = 1 AS failed FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY value) + (count(*) OVER (PARTITION BY k, value) - 1) / 2 AS r FROM s)
 SELECT k, round(1 - (sum(r) FILTER (failed) - count(*) FILTER (failed) * (count(*) FILTER (failed) + 1) / 2) / (count(*) FILTER (failed) * count(*) FILTER (NOT failed)), 9)::DOUBLE AS auc, count(*) AS samples FROM r GROUP BY 1""")
def roc_auc(spark, d):
    return metrics.roc_auc(_samples(spark, d), ["k"]).withColumn("auc", F.round("auc", 9))


@query("""SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = floor(n * 95 / 100)""")
def latency_p95(spark, d):
    return metrics.latency_p95(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH e AS (SELECT l_orderkey AS image, 'f' || l_linenumber AS field, min(l_returnflag) AS want FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), g AS (SELECT l_orderkey AS image, 'f' || l_linenumber AS field, max(l_returnflag) AS got FROM lineitem
 WHERE l_linenumber % 3 <> 0 GROUP BY ALL), c AS (SELECT field, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS tp, count(*) FILTER (want IS NULL) AS fp, count(*) FILTER (got IS NULL) AS fn, count(*) FILTER (want = got) AS value_matches
 FROM e FULL JOIN g USING (image, field) GROUP BY 1), s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
 SELECT field, tp, fp, fn, value_matches, p::DOUBLE AS precision, r::DOUBLE AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1 FROM s""")
def field_scores(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_linenumber").alias("n")).agg(
        F.min("l_returnflag").alias("low"), F.max("l_returnflag").alias("high")
    )
    return metrics.field_scores(rows.filter("n % 2 = 0").select("image", "field", F.col("low").alias("value")), rows.filter("n % 3 <> 0").select("image", "field", F.col("high").alias("value")))


@query("""SELECT l_returnflag AS engine, avg(l_discount)::DOUBLE AS mean_cer, avg(l_tax)::DOUBLE AS mean_wer, count(*) AS matched, avg(l_extendedprice)::DOUBLE AS mean_latency_ms,
 (list_sort(list(l_extendedprice)))[1 + floor(count(*) * 95 / 100)::INT]::DOUBLE AS p95_latency_ms FROM lineitem GROUP BY 1""")
def engine_rollup(spark, d):
    """Return flags as engines, discounts and taxes as error rates, prices as latencies."""
    rows = table(spark, d, "lineitem").withColumn("engine", F.col("l_returnflag"))
    scored = rows.select("engine", F.col("l_discount").alias("cer"), F.col("l_tax").alias("wer"))
    found = metrics.engine_rollup(scored, rows.select("engine", F.col("l_extendedprice").alias("ms")))
    return found.select("engine", *[F.col(c).cast("double").alias(c) for c in ("mean_cer", "mean_wer")], "matched", *[F.col(c).cast("double").alias(c) for c in ("mean_latency_ms", "p95_latency_ms")])


_SAMPLES_SQL = """samples AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'rms_contrast' ELSE 'clipped_fraction' END AS feature, l_quantity::DOUBLE AS value, l_returnflag = 'R' AS failed FROM lineitem)"""


def _engine_samples(spark, d):
    feature = F.when(F.col("l_linenumber") % 2 == 0, "rms_contrast").otherwise("clipped_fraction")
    return table(spark, d, "lineitem").select(feature.alias("feature"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_returnflag") == "R").alias("failed"))


@query(f"""WITH {_SAMPLES_SQL}, p AS (SELECT feature, value, count(*) FILTER (failed) AS bad, count(*) FILTER (NOT failed) AS good FROM samples GROUP BY 1, 2),
 a AS (SELECT x.feature, sum(x.bad * y.good * CASE WHEN x.value < y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0 END) / (sum(x.bad * y.good)) AS auc FROM p x JOIN p y USING (feature) GROUP BY 1)
 SELECT feature, round(auc, 4)::DOUBLE AS roc_auc, (SELECT count(*) FROM samples s WHERE s.feature = a.feature) AS sample_count, abs(auc - 0.5) > 0.15 AS separates_failures FROM a""")
def calibration(spark, d):
    return metrics.calibration(_engine_samples(spark, d))


@query(f"""WITH {_SAMPLES_SQL}, t AS (SELECT DISTINCT feature, value AS threshold FROM samples)
 SELECT t.feature, threshold, count(*) FILTER (bad AND failed) AS true_positive, count(*) FILTER (bad AND NOT failed) AS false_positive, count(*) FILTER (NOT bad AND failed) AS false_negative,
 count(*) FILTER (NOT bad AND NOT failed) AS true_negative FROM (SELECT t.*, s.failed, CASE t.feature WHEN 'rms_contrast' THEN s.value < t.threshold ELSE s.value > t.threshold END AS bad FROM t JOIN samples s USING (feature)) t GROUP BY 1, 2""")
def calibration_candidates(spark, d):
    return metrics.calibration_candidates(_engine_samples(spark, d))


@query("""WITH e AS (SELECT user_id AS product_id, event_id % 4 AS surface_id, event_id AS seq, ['accept', 'retake', 'skip', 'clear', 'accept'][1 + event_id // 4 % 5] AS action, 'C' || event_id // 4 % 3 AS capture_id, 'r' || event_id % 3 AS reason FROM events),
 f AS (SELECT product_id, surface_id, list_reduce(list_prepend({'a': 'begin', 'c': '', 'c2': '', 'r': '', 'r2': ''}, list({'a': action, 'c': '', 'c2': capture_id, 'r': '', 'r2': reason} ORDER BY seq)),
 lambda s, x: {'a': x.a, 'c': CASE x.a WHEN 'accept' THEN x.c2 WHEN 'skip' THEN '' WHEN 'retake' THEN CASE WHEN s.c = x.c2 THEN '' ELSE s.c END ELSE s.c END, 'c2': '',
 'r': CASE x.a WHEN 'skip' THEN x.r2 WHEN 'accept' THEN '' WHEN 'clear' THEN '' ELSE s.r END, 'r2': ''}) AS s FROM e GROUP BY 1, 2)
 SELECT product_id, surface_id, nullif(s.c, '') AS accepted_capture_id, nullif(s.r, '') AS skip_reason FROM f""")
def step_transitions(spark, d):
    """Events of four surfaces a user, folded by windows here and one by one in the SQL."""
    e = table(spark, d, "events")
    kinds = F.array(*[F.lit(k) for k in ("accept", "retake", "skip", "clear", "accept")])
    turn = F.floor(F.col("event_id") / 4)
    rows = e.select(
        F.col("user_id").alias("product_id"), (F.col("event_id") % 4).alias("surface_id"), F.col("event_id").alias("seq"), F.get(kinds, (turn % 5).cast("int")).alias("action"),
        F.concat(F.lit("C"), (turn % 3).cast("string")).alias("capture_id"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("reason"),
    )
    return coverage.apply_step_events(rows)


@query("""SELECT l_orderkey AS capture_session_id, l_linenumber AS artifact_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 5 THEN l_quantity END ASC NULLS FIRST, l_linenumber)::INT AS place
 FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) WHERE NOT (l_linenumber = 2 AND l_quantity > 40)""")
def session_artifacts(spark, d):
    """Artifacts in their sessions' order, without those that their quality sends back."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("capture_session_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    rows = rows.withColumn("artifact_id", F.concat_ws("-", "capture_session_id", "n")).withColumn("sequence_index", F.when(F.col("q") > 5, F.col("q")))
    verdicts = rows.filter("n = 2 AND q > 40").select("artifact_id", F.lit("RETAKE").alias("verdict"))
    found = ingest.session_artifacts(ingest.without_retakes(rows, verdicts, skip=True))
    return found.select("capture_session_id", F.col("n").alias("artifact_id"), "place")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'projection_facts_divergence' END AS reason, o_orderkey % 6 = 0 AS reviewed FROM orders WHERE o_orderstatus = 'F'""")
def quarantine_detail(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "quarantined").otherwise("completed").alias("status"))
    held = orders.filter("run_id % 3 = 0").select(
        "run_id", F.lit("projection_facts_divergence").alias("reason"), F.array(F.lit("package.mrp")).alias("problems"), F.lit(1).alias("quarantined_at"), F.when(F.col("run_id") % 6 == 0, 2).alias("reviewed_at")
    )
    return ingest.quarantine_detail(orders, held).select("run_id", "reason", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("""SELECT o_orderkey AS product_id, '{"capture_session_id":"CS-' || o_orderkey || '","package_id":"PKG-' || o_orderkey || '","images":[{"sequence_index":1,"artifact_id":"A1","surface":"front","sha256":"aa"},{"sequence_index":2,"artifact_id":"A2","surface":"back","sha256":"bb"}],'
 || '"coverage":{"required_surfaces":3,"resolved_surfaces":3,"captured_surfaces":2,"complete":true,"unresolved_surfaces":[],"skipped_surfaces":[{"surface_id":"left","reason":"notPresent"}],"surfaces_needing_manual_review":["back"]}}' AS payload FROM orders""")
def extraction_job_payloads(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("product_id"))
    image = lambda i, a, s, h: F.struct(F.lit(i).alias("sequence_index"), F.lit(a).alias("artifact_id"), F.lit(s).alias("surface"), F.lit(h).alias("sha256"))
    step = lambda s, t, r=None: F.struct(F.lit(s).alias("surface_id"), F.lit(t).alias("status"), F.lit(r).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("skip_note"))
    images = orders.select("product_id", F.inline(F.array(image(2, "A2", "back", "bb"), image(1, "A1", "front", "aa"))))
    steps = orders.select("product_id", F.inline(F.array(step("front", "captured"), step("back", "capturedNeedsReview"), step("left", "skipped", "notPresent"))))
    products = orders.select("product_id", F.lit(3).alias("required"), F.lit(3).alias("resolved"), F.lit(2).alias("captured"), F.lit(True).alias("complete"))
    made = ingest.extraction_job(products, images, steps)
    return made.select(F.col("product_id").cast("long").alias("product_id"), "payload")


@query("""SELECT event_id, ['queued', 'inFlight', 'succeeded', 'queued', 'succeeded'][1 + (event_id // 3) % 5] AS retried,
 CASE event_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failedPermanent' ELSE 'queued' END AS status, (event_id % 7 + 2)::INT AS attempt_count, event_id % 7 + 1 >= 3 OR event_id % 20 >= 15 AS manual FROM events""")
def retry_and_attempts(spark, d):
    """Manual retry, the transition after an attempt, and the gate to manual entry."""
    e = table(spark, d, "events")
    status = F.get(F.array(*[F.lit(s) for s in ("queued", "inFlight", "succeeded", "failedPermanent", "succeeded")]), (F.floor(F.col("event_id") / 3) % 5).cast("int"))
    outcome = F.when(F.col("event_id") % 3 == 0, "succeeded").when(F.col("event_id") % 3 == 1, "permanent").otherwise("network")
    after = upload_queue.after_attempt(outcome, (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        "event_id", upload_queue.retried(status).alias("retried"), after["status"].alias("status"), after["attempt_count"].alias("attempt_count"),
        coverage.manual_entry_allowed(F.col("event_id") % 7 + 1, F.col("event_id") % 20).alias("manual"),
    )


@query("""SELECT l_orderkey AS product_id, coalesce(min(l_linenumber) FILTER (l_returnflag <> 'N' AND l_quantity > 10), 0)::INT AS declared_at FROM lineitem GROUP BY 1""")
def context_declared(spark, d):
    """The first revision of an order's lines that answers both flags."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").cast("int").alias("revised_at"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("imported"),
        F.when(F.col("l_quantity") > 10, F.lit(True)).alias("retail"),
    )
    return coverage.context_declared(rows, "imported", "retail").na.fill(0)


@query("""WITH p AS (SELECT l_orderkey AS image, l_linenumber AS i, l_quantity * 4.0 AS x FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS image, k AS j, k * 25.0 AS x FROM lineitem, range(0, 8) r(k)),
 o AS (SELECT p.image, i, j, greatest(0, 100 - abs(p.x - t.x)) / (200 - greatest(0, 100 - abs(p.x - t.x))) AS iou FROM p JOIN t USING (image))
 SELECT image, i, j::INT AS j FROM (SELECT *, row_number() OVER (PARTITION BY image, i ORDER BY iou DESC, j DESC) AS n FROM o WHERE iou >= 0.5) WHERE n = 1""")
def best_truth(spark, d):
    """Boxes in a row: the truth region that a prediction overlaps most, the last of equals."""
    from factloom.functions import geometry as G

    lines = table(spark, d, "lineitem")
    at = lambda x: G.bbox(x, F.lit(0.0), x + 100, F.lit(10.0))
    predictions = lines.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ordinal"), at(F.col("l_quantity").cast("double") * 4).alias("geom"))
    truths = lines.select(F.col("l_orderkey").alias("image")).distinct().withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return metrics.best_truth(predictions, truths.withColumn("geom", at(F.col("ordinal") * 25.0)))


@query("""SELECT l_orderkey AS capture_id, l_linenumber AS seq FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 2 ORDER BY l_linenumber % 2 DESC) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE n = 1""")
def distinct_lines(spark, d):
    """Every odd line holds the even one before it: of a pair the larger, odd one stays."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("seq")).distinct()
    top, odd = F.floor(F.col("seq") / 2) * 50.0, F.col("seq") % 2
    boxes = rows.select("capture_id", "seq", F.lit(0.0).alias("left"), top.alias("top"), (100.0 + odd * 100).alias("right"), (top + 20).alias("bottom"))
    return coverage.distinct_lines(boxes).select("capture_id", F.col("seq").cast("int").alias("seq"))
