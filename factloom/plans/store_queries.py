"""Stored objects, commits, payloads, recognition results, versions and reports over table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.functions import text as T
from factloom.operators import attribution, coverage, image_checks, ingest, lineage, metrics, payloads, resolution, upload_queue
from factloom.plans.record_queries import _engine_samples, _steps
from factloom.plans.registry import query, table
from factloom.sources import commits, files, scratch, store


def _key(column: str):
    return F.concat(F.lit("A"), F.col(column).cast("string"))


def _objects(spark, d):
    """Customers' names as objects; each seventh was changed after its digest was taken, each eleventh is gone."""
    k = F.col("c_custkey")
    digest = F.sha2(F.col("c_name").cast("binary"), 256)
    rows = table(spark, d, "customer").select(_key("c_custkey").alias("artifact_id"), digest.alias("sha256"), F.when(k % 7 == 0, F.lit("changed")).otherwise(F.col("c_name")).cast("binary").alias("content"), k.alias("k"))
    return rows.withColumn("d1", F.substring("sha256", 1, 2)).withColumn("d2", F.substring("sha256", 3, 2))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN c_custkey % 11 = 0 THEN 404 WHEN c_custkey % 7 = 0 THEN 502 ELSE 200 END::INT AS http,
 CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 THEN c_name END AS content FROM customer""")
def verified_objects(spark, d):
    """Objects written by digest, read back and checked."""
    objects = _objects(spark, d)
    path = scratch.new_folder(spark, "objects")
    objects.filter("k % 11 != 0").drop("k").repartition("d1").write.partitionBy("d1").parquet(path)
    stored = spark.read.schema("artifact_id string, sha256 string, content binary, d2 string, d1 string").parquet(path)
    found = store.verified(stored, objects.select("artifact_id", F.upper("sha256").alias("sha256")))
    return found.select(F.substring("artifact_id", 2, 20).cast("long").alias("c_custkey"), "status", store.stored_status(F.col("status")).alias("http"), F.col("content").cast("string").alias("content"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0")
def existing_objects(spark, d):
    objects = _objects(spark, d)
    return store.existing(objects.filter("k % 11 != 0"), objects.select("artifact_id", "sha256", F.col("k").alias("c_custkey"))).select("c_custkey")


@query("""SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'quarantined' ELSE 'completed' END AS status, 1::BIGINT AS observed, (o_orderstatus = 'F')::INT::BIGINT AS held FROM orders""")
def committed_runs(spark, d):
    """Orders as runs of two batches, one of which is delivered twice: each is recorded once, with all its tables."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "quarantined").otherwise("completed").alias("status"))
    log = commits.CommitLog(spark, scratch.new_folder(spark, "runs"))
    for batch, part in (("odd", "run_id % 2 = 1"), ("even", "run_id % 2 = 0"), ("odd", "run_id % 2 = 1")):
        runs = orders.filter(part)
        commits.record_run(log, batch, runs, runs.select("run_id", F.to_json(F.struct("run_id")).alias("payload")), runs.filter("status = 'quarantined'").select("run_id", F.lit("divergence").alias("reason")))
    count = lambda name, as_: log.read(name).groupBy("run_id").agg(F.count("*").alias(as_))
    return log.read("runs").select("run_id", "status").join(count("observations", "observed"), "run_id").join(count("quarantined", "held"), "run_id", "left").na.fill(0)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'UNKNOWN' WHEN l_partkey % 2 = 0 THEN 'back' ELSE 'front' END AS surface FROM lineitem""")
def regions_with_surface(spark, d):
    surfaces = table(spark, d, "part").filter("p_partkey % 5 != 0").select(_key("p_partkey").alias("artifact_id"), F.when(F.col("p_partkey") % 2 == 0, "back").otherwise("front").alias("surface"))
    regions = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _key("l_partkey").alias("artifact_id"))
    return store.with_surface(regions, surfaces).select("l_orderkey", "l_linenumber", "surface")


_PASSES = "l_orderkey AS image, l_linenumber AS n, l_quantity AS q, l_tax AS t"


@query(f"""WITH l AS (SELECT {_PASSES} FROM (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL)), e AS (SELECT image, n, 0 AS pass, 0 AS entry, 'MRP ' || q AS text, q AS x, t AS confidence FROM l WHERE n % 4 <> 3
  UNION ALL SELECT image, n, 0, 3, '7', q + 1, NULL FROM l WHERE n % 4 <> 3 UNION ALL SELECT image, n, 1, 0, 'मूल्य ' || q, q + 2, 0.5 FROM l WHERE n % 4 <> 2)
 SELECT image * 10 + n AS image, (row_number() OVER (PARTITION BY image, n ORDER BY pass, entry) - 1)::INT AS seq, text, CASE pass WHEN 0 THEN 'en' ELSE 'hi' END AS language, x::DOUBLE AS left, x + 40::DOUBLE AS right, 'QUADRILATERAL' AS kind, confidence::DOUBLE AS confidence FROM e""")
def recognised_entries(spark, d):
    """Two passes an image, with entries that are malformed, blank or lack a confidence; some passes failed."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_tax").cast("double").alias("t"))
    n = F.col("l_linenumber")
    quad = lambda x: F.format_string("[[%d,0],[%d,0.0],[%d,20],[%d,20]]", x, x + 40, x + 40, x)
    entry = lambda x, text, c: F.concat(F.lit("["), quad(x), F.lit(',["'), text, F.lit('",'), c, F.lit("]]"))
    english = F.concat(
        F.lit("[null,["), entry(F.col("q"), F.concat(F.lit("MRP "), F.col("q").cast("string")), F.col("t").cast("string")), F.lit(',[[[1,2],[3,4]],["two corners",0.9]],"odd",'),
        entry(F.col("q") + 1, F.lit("7"), F.lit("null")), F.lit(","), entry(F.col("q"), F.lit("  "), F.lit("0.9")), F.lit(",[[[1,2],[3,4],[5,6],[7,8]],[\"no confidence\"]],[]]]"),
    )
    hindi = F.concat(F.lit("[["), entry(F.col("q") + 2, F.concat(F.lit("मूल्य "), F.col("q").cast("string")), F.lit("0.5")), F.lit("]]"))
    image = (F.col("l_orderkey") * 10 + n).alias("image")
    told = lambda i, language, result: F.struct(F.lit(i).alias("pass"), F.lit(language).alias("language"), result.alias("result"))
    passes = F.explode(F.array(told(0, "en", F.when(n % 4 != 3, english)), told(1, "hi", F.when(n % 4 != 2, hindi).otherwise("{broken"))))
    bounds = G.bounds(F.col("geom"))
    return files.build_engine("entries")(rows.select(image, passes.alias("p")).select("image", "p.*")).select("image", "seq", "text", "language", bounds["l"].alias("left"), bounds["r"].alias("right"), F.col("geom.type").alias("kind"), "confidence")


@query("""SELECT o_orderkey AS image, 'en: no model; hi: no memory' AS error FROM orders WHERE o_orderkey % 3 = 0""")
def recognition_errors(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("image"))
    told = lambda i, language, error, part: orders.filter(part).select("image", F.lit(i).alias("pass"), F.lit(language).alias("language"), F.lit(error).alias("error"))
    passes = told(0, "en", "no model", "image % 3 != 2").unionByName(told(1, "hi", "no memory", "image % 3 = 0"))
    return files.recognition_errors(passes, orders.filter("image % 3 = 1"))


@query("""SELECT o_orderkey AS image, l_linenumber AS seq, 'line ' || l_linenumber AS text FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey WHERE l_linenumber > 2""")
def scripted_recognition(spark, d):
    """An engine that reads its answers from a table, built by its name."""
    lines = table(spark, d, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text")).distinct()
    return files.build_engine("scripted")(table(spark, d, "orders").select(F.col("o_orderkey").alias("image")), lines)


def _context(*answers):
    country, state, channel, *flags = answers
    return F.struct(country.alias("country"), state.alias("state"), channel.alias("sale_channel"), *[f.alias(n) for f, n in zip(flags, payloads.FLAGS[1:], strict=True)])


def _products(spark, d):
    k = F.col("o_orderkey")
    context = _context(F.when(k % 2 == 0, "IN"), F.when(k % 3 == 0, "MH"), F.lit("store"), k % 5 == 0, F.when(k % 7 != 0, F.lit(True)), F.lit(False))
    client = F.struct(F.lit("android").alias("platform"), F.lit("1.2.0").alias("app_version"), F.when(k % 2 == 0, "M1").alias("device_model"))
    identification = F.when(k % 4 == 0, F.struct(F.lit("ean13").alias("symbology"), k.cast("string").alias("code")))
    return table(spark, d, "orders").select(
        k.cast("string").alias("product_id"), F.when(k % 2 == 0, "oil").alias("product_label"), F.lit("2024-03-01 10:00:00").cast("timestamp").alias("started_at"), client.alias("client"), context.alias("context"),
        F.lit(4).alias("required"), (k % 5).cast("int").alias("resolved"), (k % 5 == 4).alias("complete"), identification.alias("identification"),
    )


_JURISDICTION = """'{"country":"IN","state":' || CASE WHEN o_orderkey % 3 = 0 THEN '"MH"' ELSE 'null' END || '}'"""


@query(f"""SELECT o_orderkey AS product_id, CASE WHEN o_orderkey % 7 <> 0 THEN '{{"schema_version":"{payloads.INPUT_VERSION}","capture_session_id":"CS-' || o_orderkey || '","package_id":"PKG-' || o_orderkey || '","client":{{"platform":"android","app_version":"1.2.0","device_model":'
 || CASE WHEN o_orderkey % 2 = 0 THEN '"M1"' ELSE 'null' END || '}},"context":{{"jurisdiction":' || {_JURISDICTION} || ',"sale_channel":"store","is_imported":' || (o_orderkey % 5 = 0) || ',"is_for_retail":true,"is_ecommerce_listing":false}},"started_at":"2024-03-01T10:00:00.000Z"}}' END AS payload FROM orders""")
def session_payloads(spark, d):
    return payloads.session_payloads(_products(spark, d)).select(F.col("product_id").cast("long").alias("product_id"), "payload")


def _captures(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    n, q, text = F.col("l_linenumber"), F.col("q"), lambda c: c.cast("string")
    exif = F.when(q % 3 == 0, F.create_map(F.lit("EXIF FocalLength"), F.concat(text(q), F.lit("/2")), F.lit("Image Orientation"), F.lit("6"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("capture_id"), F.lit("I1").alias("inspection_id"), text(F.col("l_orderkey")).alias("product_id"), F.concat(F.lit("s"), text(n)).alias("surface_id"),
        F.concat(F.lit("Side "), text(n)).alias("surface_label"), F.lit(1).alias("attempt_number"), F.when(q % 2 == 0, "accepted").otherwise("acceptedUnderManualReview").alias("disposition"), (q % 2 == 1).alias("needs_review"),
        F.lit("unresolved").alias("review_reason"), F.lit("2024-03-01 10:05:00.25").cast("timestamp").alias("captured_at"), F.lit("dev").alias("device_id"), F.lit("M1").alias("device_model"), F.lit("14").alias("os_version"),
        (q * 1000).alias("size_bytes"), F.lit("ab12").alias("sha256"), F.create_map(F.lit("flash"), F.lit("off")).alias("camera"), exif.alias("exif"), F.struct(F.lit("pass").alias("overall")).alias("quality"),
        (q * 100).alias("source_width"), (q * 75).alias("source_height"), n.alias("n"), F.col("l_orderkey"), q.alias("q"),
    )


_CAPTURES = "captures AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS q FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_CAPTURES} SELECT l_orderkey, l_linenumber, '{{"artifact_id":"IMG-' || l_orderkey || '-' || l_linenumber || '","sha256":"ab12","uri":null,"sequence_index":' || l_linenumber || ',"captured_at":"2024-03-01T10:05:00.250Z","capture_metadata":{{"width_px":' || q * 100
 || ',"height_px":' || q * 75 || ',"focal_length_mm":' || CASE WHEN q % 3 = 0 THEN (q / 2)::DOUBLE::VARCHAR ELSE 'null' END || ',"orientation":' || CASE WHEN q % 3 = 0 THEN '6' ELSE '1' END || '}}}}' AS entry FROM captures""")
def image_entries(spark, d):
    rows = _captures(spark, d)
    return rows.select("l_orderkey", F.col("n").alias("l_linenumber"), payloads.as_json(payloads.image_entry(F.col("n"))).alias("entry"))


@query(f"""WITH {_CAPTURES} SELECT l_orderkey, l_linenumber, '{{"schemaVersion":"{payloads.BUNDLE_VERSION}","ids":{{"inspectionId":"I1","productSessionId":"' || o_orderkey || '","captureId":"' || o_orderkey || '-' || l_linenumber || '","captureSessionId":"CS-' || o_orderkey || '","packageId":"PKG-'
 || o_orderkey || '","artifactId":"IMG-' || o_orderkey || '-' || l_linenumber || '","scheme":"uuid-v4-client-generated","serverMustPreserveClientIds":true}},"inspection":{{"inspectionId":"I1","premisesLabel":"Shop","inspectorReference":null,"startedAtUtc":"2024-03-01T09:00:00.000Z"}},"productSession":{{"productSessionId":"'
 || o_orderkey || '","productLabel":' || CASE WHEN o_orderkey % 2 = 0 THEN '"oil"' ELSE 'null' END || ',"startedAtUtc":"2024-03-01T10:00:00.000Z","coverage":{{"requiredSteps":4,"resolvedSteps":' || o_orderkey % 5 || ',"label":"' || o_orderkey % 5 || ' of 4 captured","complete":' || (o_orderkey % 5 = 4)
 || '}}}},"context":{{"jurisdiction":' || {_JURISDICTION} || ',"saleChannel":"store","isImported":' || (o_orderkey % 5 = 0) || ',"isForRetail":' || CASE WHEN o_orderkey % 7 <> 0 THEN 'true' ELSE 'null' END || ',"isEcommerceListing":false,"complete":' || (o_orderkey % 7 <> 0)
 || '}},"surface":{{"surfaceId":"s' || l_linenumber || '","surfaceLabel":"Side ' || l_linenumber || '","attemptNumber":1,"totalAttempts":' || CASE WHEN l_linenumber < 4 THEN 2 ELSE 0 END || ',"disposition":"' || CASE q % 2 WHEN 0 THEN 'accepted' ELSE 'acceptedUnderManualReview' END
 || '","manualReviewRequired":' || (q % 2 = 1) || ',"manualReviewReason":' || CASE q % 2 WHEN 1 THEN '"unresolved"' ELSE 'null' END || '}},"capturedAtUtc":"2024-03-01T10:05:00.250Z","device":{{"deviceId":"dev","model":"M1","osVersion":"14"}},"file":{{"fileName":"' || o_orderkey || '-' || l_linenumber
 || '.jpg","mimeType":"image/jpeg","sizeBytes":' || q * 1000 || ',"sha256":"ab12","re_encoded":false,"exifPreserved":true}},"cameraSettings":{{"flash":"off"}},"exif":' || CASE WHEN q % 3 = 0 THEN '{{"EXIF FocalLength":"' || q || '/2","Image Orientation":"6"}}' ELSE '{{}}' END
 || ',"quality":{{"overall":"pass"}},"identification":' || CASE WHEN o_orderkey % 4 = 0 THEN '{{"symbology":"ean13","code":"' || o_orderkey || '","note":"{payloads.IDENTIFICATION_NOTE}"}}' ELSE 'null' END || '}}' AS payload FROM captures JOIN orders ON o_orderkey = l_orderkey""")
def capture_bundles(spark, d):
    captures = _captures(spark, d)
    inspections = spark.createDataFrame([("I1", "Shop", None, "2024-03-01 09:00:00")], "inspection_id string, premises_label string, inspector_reference string, started_at string")
    attempts = captures.filter("n < 4").select("product_id", "surface_id", F.lit(2).alias("total"))
    made = payloads.bundles(captures, _products(spark, d), inspections.withColumn("started_at", F.col("started_at").cast("timestamp")), attempts)
    parts = F.split("capture_id", "-")
    return made.select(parts[0].cast("long").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), "payload")


@query("""WITH t AS (SELECT event_id AS seq, user_id AS product_id, CASE WHEN event_id % 3 = 1 THEN event_id END AS capture_id FROM events WHERE event_id % 2 = 0), c AS (SELECT event_id AS capture_id, user_id AS product_id FROM events WHERE event_id % 3 = 1)
 SELECT product_id, seq, coalesce(capture_id, -1) AS capture_id, CASE event_id % 3 WHEN 0 THEN 'captureSession' WHEN 1 THEN 'artifact' ELSE 'extractionJob' END AS kind, 0 AS attempts FROM t JOIN events ON event_id = seq
 UNION ALL SELECT product_id, coalesce(m, 0) + row_number() OVER (PARTITION BY product_id ORDER BY capture_id), capture_id, 'artifact', 0 FROM c LEFT JOIN (SELECT product_id, max(seq) AS m FROM t GROUP BY 1) USING (product_id) WHERE capture_id % 2 = 1""")
def enqueued_artifacts(spark, d):
    """Captures of which every second one is queued already."""
    e = table(spark, d, "events")
    kind = F.get(F.array(*[F.lit(k) for k in upload_queue.KINDS]), (F.col("event_id") % 3).cast("int"))
    tasks = e.filter("event_id % 2 = 0").select(
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("task_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("product_id"), kind.alias("kind"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"),
        F.col("ts").alias("next_attempt_at"), F.when(kind == "artifact", F.col("event_id")).alias("capture_id"), F.lit("{}").alias("payload"),
    )
    captures = e.filter("event_id % 3 = 1").select(F.col("event_id").alias("capture_id"), F.col("user_id").alias("product_id"), F.lit(0).alias("captured_at"), F.lit("{}").alias("payload"))
    return upload_queue.enqueue_artifacts(tasks, captures, F.lit("2024-02-01").cast("timestamp")).select("product_id", "seq", F.coalesce("capture_id", F.lit(-1)).alias("capture_id"), "kind", "attempts")


_STATES = """steps AS (SELECT l_orderkey AS product_id, l_linenumber AS ordinal, min(l_quantity)::INT AS q FROM lineitem GROUP BY ALL), s AS (SELECT product_id, ordinal, ordinal <= 4 AND q % 3 = 2 AS open FROM steps)"""


@query(f"""WITH {_STATES} SELECT product_id, array_to_string(list_concat(coalesce(list('s' || ordinal ORDER BY ordinal) FILTER (open), []), CASE WHEN product_id % 4 = 1 THEN [] ELSE ['context'] END), ',') AS outstanding,
 count(*) FILTER (open) = 0 AND product_id % 4 = 1 AS may_finish FROM s GROUP BY product_id""")
def finish_gates(spark, d):
    states = _steps(spark, d)
    context = states.select("product_id").distinct().filter("product_id % 4 < 3").select("product_id", (F.col("product_id") % 4 == 1).alias("complete"))
    return coverage.finish_gate(states, context).withColumn("outstanding", F.array_join("outstanding", ","))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 1 OR (l_linenumber % 3 = 2 AND l_quantity > 25) AS may_skip, l_returnflag <> 'R' OR l_linenumber >= 3 AS may_accept FROM lineitem""")
def capture_gates(spark, d):
    reason = F.when(F.col("l_linenumber") % 3 == 1, "notPresent").when(F.col("l_linenumber") % 3 == 2, "other")
    disposition = coverage.acceptance(F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass"), F.col("l_linenumber"))
    skip = coverage.skip_is_valid(reason, F.when(F.col("l_quantity") > 25, "torn").otherwise(" "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", skip.alias("may_skip"), coverage.accept_gate(disposition).alias("may_accept"))


@query(f"""WITH c AS (SELECT l_orderkey AS run_id, l_returnflag AS status, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1, 2)
 SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN '{ingest.HELD_BACK}' ELSE '{ingest.COMPLETE}' || coalesce((SELECT string_agg(status || '=' || n, ', ' ORDER BY status) FROM c WHERE c.run_id = o_orderkey), 'none') END AS message FROM orders""")
def job_messages(spark, d):
    counts = table(spark, d, "lineitem").filter("l_orderkey % 5 != 0").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"))
    return ingest.job_message(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "P").alias("quarantined")), counts)


@query(f"""SELECT l_orderkey AS run_id, l_linenumber AS n, '{lineage.PIPELINE}' AS pipeline_version, '{T.VERSION}' AS normalizer_version, '{attribution.VERSION}' AS attribution_version, '{resolution.VERSION}' AS resolver_version,
 CASE WHEN o_orderkey % 3 = 0 THEN 'mine' WHEN o_orderkey % 3 = 1 THEN '{image_checks.SERVER}' ELSE 'lost' END AS quality_policy_version, o_orderkey % 3 = 0 AS quality_policy_calibrated, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'words' END, 'unknown') AS ocr_engine FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def stamped_facts(spark, d):
    """Every line item as a fact with the versions of its run."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(
        k.alias("run_id"), F.when(k % 2 == 0, "words").alias("ocr_engine"), F.lit("m").alias("ocr_model_id"), F.lit("1").alias("ocr_model_version"),
        F.when(k % 3 == 0, "mine").when(k % 3 == 1, image_checks.SERVER).otherwise("lost").alias("policy_version"),
    )
    mine = spark.createDataFrame([("mine", True, 800, 1, "blur", "sharpness", 9.0, None, None, None, False)], image_checks.POLICY_SCHEMA)
    versions = lineage.run_versions(runs, image_checks.policies(spark).unionByName(mine))
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n"))
    kept = ("pipeline_version", "normalizer_version", "attribution_version", "resolver_version", "quality_policy_version", "quality_policy_calibrated", "ocr_engine")
    return lineage.stamped(facts, versions).select("run_id", "n", *kept)


@query("""SELECT 'resolver_version' AS version, 'a' AS before, 'b' AS after, count(*) AS runs FROM orders WHERE o_orderkey % 2 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'quality_policy_calibrated', 'false', 'true', count(*) FROM orders WHERE o_orderkey % 3 = 0 HAVING count(*) > 0""")
def changed_versions(spark, d):
    """Two runs of every order's package, of which some were made by another resolver or policy."""
    k = F.col("package_id")
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("package_id")).withColumns({c: F.lit("a") for c in lineage.VERSIONS}).withColumn("quality_policy_calibrated", F.lit(False))
    after = base.withColumn("resolver_version", F.when(k % 2 == 0, "b").otherwise("a")).withColumn("quality_policy_calibrated", k % 3 == 0)
    return lineage.changed_between(base, after)


@query("""WITH s AS (SELECT l_returnflag AS engine, round(avg(l_discount)::DOUBLE, 2) AS cer, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag AS engine, l_linenumber AS k, count(*) FILTER (l_linestatus = 'F') AS tp, count(*) FILTER (l_linestatus <> 'F') AS fp FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
 j AS (SELECT engine, string_agg('"f' || k || '":' || k, ',' ORDER BY k) AS fields FROM f GROUP BY 1)
 SELECT engine, 'm-' || engine AS model_id, n AS image_count, CASE engine WHEN 'N' THEN NULL ELSE 0.5 END::DOUBLE AS detection_precision, cer AS mean_cer, (SELECT string_agg('f' || k, ',' ORDER BY k) FROM f WHERE f.engine = s.engine) AS fields,
  (SELECT round(CASE WHEN tp > 0 THEN 1.0 ELSE 0 END, 4)::DOUBLE FROM f WHERE f.engine = s.engine AND k = 1) AS f1_match, 12.3::DOUBLE AS p95_ms, 'none' AS notes FROM s""")
def benchmark_reports(spark, d):
    """Return flags as engines; the documents are taken apart again to be compared."""
    lines = table(spark, d, "lineitem").withColumn("engine", F.col("l_returnflag"))
    engines = lines.groupBy("engine").agg(F.round(F.avg("l_discount"), 2).alias("mean_cer"), F.count("*").alias("image_count")).select(
        "*", F.concat(F.lit("m-"), "engine").alias("model_id"), F.lit("1").alias("model_version"), F.lit(0.25).alias("mean_wer"), F.lit(10.0).alias("mean_latency_ms"), F.lit(12.34).alias("p95_latency_ms"), F.lit(0.0).alias("exact_match"),
        F.array(F.lit("none")).alias("notes"),
    )
    detection = engines.filter("engine != 'N'").select("engine", *[F.lit(0.5).alias(c) for c in ("precision", "recall", "hmean", "mean_iou")], *[F.lit(1).alias(c) for c in ("true_positives", "false_positives", "false_negatives")])
    good = F.count_if(F.col("l_linestatus") == "F")
    fields = lines.filter("l_linenumber <= 2").groupBy("engine", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field")).agg(good.alias("tp"), (F.count("*") - good).alias("fp"), F.lit(0).alias("fn"), good.alias("value_matches"))
    fields = fields.select("*", F.lit(0.5).alias("precision"), F.lit(1.0).alias("recall"), F.lit(0.6667).alias("f1"))
    report = F.from_json("report", "model_id string, image_count long, detection struct<precision:double>, recognition struct<mean_cer:double>, fields map<string,struct<value_exact_match:double>>, latency struct<p95_ms:double>, notes array<string>")
    made = lineage.benchmark_reports(engines, detection, fields).select("engine", report.alias("r"))
    return made.select(
        "engine", "r.model_id", "r.image_count", F.col("r.detection.precision").alias("detection_precision"), F.col("r.recognition.mean_cer").alias("mean_cer"), F.array_join(F.map_keys("r.fields"), ",").alias("fields"),
        F.col("r.fields")["f1"]["value_exact_match"].alias("f1_match"), F.col("r.latency.p95_ms").alias("p95_ms"), F.array_join("r.notes", ",").alias("notes"),
    )


@query("""WITH s AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'rms_contrast' ELSE 'clipped_fraction' END AS feature, l_quantity::DOUBLE AS value, l_returnflag = 'R' AS failed FROM lineitem), t AS (SELECT DISTINCT feature, value AS threshold FROM s),
 c AS (SELECT t.feature, threshold, count(*) FILTER (bad AND failed) AS h, count(*) FILTER (bad AND NOT failed) AS f, count(*) FILTER (NOT bad AND failed) AS m, count(*) FILTER (NOT bad AND NOT failed) AS ok
  FROM (SELECT t.*, s.failed, CASE t.feature WHEN 'rms_contrast' THEN s.value < t.threshold ELSE s.value > t.threshold END AS bad FROM t JOIN s USING (feature)) t GROUP BY 1, 2)
 SELECT feature, threshold, CASE WHEN h + f > 0 THEN round(h / (h + f), 4) ELSE 0 END::DOUBLE AS retake_precision, CASE WHEN h + m > 0 THEN round(h / (h + m), 4) ELSE 0 END::DOUBLE AS retake_recall, h AS true_retakes, f AS false_retakes, m AS missed_failures, ok AS correctly_passed FROM c""")
def calibration_report(spark, d):
    return lineage.calibration_report(metrics.calibration_candidates(_engine_samples(spark, d)))
