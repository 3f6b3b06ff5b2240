"""Functions that had no query of their own, over table rows: labels, dates, times, tags, geometry, statements, ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import attribution, ingest, resolution
from factloom.plans.registry import query, table
from factloom.sources import files, scratch


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS labelled FROM orders")
def unit_price_labels(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "UNIT SALE PRICE: Rs 2").when(k == 1, "Unit price 3.50 per g").when(k == 2, "Rs 5 Price  per kg").otherwise("Sale of units, priced")
    return table(spark, d, "orders").select("o_orderkey", T.mentions(T.clean(text), T.UNIT_PRICE_LABELS).alias("labelled"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT % 35)::INT AS day, (l_partkey % 14)::INT AS month, (2020 + l_suppkey % 10)::INT AS year FROM lineitem)
 SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN month BETWEEN 1 AND 12 AND day BETWEEN 1 AND date_part('day', last_day(make_date(year, month, 1))) AND day > 12 THEN printf('%04d-%02d-%02d', year, month, day) END, '-') AS iso FROM p""")
def real_dates(spark, d):
    """Day, month and year printed as numbers: a date only if it exists and can be read one way."""
    part = lambda c, w: F.lpad(c.cast("int").cast("string"), w, "0")
    text = F.concat_ws("/", part(F.col("l_quantity").cast("int") % 35, 2), part(F.col("l_partkey") % 14, 2), part(2020 + F.col("l_suppkey") % 10, 4))
    readable = F.col("l_quantity").cast("int") % 35 > 12
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.when(readable, T.parse_date(text)), F.lit("-")).alias("iso"))


@query("""SELECT event_id, coalesce(CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') END, '-') AS utc FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def lenient_times(spark, d):
    """ISO times, with an offset or without; what is no time is null, not an error."""
    k, iso = F.col("event_id") % 4, F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+05:30"))).when(k == 2, "yesterday")
    return table(spark, d, "events").select("event_id", F.coalesce(F.date_format(T.time_or_null(text), "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("utc"))


@query("""SELECT p_partkey, 'FocalLength' || CASE WHEN p_size % 3 = 0 THEN ',Make' ELSE '' END AS kept, least(length(p_name) * 40, 256)::INT AS longest FROM part""")
def exif_tags(spark, d):
    """Tags without maker notes, thumbnails and empty values; long values are cut."""
    some = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("FocalLength", "MakerNote Tag", "Thumbnail Offset", "JPEGThumbnail", "Make", "Artist")]),
        F.array(F.repeat("p_name", F.lit(40)), F.lit("x"), F.lit("1"), F.lit("y"), F.when(F.col("p_size") % 3 == 0, "M").otherwise(""), F.lit("")),
    )
    kept = files.exif_kept(some)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), F.char_length(kept["FocalLength"]).alias("longest"))


@query("""SELECT l_orderkey, l_linenumber, '{"type":"BBOX","points":[{"x":0.0,"y":' || l_quantity::DOUBLE || '},{"x":10.0,"y":' || l_quantity::DOUBLE || '},{"x":10.0,"y":' || (l_quantity + 5)::DOUBLE || '},{"x":0.0,"y":' || (l_quantity + 5)::DOUBLE || '}],"space":"original_image_px"}' AS json,
 CASE WHEN l_linenumber % 2 = 0 THEN 'original_image_px' ELSE 'rectified' END AS space, (l_quantity + 5)::DOUBLE AS bottom FROM lineitem""")
def geometry_json(spark, d):
    """A box to JSON, and read back from JSON that names its space or leaves it out."""
    y = F.col("l_quantity").cast("double")
    g = G.bbox(F.lit(0.0), y, F.lit(10.0), y + 5)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.to_json(g).alias("json"))
    other = F.when(F.col("l_linenumber") % 2 == 0, F.regexp_replace("json", ',"space":"[a-z_]+"', "")).otherwise(F.regexp_replace("json", "original_image_px", "rectified"))
    back = G.from_json(other)
    return rows.select("l_orderkey", "l_linenumber", "json", back["space"].alias("space"), G.bounds(back)["b"].alias("bottom"))


@query("""SELECT l_orderkey AS run_id, array_to_string(list_filter([CASE WHEN min(l_returnflag) = 'N' THEN 'imported' END, CASE WHEN max(l_quantity) > 40 THEN 'retail' END], lambda x: x IS NOT NULL), ',') AS missing FROM lineitem GROUP BY 1""")
def context_missing(spark, d):
    """Flags without an answer: false is one, null is none."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").alias("q"))
    asked = rows.select("run_id", F.when(F.col("f") != "N", F.col("f") == "R").alias("imported"), F.when(F.col("q") <= 40, F.lit(False)).alias("retail"))
    return asked.select("run_id", F.array_join(ingest.missing_context("imported", "retail"), ",").alias("missing"))


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS seq, l_quantity::INT % 3 AS k, min(l_quantity)::INT AS q FROM lineitem GROUP BY ALL), s AS (SELECT run_id, seq, q, unnest(CASE k WHEN 0 THEN ['not_for_retail_sale'] WHEN 1 THEN ['mrp_inclusive_of_taxes'] ELSE [] END) AS statement FROM l)
 SELECT run_id, statement, count(*) AS places, string_agg(q, ',' ORDER BY seq, q) AS tops FROM s GROUP BY 1, 2""")
def observed_statements(spark, d):
    """Wordings that are no contract fields, with where they stand."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity").cast("int") % 3).alias("k")).agg(F.min("l_quantity").cast("int").alias("q"))
    text = F.when(F.col("k") == 0, "NOT FOR RETAIL  SALE").when(F.col("k") == 1, "MRP Rs. 5 (inclusive of all taxes)").otherwise("retail pack")
    y = F.col("q").cast("double")
    lines = rows.select("run_id", F.lit("A").alias("artifact_id"), (F.col("seq") * 100 + F.col("q")).alias("seq"), T.clean(text).alias("clean"), G.bbox(F.lit(0.0), y, F.lit(9.0), y + 1).alias("geom"))
    tops = F.transform("geometries", lambda g: G.bounds(g)["t"].cast("int").cast("string"))
    return attribution.observed_statements(lines).select("run_id", "statement", F.size("geometries").cast("long").alias("places"), F.array_join(tops, ",").alias("tops"))


@query("""WITH t AS (SELECT l_orderkey AS run_id, l_linenumber AS seq FROM lineitem GROUP BY ALL) SELECT run_id, 'A' || max(seq) AS best, count(*) AS views, coalesce(string_agg('A' || seq, ',' ORDER BY seq DESC) FILTER (seq < m), '') AS supporting
 FROM (SELECT *, max(seq) OVER (PARTITION BY run_id) AS m FROM t) GROUP BY run_id""")
def supporting_places(spark, d):
    """The same price read on several artifacts with rising confidence: the best reading and those that support it."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq")).distinct()
    name = F.concat(F.lit("A"), F.col("seq").cast("string"))
    candidates = rows.select(
        "run_id", F.lit("package.mrp").alias("field"), name.alias("candidate_id"), name.alias("artifact_id"), name.alias("region_id"), G.bbox(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("geom"),
        V.money(F.lit(120.0)).alias("value"), F.lit(0.9).alias("attribution_confidence"), (F.col("seq") / 10).alias("recognition_confidence"), F.lit(1.0).alias("region_quality"), "seq",
    )
    facts = resolution.resolve(candidates, rows, ("package.mrp",))
    return facts.select("run_id", F.col("artifact_id").alias("best"), F.col("views").cast("long").alias("views"), F.array_join(F.transform("supporting", lambda s: s["artifact_id"]), ",").alias("supporting"))


@query("""SELECT p_partkey AS image, CASE WHEN p_partkey % 2 = 0 THEN 'front' END AS surface, p_partkey % 5 = 0 AS failed, k::INT AS ordinal, CASE WHEN k % 2 = 0 THEN 'package.mrp' ELSE '' END AS field FROM part, range(3) r(k) WHERE p_partkey % 7 <> 0 AND k < p_partkey % 3
 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'front' END, p_partkey % 5 = 0, -1, '-' FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 = 0""")
def ground_truth(spark, d):
    """Annotations written as JSON and read back: images that are missing are skipped, those without regions stay."""
    k = F.col("p_partkey")
    region = lambda i: F.struct(F.lit(f"t{i}").alias("text"), F.lit("package.mrp" if i % 2 == 0 else "").alias("field"))
    regions = F.slice(F.array(*[region(i) for i in range(3)]), F.lit(1), (k % 3).cast("int"))
    image = F.struct(k.cast("string").alias("image"), F.when(k % 2 == 0, "front").alias("surface"), F.when(k % 5 == 0, F.lit(True)).alias("extraction_failed"), regions.alias("regions"))
    path = scratch.new_folder(spark, "annotations")
    listed = table(spark, d, "part").groupBy((k % 16).alias("bucket")).agg(F.to_json(F.struct(F.collect_list(image).alias("images"))).alias("value"))
    listed.write.partitionBy("bucket").text(path)  # a document a file
    there = table(spark, d, "part").filter(k % 7 != 0).select(k.cast("string").alias("image"))
    found = files.annotations(spark, path, there)
    return found.select(F.col("image").cast("long").alias("image"), "surface", F.col("extraction_failed").alias("failed"), F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("field", F.when(F.col("ordinal").isNull(), "-").otherwise("")).alias("field"))


@query("""SELECT c_custkey AS key, c_name AS content, length(c_name)::BIGINT AS size_bytes, true AS intact FROM customer WHERE c_custkey % 10 = 3""")
def binary_artifacts(spark, d):
    """Customers' names written as files of their own, read back as bytes with their digests."""
    names = table(spark, d, "customer").filter("c_custkey % 10 = 3").select("c_custkey", "c_name")
    path = scratch.new_folder(spark, "files")
    names.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")).repartition(8, "key").write.partitionBy("key").option("lineSep", "\n").text(path)
    read = files.artifacts(spark, path).filter(F.col("path").endswith(".txt"))
    text = F.rtrim(F.regexp_replace(F.col("content").cast("string"), "\n", ""))
    found = read.select(F.regexp_extract("path", "/key=([0-9]+)/", 1).cast("long").alias("key"), text.alias("content"), (F.col("size_bytes") - 1).alias("size_bytes"), (F.col("sha256") == F.sha2("content", 256)).alias("intact"))
    return found
