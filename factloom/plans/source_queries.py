"""Sources over table rows: recognised words to lines, barcodes, stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.registry import query, table
from factloom.sources import files


@query("""WITH p AS (SELECT doc_id AS image, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS par FROM documents),
 w AS (SELECT image, par, unnest(string_split(l, ' ')) AS text, generate_subscripts(string_split(l, ' '), 1) - 1 AS i FROM p), t AS (SELECT *, i // 5 AS line FROM w)
 SELECT image, par::INT AS par, line::INT AS line, string_agg(text, ' ' ORDER BY i) AS text, min(i % 5) * 50 AS l, max(i % 5) * 50 + 40 AS r, round(avg(50 + i % 5) / 100, 9) AS confidence,
 (row_number() OVER (PARTITION BY image ORDER BY par, min(i)) - 1)::INT AS seq FROM t WHERE trim(text) <> '' GROUP BY image, par, line""")
def words_to_lines(spark, d):
    """Words of whole documents as recognised words: a paragraph for each of their lines, five words to a printed line."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("image"), F.posexplode(F.split("text", "\n", -1)).alias("par", "l"))
    words = lines.select("image", "par", F.posexplode(F.split("l", " ", -1)).alias("i", "text"))
    laid = words.select(
        "image", F.lit(1).alias("page"), F.lit(1).alias("block"), "par", F.floor(F.col("i") / 5).cast("int").alias("line"), (F.col("par") * F.lit(2**32) + F.col("i")).alias("seq"), "text",
        (F.lit(50.0) + F.col("i") % 5).alias("confidence"), (F.col("i") % 5 * 50).alias("x"), (F.col("par") * 30).alias("y"), F.lit(40).alias("w"), F.lit(20).alias("h"),
    )
    return files.words_to_lines(laid).select("image", "par", "line", "text", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.round("confidence", 9).alias("confidence"), "seq")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'qr' WHEN 1 THEN 'ean13' WHEN 2 THEN 'upca' ELSE 'other' END AS symbology, CASE WHEN p_partkey % 4 = 0 THEN 'liveScan' ELSE 'manualEntry' END AS entry_mode FROM part""")
def barcode_records(spark, d):
    k = F.col("p_partkey") % 4
    length = F.when(k == 1, 13).when(k == 2, 12).otherwise(7)
    scans = table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), length, "0").alias("code"), F.when(k == 0, "QR").alias("format"))
    return files.barcode_records(scans).select("p_partkey", "symbology", "entry_mode")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind FROM events""")
def stored_documents(spark, d):
    """Good, blank and corrupt stored documents."""
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    text = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, " ").otherwise("{\"id\": oops")
    doc = files.json_or_null(text, "id bigint, kind string")
    return table(spark, d, "events").select("event_id", doc["id"].alias("id"), doc["kind"].alias("kind"))
