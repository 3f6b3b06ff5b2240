"""Normalizers over whole tables. Label texts are built from table columns by plain expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.plans.registry import query, table


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_unicode(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), '') AS email,
 trim(nullif(regexp_extract(text, '(?:\+91[\-\s]?)?(?:1800[\-\s]?\d{3}[\-\s]?\d{3,4}|0?\d{10}|\d{3,5}[\-\s]\d{6,8})'), '')) AS phone
 FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents)""")
def email_phone_extract(spark, d):
    c = T.clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.email(c).alias("email"), T.phone(c).alias("phone"))


def _price_text():
    """Five forms by line number: plain, grouped, confused letters, ambiguous comma, no currency."""
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    return (
        F.when(k == 0, F.concat(F.lit("MRP Rs. "), q)).when(k == 1, F.concat(F.lit("M.R.P. ₹ 1,"), F.lpad(q, 3, "0"), F.lit("/-")))
        .when(k == 2, F.concat(F.lit("MRP Rs. "), q, F.lit("OO"))).when(k == 3, F.concat(F.lit("MRP Rs "), q, F.lit(",50"))).otherwise(F.concat(F.lit("MRP "), q))
    )


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_quantity::INT::DOUBLE WHEN 1 THEN 1000.0 + l_quantity::INT
 WHEN 2 THEN l_quantity::INT * 100.0 END AS amount, true AS labelled FROM lineitem""")
def parse_money(spark, d):
    rows = table(spark, d, "lineitem").withColumn("t", T.clean(_price_text()))
    return rows.select("l_orderkey", "l_linenumber", T.parse_money(F.col("t")).alias("amount"), T.mentions(F.col("t"), T.MRP_LABELS).alias("labelled"))


_UNITS = "g gms kg ml ltr mm cm pcs boxes".split()


def _quantity_text():
    return F.concat(F.lit("Batch 7 Net Qty: "), F.col("p_size").cast("string"), F.lit(" "), F.get(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_partkey") % 9).cast("int")))


_UNIT_SQL = "['g','g','kg','ml','l','mm','cm','N',NULL][1 + p_partkey % 9]"


@query(f"""SELECT p_partkey, CASE WHEN u IS NOT NULL THEN p_size::DOUBLE END AS value, u AS unit,
 CASE u WHEN 'kg' THEN 'g' WHEN 'l' THEN 'ml' WHEN 'cm' THEN 'mm' ELSE u END AS base,
 CASE u WHEN 'kg' THEN p_size * 1000.0 WHEN 'l' THEN p_size * 1000.0 WHEN 'cm' THEN p_size * 10.0 ELSE CASE WHEN u IS NOT NULL THEN p_size * 1.0 END END::DOUBLE AS magnitude
 FROM (SELECT p_partkey, p_size, {_UNIT_SQL} AS u FROM part)""")
def parse_quantity(spark, d):
    rows = table(spark, d, "part").withColumn("q", T.parse_quantity(T.clean(_quantity_text())))
    v, u = F.col("q")["value"], F.col("q")["unit"]
    return rows.select("p_partkey", v.alias("value"), u.alias("unit"), T.base_unit(u).alias("base"), T.base_magnitude(v, u).alias("magnitude"))


@query("""SELECT p_partkey, floor(p_retailprice)::DOUBLE AS amount, CASE p_partkey % 3 WHEN 0 THEN 1.0 ELSE 100.0 END::DOUBLE AS per_value,
 CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' END AS per_unit FROM part WHERE p_partkey % 3 < 2
 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def parse_unit_price(spark, d):
    price, k = F.floor("p_retailprice").cast("string"), F.col("p_partkey") % 3
    text = (
        F.when(k == 0, F.concat(F.lit("Unit Sale Price: Rs "), price, F.lit(" per g"))).when(k == 1, F.concat(F.lit("Unit price Rs "), price, F.lit(" / 100 ml")))
        .otherwise(F.concat(F.lit("Unit price Rs "), price, F.lit("/100 g")))
    )
    p = T.parse_unit_price(T.clean(text))
    return table(spark, d, "part").select("p_partkey", p["amount"].alias("amount"), p["per_value"].alias("per_value"), p["per_unit"].alias("per_unit"))


@query(f"""SELECT p_partkey, CASE WHEN u IN ('g','ml','mm') THEN p_retailprice / p_size WHEN u IN ('kg','l') THEN p_retailprice / (p_size * 1000.0)
 WHEN u = 'cm' THEN p_retailprice / (p_size * 10.0) END AS amount,
 CASE u WHEN 'g' THEN 'g' WHEN 'kg' THEN 'g' WHEN 'ml' THEN 'ml' WHEN 'l' THEN 'ml' WHEN 'mm' THEN 'mm' WHEN 'cm' THEN 'mm' END AS per_unit
 FROM (SELECT *, {_UNIT_SQL} AS u FROM part)""")
def derive_unit_price(spark, d):
    q = T.parse_quantity(T.clean(_quantity_text()))
    p = T.derive_unit_price(F.col("p_retailprice"), q["value"], q["unit"])
    return table(spark, d, "part").select("p_partkey", p["amount"].alias("amount"), p["per_unit"].alias("per_unit"))


_MON = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


@query("""SELECT o_orderkey, iso, CASE length(iso) WHEN 10 THEN 'day' WHEN 7 THEN 'month' END AS precision FROM (SELECT o_orderkey, CASE o_orderkey % 4
 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
 ELSE CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END END AS iso FROM orders)""")
def parse_date(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = F.get(F.array(*[F.lit(m) for m in _MON]), F.month(t) - 1)
    text = (
        F.when(k == 0, F.concat(F.lit("MFG "), F.date_format(t, "MM/yyyy"))).when(k == 1, F.concat(F.lit("Mfg. Date: "), name, F.date_format(t, " yyyy")))
        .when(k == 2, F.concat(F.lit("Packed on "), F.date_format(t, "d "), name, F.date_format(t, " yyyy"))).otherwise(F.date_format(t, "dd/MM/yyyy"))
    )
    iso = T.parse_date(T.clean(text))
    return table(spark, d, "orders").select("o_orderkey", iso.alias("iso"), T.date_precision(iso).alias("precision"))


@query("SELECT p_partkey, CASE WHEN p_size * 3 BETWEEN 1 AND 120 THEN p_size * 3 END::INT AS months FROM part")
def best_before_months(spark, d):
    text = F.concat(F.lit("Best before "), (F.col("p_size") * 3).cast("string"), F.lit(" months from packaging"))
    return table(spark, d, "part").select("p_partkey", T.parse_best_before_months(text).alias("months"))


@query("SELECT n_nationkey, n_name AS country FROM nation")
def country_of_origin(spark, d):
    k = F.col("n_nationkey") % 3
    text = (
        F.when(k == 0, F.concat(F.lit("Country of Origin: "), "n_name", F.lit(" MRP Rs 120"))).when(k == 1, F.concat(F.lit("Made in "), "n_name", F.lit(", at sea")))
        .otherwise(F.concat(F.lit("Product of "), "n_name", F.lit(".")))
    )
    return table(spark, d, "nation").select("n_nationkey", T.parse_country(T.clean(text)).alias("country"))


@query("""SELECT s_suppkey, ['manufacturer','packer','importer','marketer'][1 + s_suppkey % 4] AS role, s_name AS name,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Plot ' || s_nationkey || ', Pune' ELSE '' END AS address FROM supplier""")
def parse_party(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in ("Manufactured by: ", "Packed by ", "Imported by ", "Marketed by ")]), (F.col("s_suppkey") % 4).cast("int"))
    tail = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(", Plot "), F.col("s_nationkey").cast("string"), F.lit(", Pune"))).otherwise("")
    p = T.parse_party(T.clean(F.concat(label, F.col("s_name"), tail)))
    return table(spark, d, "supplier").select("s_suppkey", p["role"].alias("role"), p["name"].alias("name"), p["address"].alias("address"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_extract(p_name, '^[^.,;|]*') END AS name FROM part")
def generic_name(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Generic Name: "), F.col("p_name"), F.lit("; shown"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.parse_generic_name(T.clean(text)).alias("name"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Consumer Care: care@acme.example, 1800 123 4567' WHEN 1 THEN 'Customer service 0' || lpad(s_suppkey::VARCHAR, 10, '9') END AS care FROM supplier""")
def consumer_care(spark, d):
    k = F.col("s_suppkey") % 3
    text = (
        F.when(k == 0, "Consumer Care:  care@acme.example, 1800 123 4567").when(k == 1, F.concat(F.lit("Customer service 0"), F.lpad(F.col("s_suppkey").cast("string"), 10, "9")))
        .otherwise("Consumer Care:")
    )
    return table(spark, d, "supplier").select("s_suppkey", T.parse_consumer_care(T.clean(text)).alias("care"))


@query("""SELECT p_partkey, code, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(code, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10
 = substr(code, 13, 1)::INT AS valid FROM (SELECT p_partkey, lpad((p_partkey * 7919)::VARCHAR, 13, '0') AS code FROM part)""")
def gtin_check(spark, d):
    code = F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "0")
    return table(spark, d, "part").select("p_partkey", code.alias("code"), T.valid_gtin(code).alias("valid"))


@query("""SELECT l_orderkey, l_linenumber, contains(w, 'incl') AS taxes, contains(w, 'not for') AS not_retail FROM (SELECT *,
 CASE l_linenumber % 3 WHEN 0 THEN 'MRP Rs 9 (incl. of all taxes)' WHEN 1 THEN 'not for retail sale' ELSE 'for retail sale' END AS w FROM lineitem)""")
def statement_mentions(spark, d):
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, "MRP Rs 9 (Incl. of all Taxes)").when(k == 1, "NOT FOR  RETAIL SALE").otherwise("For retail sale")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.mentions_taxes(text).alias("taxes"), T.mentions_not_for_retail(text).alias("not_retail"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'extra' WHEN c_custkey % 5 = 1 THEN 'front' WHEN c_custkey % 5 = 2 THEN 'side_1' ELSE 'unknown' END AS view,
 c_custkey % 5 <> 3 AS valid, CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 1 END::INT AS orientation,
 CASE WHEN c_nationkey > 0 THEN 50.0 / c_nationkey END AS focal FROM customer""")
def capture_metadata(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, " Extra_7 ").when(k == 1, "FRONT").when(k == 2, "side_1").otherwise("roof")
    oriented = F.when(F.col("c_custkey") % 3 == 0, "Rotated 90 CW").when(F.col("c_custkey") % 3 == 1, "3").otherwise("sideways")
    focal = F.concat(F.lit("50/"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(
        "c_custkey", T.surface_view(name).alias("view"), T.valid_id(F.when(k == 3, "-bad id").otherwise("IMG-1")).alias("valid"),
        T.exif_orientation(oriented).alias("orientation"), T.exif_rational(focal).alias("focal"),
    )


@query("""SELECT p_partkey, 'amount=' || printf('%.6f', round(p_retailprice, 2)) || '|currency=INR' AS money,
 sha256('PKG~' || p_partkey) AS digest FROM part""")
def value_canonical(spark, d):
    return table(spark, d, "part").select("p_partkey", V.canonical(V.money(F.col("p_retailprice"))).alias("money"), F.substring(T.prefixed_id("F-", F.lit("PKG"), F.col("p_partkey")), 3, 64).alias("digest"))
