"""Golden values of the normalizers; None means that a parser declines."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.udfs import casefold, edit_distance, word_error_rate


def check(spark, parse, cases):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    cleaned = spark.createDataFrame(rows.select("i", T.clean_unicode(F.col("t")).alias("t")).collect(), "i int, t string")
    got = {r.i: r.v for r in cleaned.select("i", parse(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(cases):
        value = got[i]
        if hasattr(value, "asDict"):
            value = tuple(value)
        assert value == want, (text, value, want)


def test_money(spark):
    check(spark, T.parse_money, [
        ("MRP Rs. 120", 120.0), ("M.R.P. ₹ 120.50", 120.5), ("MRP INR 1,20,000", 120000.0), ("Maximum Retail Price Rs 45/-", 45.0), ("mrp rs.99", 99.0),
        ("Rs 1,250", 1250.0), ("Net 500g MRP Rs 120", 120.0), ("MRP Rs. 5OO", 500.0), ("MRP 120", None), ("120", None), ("MRP Rs 120,50", None), ("", None), (None, None),
    ])


def test_quantity(spark):
    check(spark, T.parse_quantity, [
        ("Net Quantity: 500 g", (500.0, "g")), ("Net Wt. 1.5 kg", (1.5, "kg")), ("Net Qty 250ml", (250.0, "ml")), ("Net Contents: 2 L", (2.0, "l")), ("Net Quantity 12 N", (12.0, "N")),
        ("शुद्ध मात्रा 500 ग्राम", (500.0, "g")), ("Net Quantity ५०० g", (500.0, "g")), ("Batch 500 XYZ", None), (None, None),
    ])


def test_dates(spark):
    check(spark, T.parse_date, [
        ("MFG 07/2026", "2026-07"), ("Mfg. Date: Jul 2026", "2026-07"), ("Best Before: 01/2027", "2027-01"), ("Packed on 14 Jul 2026", "2026-07-14"), ("MFG 07/26", "2026-07"),
        ("25/04/2026", "2026-04-25"), ("03/04/2026", None), ("31/02/2026", None), ("07/2199", None), ("", None),
    ])


def test_unit_price(spark):
    check(spark, T.parse_unit_price, [("Unit Sale Price: Rs 0.24 per g", (0.24, 1.0, "g")), ("Unit price Rs 12 / 100 g", (12.0, 100.0, "g")), ("Unit price Rs 12/100 g", None), ("Price per ml: Rs 0.5", (0.5, 1.0, "ml"))])


def test_parties(spark):
    check(spark, T.parse_party, [
        ("Manufactured by: Acme Foods Ltd, Pune 411001", ("manufacturer", "Acme Foods Ltd", "Pune 411001")), ("Packed by Beta Packers, Nashik", ("packer", "Beta Packers", "Nashik")),
        ("Imported by Gamma Imports Pvt Ltd, Mumbai", ("importer", "Gamma Imports Pvt Ltd", "Mumbai")), ("Marketed by Delta Marketing", ("marketer", "Delta Marketing", "")), ("Acme Foods", None),
    ])


def test_origin_and_names(spark):
    check(spark, T.parse_country, [
        ("Country of Origin: India", "India"), ("Made in Germany", "Germany"), ("Product of Sri Lanka", "Sri Lanka"), ("Made in P.R.C.", "P.R.C"), ("Country of Origin: India MRP Rs 120", "India"), ("India Gate Basmati Rice", None),
    ])
    check(spark, T.parse_generic_name, [("ACME GOLD", None), ("Generic Name: Refined Sunflower Oil", "Refined Sunflower Oil")])
    check(spark, T.parse_consumer_care, [("Consumer Care:", None), ("Consumer Care: care@acme.example, 1800 123 4567", "Consumer Care: care@acme.example, 1800 123 4567")])


def test_flags_and_durations(spark):
    check(spark, T.mentions_taxes, [("MRP Rs 120 (incl. of all taxes)", True), ("Inclusive of all taxes", True), ("MRP Rs 120", False)])
    check(spark, T.mentions_not_for_retail, [("NOT FOR RETAIL SALE", True), ("For retail sale", False)])
    check(spark, T.parse_best_before_months, [("Best before 9 months from packaging", 9), ("Best before 01/2027", None)])
    check(spark, lambda c: T.mentions(c, T.MRP_LABELS), [("M.R.P. Rs 120", True), ("अधिकतम खुदरा मूल्य 120", True), ("Price on request", False)])


def test_hygiene(spark):
    check(spark, lambda c: c, [("  MRP\n\nRs.  120  ", "MRP Rs. 120"), ("ＭＲＰ ①", "MRP 1"), ("a b", "a b")])
    check(spark, T.repair_numeric, [("SOAP", "SOAP"), ("5OO", "500"), ("SOO", "SOO")])


@pytest.mark.parametrize("code,valid", [("4006381333931", True), ("036000291452", True), ("73513537", True), ("4006381333913", False), ("40063813339", False), ("40063813339XY", False), ("", False)])
def test_gtin(spark, code, valid):
    assert spark.range(1).select(T.valid_gtin(F.lit(code)).alias("v")).first().v is valid


def test_udfs(spark):
    rows = spark.createDataFrame([("a b c", "a x c d", "Straße"), ("", "x", "A"), ("", "", None)], "t string, r string, w string")
    got = rows.select(word_error_rate("t", "r").alias("e"), casefold("w").alias("f")).collect()
    assert [r.e for r in got] == [2 / 3, 1.0, 0.0] and [r.f for r in got] == ["strasse", "a", None]
    assert edit_distance(list("kitten"), list("sitting")) == 3


def test_dates_look_for_each_part_once(spark):
    """A part of a date is searched once however often it is looked at, and an empty one is never cast: that is an exception, made and caught."""
    plan = spark.createDataFrame([("",)], "t string").select(T.parse_date(F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 10 and "cast(regexp_extract(" not in plan
