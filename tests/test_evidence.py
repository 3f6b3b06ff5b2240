"""Geometry, resolution, projection and the extraction plan on hand-made packages."""

import random

from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.functions import values as V
from factloom.operators import attribution, neighbours, projection, resolution
from factloom.plans import evidence_queries, extraction
from factloom.schemas import POINT_RING, RESOLVED_FIELDS, VALUE
from factloom.sources import scratch

ROW = f"run_id string, field string, candidate_id string, artifact_id string, region_id string, geom {POINT_RING}, value {VALUE}, attribution_confidence double, recognition_confidence double, region_quality double, seq int"


def box(x1, y1, x2, y2):
    return ("BBOX", [(x1, y1), (x2, y1), (x2, y2), (x1, y2)], G.ORIGINAL)


def value(**parts):
    return tuple(parts.get(k) for k in "kind amount currency qty unit per_value per_unit text name address".split())


def money(amount):
    return value(kind="money", amount=amount, currency="INR")


def candidate(seq, v, field="package.mrp", artifact=None, geom=None, attribution=0.94, ocr=0.97):
    geom = geom or box(100.0, 200.0, 420.0, 260.0)
    return ("r", field, f"c{seq}", artifact or f"a{seq}", f"g{seq}", geom, v, attribution, ocr, 1.0, seq)


def resolve(spark, *rows, field="package.mrp"):
    frame = spark.createDataFrame(list(rows), ROW)
    return resolution.resolve(frame, spark.createDataFrame([("r",)], "run_id string"), (field,)).first()


def test_agreement_counts_artifacts(spark):
    three = resolve(spark, *[candidate(i, money(120.0)) for i in range(3)])
    one = resolve(spark, candidate(0, money(120.0)))
    same = resolve(spark, candidate(0, money(120.0), artifact="a"), candidate(1, money(120.0), artifact="a", geom=box(0.0, 0.0, 10.0, 10.0)))
    assert three.status == "OBSERVED" and len(three.supporting) == 2 and three.confidence > one.confidence == same.confidence


def test_redetection_is_no_support(spark):
    fact = resolve(spark, candidate(0, money(120.0), artifact="a"), candidate(1, money(120.0), artifact="a", geom=box(102.0, 201.0, 418.0, 262.0)))
    assert fact.status == "OBSERVED" and fact.supporting == []


def test_conflict_and_decisive_gap(spark):
    conflict = resolve(spark, candidate(0, money(120.0), ocr=0.98), candidate(1, money(180.0), ocr=0.95))
    assert conflict.status == "CONFLICTING" and conflict.value is None and len(conflict.conflicts) == 2
    clear = resolve(spark, candidate(0, money(120.0), attribution=0.99), candidate(1, money(180.0), attribution=0.30, ocr=0.40))
    assert clear.status == "OBSERVED" and clear.value.amount == 120.0 and "Rejected" in clear.note and "180" in clear.note


def test_equal_values_keep_detail(spark):
    q = resolve(spark, candidate(0, value(kind="quantity", qty=0.5, unit="kg"), "package.net_quantity"), candidate(1, value(kind="quantity", qty=500.0, unit="g"), "package.net_quantity"), field="package.net_quantity")
    assert q.status == "OBSERVED"
    day = resolve(spark, candidate(0, value(kind="text", text="2026-07"), "declarations.best_before"), candidate(1, value(kind="text", text="2026-07-14"), "declarations.best_before"), field="declarations.best_before")
    assert day.value.text == "2026-07-14"
    two = resolve(spark, candidate(0, value(kind="text", text="2026-07"), "declarations.best_before"), candidate(1, value(kind="text", text="2026-08"), "declarations.best_before"), field="declarations.best_before")
    assert two.status == "CONFLICTING"
    party = resolve(spark, candidate(0, value(kind="party", name="Acme", address="Pune"), "declarations.packer"), candidate(1, value(kind="party", name="ACME", address="Pune 411001"), "declarations.packer"), field="declarations.packer")
    assert party.value.address == "Pune 411001"


def test_nothing_read_is_unknown(spark):
    empty = spark.createDataFrame([], ROW)
    facts = resolution.resolve(empty, spark.createDataFrame([("r",)], "run_id string")).collect()
    assert len(facts) == len(RESOLVED_FIELDS) and {f.status for f in facts} == {"UNKNOWN"}


def test_geometry(spark):
    poly = lambda *p: G.geometry("POLYGON", F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in p]))
    turned = poly((0, 0), (100, 100), (90, 110), (-10, 10))
    a = G.bbox(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    b = G.bbox(*[F.lit(float(v)) for v in (0, 0, 10, 10)], space="derived_image_px")
    row = spark.range(1).select(
        G.area(poly((0, 0), (100, 0), (0, 100))).alias("area"), G.rotation_degrees(turned).alias("angle"), G.iou(a, a).alias("same"), G.iou(a, b).alias("other"),
        G.is_valid(poly((0, 0), (1, 1))).alias("short"), G.from_json(G.to_json(a)).alias("back"),
    ).first()
    assert row.area == 5000 and abs(row.angle - 45) < 1 and (row.same, row.other, row.short) == (1, 0, False) and row.back.type == "BBOX"


def lines(spark, *rows):
    made = [("r", a, i, t, box(0.0, float(y), 400.0, y + 40.0), 0.96, s) for i, (a, t, y, s) in enumerate(rows)]
    frame = spark.createDataFrame(made, f"run_id string, artifact_id string, seq int, text string, geom {POINT_RING}, confidence double, surface string")
    return {f.field: f for f in extraction.facts_of_lines(extraction.prepared(frame)).collect()}


def test_front_and_back(spark):
    facts = lines(
        spark, ("f", "ACME GOLD", 60, "front"), ("f", "Generic Name: Sunflower Oil", 140, "front"), ("f", "Net Quantity 500 g", 220, "front"), ("f", "MRP Rs. 120 (incl. of all taxes)", 300, "front"),
        ("b", "Manufactured by: Acme Foods, Pune", 100, "back"), ("b", "Country of Origin: India", 180, "back"), ("b", "Mfg. Date: Jul 2026", 260, "back"), ("b", "Best Before: 01/2027", 340, "back"),
        ("b", "Consumer Care: care@acme.example", 420, "back"), ("b", "MRP Rs. 120", 500, "back"),
    )
    assert facts["package.mrp"].status == "OBSERVED" and facts["package.mrp"].views == 2
    assert facts["package.unit_sale_price"].status == "DERIVED" and facts["package.unit_sale_price"].value.amount == 0.24 and len(facts["package.unit_sale_price"].source_fact_ids) == 2
    assert facts["declarations.manufacture_date"].value.text == "2026-07" and facts["declarations.best_before"].value.text == "2027-01"
    assert facts["declarations.packer"].status == "UNKNOWN" and len(facts) == 13


def test_label_in_neighbour_and_unlabelled_price(spark):
    assert lines(spark, ("f", "M.R.P.", 300, "front"), ("f", "Rs. 120", 340, "front"))["package.mrp"].value.amount == 120
    assert lines(spark, ("f", "ＭＲＰ Rs. １２０", 300, "front"))["package.mrp"].value.amount == 120
    assert lines(spark, ("f", "Special offer Rs. 99", 300, "front"))["package.mrp"].status == "UNKNOWN"
    care = lines(spark, ("f", "Consumer Care:", 400, "front"), ("f", "care@acme.example", 440, "front"))["declarations.consumer_care"]
    assert care.value.text == "Consumer Care: care@acme.example"


def test_printed_price_is_not_replaced(spark):
    facts = lines(spark, ("f", "MRP Rs. 120", 100, "front"), ("f", "Net Quantity 500 g", 300, "front"), ("f", "Unit Sale Price: Rs 0.30 per g", 500, "front"))
    assert facts["package.unit_sale_price"].status == "OBSERVED" and facts["package.unit_sale_price"].value.amount == 0.30


def test_results_do_not_depend_on_partitions(spark):
    rows = [candidate(i, money(100.0 + i % 3), attribution=0.9 - i * 0.01) for i in range(8)]
    frame, runs = spark.createDataFrame(rows, ROW), spark.createDataFrame([("r",)], "run_id string")
    once = [resolution.resolve(frame.repartition(n), runs, ("package.mrp",)).first() for n in (1, 7)]
    assert once[0] == once[1]


def test_forged_projection_is_quarantined(spark):
    frame = spark.createDataFrame([candidate(0, money(120.0))], ROW)
    runs = spark.createDataFrame([("r",)], "run_id string")
    facts = resolution.resolve(frame, runs)
    good = projection.project(facts)
    forged = good.withColumn("package__mrp", F.lit("amount=1"))
    assert projection.divergences(good, facts).isEmpty()
    released = projection.quarantine(runs, projection.divergences(forged, facts), projection.fact_problems(facts)).first()
    assert not released.released and released.reason == "projection_facts_divergence"
    assert V.canonical is not None and projection.fact_problems(facts).isEmpty()


def test_hashes_cover_the_whole_document(spark):
    frame = spark.createDataFrame([candidate(0, money(120.0)), candidate(1, money(120.0))], ROW)
    runs = spark.createDataFrame([("r",)], "run_id string")
    facts = resolution.resolve(frame, runs)
    header = lambda **more: runs.withColumns({"package_id": F.lit("PKG"), **{k: F.lit(v) for k, v in more.items()}})
    base = projection.hashes(facts, header(sale_channel="retail")).first()
    changed = {
        "note": facts.withColumn("note", F.concat("note", F.lit("!"))), "conflicts": facts.withColumn("conflicts", F.lit(None).cast(dict(facts.dtypes)["conflicts"])),
        "artifact": facts.withColumn("artifact_id", F.concat("artifact_id", F.lit("x"))), "derivation": facts.withColumn("source_fact_ids", F.array(F.lit("F-1"))),
    }
    for name, other in changed.items():
        moved = projection.hashes(other, header(sale_channel="retail")).first()
        assert name == "conflicts" or (moved.content_hash != base.content_hash and moved.semantic_hash != base.semantic_hash), name
    ids = projection.hashes(facts.withColumn("fact_id", F.concat("fact_id", F.lit("x"))).withColumn("region_id", F.lit("R-x")), header(sale_channel="retail")).first()
    assert ids.content_hash != base.content_hash and ids.semantic_hash == base.semantic_hash
    assert projection.hashes(facts, header(sale_channel="wholesale")).first().semantic_hash != base.semantic_hash
    again = projection.hashes(facts, header(sale_channel="retail", extraction_run_id="RUN-2")).first()
    assert again == base


def test_absence_needs_a_basis(spark):
    rows = [("r", "package.mrp", "DECLARED_ABSENCE", n, 0.9) for n in (None, "", "  ", "The panel says free sample.")]
    frame = spark.createDataFrame(rows, "run_id string, field string, status string, note string, confidence double").withColumn("run_id", F.monotonically_increasing_id().cast("string"))
    facts = frame.withColumns({c: F.lit(None).cast("string") for c in ("artifact_id", "region_id", "value")} | {c: F.lit(None).cast("array<string>") for c in ("source_fact_ids", "conflicts")})
    assert [r.problem for r in projection.fact_problems(facts).collect()] == 3 * ["absence without a stated basis"]


def test_near_duplicates_fold_texts(spark):
    texts = [("r", "a", t) for t in ("STRASSE one", "Net 500 g", "abc")] + [("r", "b", t) for t in ("Straße One", "net 500 G", "xyz")] + [("r", "c", "other line")]
    pairs = resolution.near_duplicate_artifacts(spark.createDataFrame(texts, "run_id string, artifact_id string, clean string")).collect()
    assert [(p.a, p.b, p.overlap) for p in pairs] == [("a", "b", 1.0)]


def test_a_crowded_run_is_held_back_and_no_other(spark, monkeypatch):
    from factloom.functions import values as V
    from factloom.operators import projection

    monkeypatch.setattr(resolution, "MOST", 3)
    rows = [(run, seq) for run, n in (("few", 3), ("many", 4)) for seq in range(n)]
    made = spark.createDataFrame(rows, "run_id string, seq int").select(
        "run_id", F.lit("package.mrp").alias("field"), F.col("seq").cast("string").alias("candidate_id"), F.concat(F.lit("A"), "seq").alias("artifact_id"), F.concat(F.lit("R"), "seq").alias("region_id"),
        G.bbox(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("geom"), V.money(F.lit(10.0)).alias("value"), F.lit(0.9).alias("attribution_confidence"), F.lit(0.9).alias("recognition_confidence"), F.lit(1.0).alias("region_quality"), "seq",
    )
    facts = resolution.resolve(made, made, ("package.mrp",))
    assert {r.run_id: (r.status, r.views) for r in facts.collect()} == {"few": ("OBSERVED", 3), "many": ("UNKNOWN", None)}
    held = projection.quarantine(made.select("run_id").distinct(), projection.divergences(projection.project(facts), facts), projection.fact_problems(facts))
    got = {r.run_id: (r.released, r.problems) for r in held.collect()}
    assert got["few"][0] and got["many"] == (False, ["too many candidates"])


def test_copies_are_members_and_only_classes_pair(spark):
    texts = [("r", f"c{i:03d}", t) for i in range(200) for t in ("line one", "line two", "line three")] + [("r", "near", t) for t in ("line one", "line two", "line three", "line four")] + [("r", "none", "x"), ("s", "c000", "line one")]
    members, pairs = resolution.near_duplicate_classes(spark.createDataFrame(texts, "run_id string, artifact_id string, clean string"))
    got = {(r.run_id, r.artifact_id): r.class_id for r in members.collect()}
    assert len(got) == 203 and {v for (run, _), v in got.items() if run == "r"} == {"c000", "near", "none"}
    assert [(r.a, r.b, r.overlap) for r in pairs.collect()] == [("c000", "near", 1.0)]


def test_pairs_of_copies_are_spread_out_after_the_last_shuffle(spark, monkeypatch):
    """All pairs of odd texts and copies, whatever the length of a list; rows of pairs of artifacts are never shuffled."""
    monkeypatch.setattr(resolution, "MEMBERS", 7)
    rng = random.Random(3)
    kinds = [rng.sample([f"line {k}" for k in range(14)], rng.randint(1, 9)) for _ in range(12)]
    sets = {(run, i): {t for t in rng.choice(kinds) + rng.choice([[], [], ["x"], ["own %d" % i]])} for run in ("r", "s") for i in range(50)}
    rows = [(run, i, t) for (run, i), texts in sets.items() for t in texts] + [(None, 1, "line 1"), (None, 2, "line 1"), ("r", None, "line 1"), ("r", 90, None)]
    found = resolution.near_duplicate_artifacts(spark.createDataFrame(rows, "run_id string, artifact_id int, clean string"), 0.6)
    real = {k: {t for t in v if len(t) >= 4} for k, v in sets.items()}
    want = [(run, a, b, len(real[run, a] & real[run, b]) / min(len(real[run, a]), len(real[run, b]))) for run in ("r", "s") for a in range(50) for b in range(a + 1, 50) if real[run, a] and real[run, b]]
    assert sorted(map(tuple, found.collect())) == [w for w in sorted(want) if w[3] >= 0.6]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(in_a") < plan.index("Join") and plan.index("explode(in_b") < plan.index("Join")  # above all joins


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_neighbours_take_one_shuffle(spark):
    lines = spark.createDataFrame([(1, "A", k, f"t{k}", (0.0, k * 30.0, 10.0, k * 30.0 + 20)) for k in range(5)], "run_id long, artifact_id string, seq int, clean string, bounds struct<l:double,t:double,r:double,b:double>")
    found = neighbours.with_neighbours(lines)
    assert _shuffles(found) == 1
    # A reach of 50: one line above and one below; at exactly the reach a line still counts.
    assert {r.seq: r.near for r in found.collect()}[2] == ["t1", "t3"]
    near = neighbours.with_neighbours(lines, radius=3.0)
    assert {r.seq: r.near for r in near.collect()}[2] == ["t1", "t3", "t0", "t4"]


def test_facts_keep_no_ids_on_disk(spark, tmp_path, monkeypatch):
    """Ids are hashes of what is kept: candidates are written without them, and divergences compare a run's facts in one row."""
    monkeypatch.setattr(scratch, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    facts = evidence_queries.order_facts(spark, "/root/testdata/sf0.001").cache()
    assert not {"candidate_id", "region_id"} & set(spark.read.parquet(f"file://{tmp_path}/candidates").columns)
    one = facts.filter("status = 'OBSERVED'").limit(1).cache()
    stated = projection.project(facts).join(one.select("run_id"), "run_id").cache()
    assert projection.divergences(stated, facts).count() == 0
    twice = facts.unionByName(one.withColumn("value", F.lit(None).cast(facts.schema["value"].dataType)))
    assert [(r.field, r.authoritative) for r in projection.divergences(stated, twice).collect()] == [(one.first().field, None)]


def test_a_list_of_any_length_is_resolved_whole(spark):
    """5,001 candidates of one field in one run: all are folded, the copies go, every view and every value counts."""
    n = 5001
    made = spark.range(n).select(
        F.lit("r").alias("run_id"), F.lit("package.mrp").alias("field"), F.col("id").cast("string").alias("candidate_id"), F.concat(F.lit("A"), (F.col("id") % 5000).cast("string")).alias("artifact_id"),
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("region_id"), G.bbox(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("geom"), V.money(F.when(F.col("id") % 1000 == 7, 20.0).otherwise(10.0)).alias("value"),
        F.lit(0.9).alias("attribution_confidence"), F.lit(0.9).alias("recognition_confidence"), F.lit(1.0).alias("region_quality"), F.col("id").alias("seq"),
    )
    groups = resolution.value_groups(made).first().groups
    assert [(g.value.amount, g.views, len(g.supporting)) for g in groups] == [(10.0, 4995, 4994), (20.0, 5, 4)]
    facts = resolution.resolve(made, made, ("package.mrp",))
    assert [(r.status, len(r.conflicts), r.confidence) for r in facts.collect()] == [("CONFLICTING", 2, groups[0].confidence)]
    held = projection.quarantine(made.select("run_id").distinct(), projection.divergences(projection.project(facts), facts), projection.fact_problems(facts))
    assert [(r.released, r.problems) for r in held.collect()] == [(True, None)]


def test_rules_read_a_line_once(spark):
    """Labels are searched for in columns, not again in each use of a rule."""
    lines = spark.createDataFrame([(1, "A", 0, "Packed by Beta, Nashik", "front", ["Best Before"], 0.9), (1, "A", 1, "01/2027", "front", ["MRP", "Best Before"], 0.9)], "run_id long, artifact_id string, seq int, clean string, surface string, near array<string>, confidence double")
    found = attribution.attribute(lines)
    assert sorted((r.seq, r.field, r.normalization_rule) for r in found.collect()) == [
        (0, "declarations.packer", "party/packer@factloom-text-1"), (1, "declarations.best_before", "date/neighbour-label@factloom-text-1"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("best before)") == 2


def test_a_runs_candidates_are_dealt_once_and_without_ids(spark):
    """From candidates to facts, their projection and what diverges there is one shuffle of candidates; ids are made after it, and runs are not read again."""
    facts = evidence_queries.order_facts(spark, "/root/testdata/sf0.001")
    found = projection.divergences(projection.project(facts, True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ObjectHashAggregate") + plan.count("SortAggregate") <= 4  # candidates, and the runs of untestable facts
    below = plan[plan.index("REPARTITION_BY_COL") :]
    assert "sha2" in plan and "sha2" not in below[: below.index("FileScan")] and "Join" not in plan and "lineitem" not in plan
    assert found.count() == 0


def test_a_run_without_candidates_has_facts(spark):
    lines = spark.createDataFrame([("none", "A", 0, "ACME  GOLD", box(0.0, 0.0, 9.0, 9.0), 0.9, "front"), ("one", "A", 0, "MRP Rs. 20", box(0.0, 0.0, 9.0, 9.0), 0.9, "front")], f"run_id string, artifact_id string, seq int, text string, geom {POINT_RING}, confidence double, surface string")
    got = {(r.run_id, r.status): r.n for r in projection.status_counts(extraction.facts_of_lines(extraction.prepared(lines))).collect()}
    assert got == {("none", "UNKNOWN"): 11, ("none", "NOT_TESTABLE"): 2, ("one", "OBSERVED"): 1, ("one", "UNKNOWN"): 10, ("one", "NOT_TESTABLE"): 2}
