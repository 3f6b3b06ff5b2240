"""The extraction plan: recognised lines to facts, snapshots and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.functions import text as T
from factloom.operators import attribution, ingest, neighbours, projection, resolution
from factloom.sources import scratch


def lines_of_orders(once: DataFrame) -> DataFrame:
    """Recognised lines from (run_id, seq, q, s): six kinds of declaration by line number."""
    k = F.col("seq") % 6
    number, maker = F.col("q").cast("string"), F.col("s").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("MRP Rs. "), number, F.lit(" (incl. of all taxes)"))).when(k == 1, F.concat(F.lit("Net Quantity: "), number, F.lit(" g")))
        .when(k == 2, "Mfg. Date: Jul 2026").when(k == 3, "Country of Origin: India").when(k == 4, F.concat(F.lit("Manufactured by: Maker "), maker, F.lit(", Pune")))
        .otherwise("ACME  GOLD")
    )
    y = F.col("seq") * 60.0
    return once.select(
        "run_id", F.concat(F.lit("A"), (F.col("seq") % 2).cast("string")).alias("artifact_id"), "seq", text.alias("text"),
        G.bbox(F.lit(0.0), y, F.lit(300.0), y + 40).alias("geom"), F.lit(0.96).alias("confidence"), F.when(F.col("seq") % 2 == 0, "front").otherwise("back").alias("surface"),
    )


def _alone(once: DataFrame, *texts: Column) -> DataFrame:
    """An artifact for each (run_id, seq) with these texts as lines, one under the other."""
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("text")) for k, t in enumerate(texts)]))
    y = F.col("p.k") * 45.0 + 300
    return once.select("run_id", "seq", part.alias("p")).filter("p.text is not null").select(
        "run_id", F.concat(F.lit("A"), F.col("seq").cast("string")).alias("artifact_id"), (F.col("seq") * 2 + F.col("p.k")).alias("seq"), F.col("p.text").alias("text"),
        G.bbox(F.lit(0.0), y, F.lit(300.0), y + 40).alias("geom"), F.lit(0.96).alias("confidence"), F.lit("front").alias("surface"),
    )


def split_labels(once: DataFrame) -> DataFrame:
    """A label and what it labels as two lines: a price, a date or a contact by line number."""
    k, number = F.col("seq") % 3, F.col("q").cast("string")
    label = F.when(k == 0, "M.R.P.").when(k == 1, "Best Before").otherwise("Consumer Care:")
    told = F.when(k == 0, F.concat(F.lit("Rs. "), number)).when(k == 1, "01/2027").otherwise(F.concat(F.lit("care"), number, F.lit("@acme.example")))
    return _alone(once, label, told)


def other_lines(once: DataFrame) -> DataFrame:
    """Lines of the kinds that ``lines_of_orders`` lacks, each in an artifact of its own."""
    k, number, maker = F.col("seq") % 8, F.col("q").cast("string"), F.col("s").cast("string")
    return _alone(
        once,
        F.when(k == 0, "Best Before: 01/2027").when(k == 1, F.concat(F.lit("Unit Sale Price: Rs "), number, F.lit(" per g")))
        .when(k == 2, F.concat(F.lit("Consumer Care: care"), number, F.lit("@acme.example"))).when(k == 3, "Generic Name: Refined Sunflower Oil")
        .when(k == 4, F.concat(F.lit("Imported by: Gamma "), maker, F.lit(", Mumbai"))).when(k == 5, F.concat(F.lit("Packed by Beta "), maker, F.lit(", Nashik")))
        .when(k == 6, F.concat(F.lit("Marketed by Delta "), maker)).otherwise(F.concat(F.lit("Special offer Rs. "), number)),
    )


def prepared(lines: DataFrame, near: bool = True, unicode: bool = True) -> DataFrame:
    """Usable lines, cleaned once, with their neighbours' texts; ``unicode`` folds compatible forms."""
    cleaned = T.clean_unicode(F.col("text")) if unicode else T.clean(F.col("text"))
    ready = ingest.usable_lines(lines).withColumn("clean", cleaned).withColumn("bounds", G.bounds(F.col("geom")))
    return neighbours.with_neighbours(ready) if near else ready.withColumn("near", F.array().cast("array<string>"))


def facts_of_lines(lines: DataFrame) -> DataFrame:
    """All facts of every run: resolved, derived, and the two that photographs can't decide."""
    found = attribution.attribute(lines, every=True).withColumn("recognition_confidence", F.col("confidence"))
    kept = found.select("run_id", "field", "artifact_id", "seq", "geom", "value", "attribution_confidence", "recognition_confidence")
    found = scratch.written(kept, "candidates").withColumn("fold", resolution.fold()).repartition("run_id")  # dealt once; ids are hashes of what is dealt
    found = found.withColumn("region_id", T.prefixed_id("REG-", F.col("run_id"), F.col("artifact_id"), F.col("seq")))
    found = found.withColumn("candidate_id", T.prefixed_id("CAND-", F.col("run_id"), F.col("artifact_id"), F.col("seq"), F.col("field"))).withColumn("region_quality", F.lit(1.0))
    facts = resolution.derive_unit_price(resolution.resolve(found, None))
    return facts.unionByName(resolution.not_testable(found, facts))


def snapshots(facts: DataFrame) -> DataFrame:
    """One row per run: whether it is released, why not, and its hashes; facts are made once and read several times."""
    facts = scratch.written(facts.drop("fact_id"), "facts").withColumn("fact_id", resolution.fact_id())
    runs = facts.select("run_id").distinct()
    checked = projection.quarantine(runs, projection.divergences(projection.project(facts, True)), projection.fact_problems(facts))
    return checked.select("run_id", "released", "reason").join(projection.hashes(facts), "run_id")
