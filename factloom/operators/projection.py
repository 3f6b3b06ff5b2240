"""Projection of facts to the contract, validation, quarantine and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators.resolution import CROWDED
from factloom.schemas import CONTRACT_STATUSES, INTERNAL_FIELDS, PROJECTION, SNAPSHOT_VERSION, VALUE_STATUSES


def carries_value(status: Column) -> Column:
    return status.isin(*VALUE_STATUSES)


def for_contract(status: Column) -> Column:
    """The status a consumer sees: the internal one reads as unknown."""
    return F.when(status == "NOT_TESTABLE", "UNKNOWN").otherwise(status)


def _told() -> tuple[Column, Column]:
    """What a run's facts say: fields with what they show, and fields without a value."""
    shown = F.when(carries_value(F.col("status")), V.canonical(F.col("value")))
    return F.collect_list(F.when(shown.isNotNull(), F.struct("field", shown.alias("shown")))).alias("told"), F.collect_list(F.when(shown.isNull(), F.col("field"))).alias("silent")


def project(facts: DataFrame, told: bool = False) -> DataFrame:
    """One row per run with a column per contract field: canonical value text, null without a value.

    With ``told``, what the facts say goes along for ``divergences``, so that facts are not made a second time.
    """
    shown = F.when(carries_value(F.col("status")), V.canonical(F.col("value")))
    columns = [F.max(F.when(F.col("field") == f, shown)).alias(f.replace(".", "__")) for f in PROJECTION]
    return facts.groupBy("run_id").agg(*columns, *(_told() if told else ()))


def divergences(projection: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(run_id, field, projected, authoritative) where a projection says other than its facts, or than those it has ``told`` of."""
    if facts is not None:
        projection = projection.join(facts.groupBy("run_id").agg(*_told()), "run_id", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f.replace(".", "__")).alias("projected")) for f in PROJECTION]))
    stated = projection.select("run_id", "told", "silent", pairs.alias("p"))
    # A field stated twice is compared with each statement, one without any with null.
    of_field = F.transform(F.filter("told", lambda t: t["field"] == F.col("p.field")), lambda t: t["shown"])
    nulls = F.transform(F.filter("silent", lambda f: f == F.col("p.field")), lambda f: F.lit(None).cast("string"))
    stated = stated.withColumn("authoritative", F.explode_outer(F.concat(of_field, nulls)))
    joined = stated.select("run_id", "p.field", "p.projected", "authoritative")
    return joined.filter(~F.col("projected").eqNullSafe(F.col("authoritative")))


def _problems(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, text) for bad, text in checks]), lambda p: p.isNotNull())


def fact_problems(facts: DataFrame) -> DataFrame:
    """(run_id, field, problem): facts that break an invariant."""
    c = F.col
    valued = carries_value(c("status"))
    known = [*PROJECTION, *INTERNAL_FIELDS]
    checks = _problems(
        (valued & c("value").isNull(), "value missing"),
        (~valued & c("value").isNotNull(), "value without a status that carries one"),
        (valued & (c("artifact_id").isNull() | c("region_id").isNull()), "provenance missing"),
        ((c("status") == "DERIVED") & F.coalesce(F.size("source_fact_ids") < 1, F.lit(True)), "derivation missing"),
        ((c("status") == "DECLARED_ABSENCE") & (F.trim(F.coalesce(c("note"), F.lit(""))) == ""), "absence without a stated basis"),
        ((c("status") == "CONFLICTING") & F.coalesce(F.size("conflicts") < 2, F.lit(True)), "fewer than two conflicting readings"),
        (~c("confidence").between(0, 1), "confidence out of range"),
        (~for_contract(c("status")).isin(*CONTRACT_STATUSES), "unknown status"),
        (~c("field").isin(*known), "unknown field"),
        *([(F.coalesce(c("note") == CROWDED, F.lit(False)), "too many candidates")] if "note" in facts.columns else []),
    )
    single = facts.select("run_id", "field", F.explode(checks).alias("problem"))
    twice = facts.groupBy("run_id", "field").count().filter("count > 1").select("run_id", "field", F.lit("field stated twice").alias("problem"))
    return single.unionByName(twice)


def snapshot_problems(snapshots: DataFrame) -> DataFrame:
    """(run_id, field, problem) of snapshot headers: version and ids; the extraction run's where the table has it."""
    checks = _problems(
        (~F.col("schema_version").eqNullSafe(F.lit(SNAPSHOT_VERSION)), "schema version"),
        (F.coalesce(F.trim("package_id"), F.lit("")) == "", "package id missing"),
        *([(F.coalesce(F.trim("extraction_run_id"), F.lit("")) == "", "extraction run missing")] if "extraction_run_id" in snapshots.columns else []),
    )
    return snapshots.select("run_id", F.lit(None).cast("string").alias("field"), F.explode(checks).alias("problem"))


def quarantine(runs: DataFrame, diverged: DataFrame, problems: DataFrame) -> DataFrame:
    """Every run with its release: divergence is looked at first, and the first failing kind is the reason."""
    d = diverged.groupBy("run_id").agg(F.count("*").alias("n_diverged"))
    p = problems.groupBy("run_id").agg(F.count("*").alias("n_problems"), F.array_sort(F.collect_list("problem")).alias("problems"))
    joined = runs.join(d, "run_id", "left").join(p, "run_id", "left")
    reason = F.when(F.col("n_diverged") > 0, "projection_facts_divergence").when(F.col("n_problems") > 0, "contract_validation_failure")
    return joined.withColumn("reason", reason).withColumn("released", reason.isNull())


#: Keys that name a run instead of saying what was found.
RUN_KEYS = ("fact_id", "region_id", "ocr_run_id")
#: Columns of facts that documents show.
ENTRY = ("field", "status", "value", "confidence", "fact_id", "artifact_id", "region_id", "ocr_run_id", "supporting", "source_fact_ids", "conflicts", "breakdown", "note")
#: Optional columns of headers, with their types.
HEADER = {
    "as_of": "date", "country": "string", "state": "string", "sale_channel": "string", "is_imported": "boolean", "is_for_retail": "boolean",
    "is_ecommerce_listing": "boolean", "classification_confidence": "double", "extraction_run_id": "string",
}


def _ordered(**parts: Column) -> Column:
    """A struct with its keys in alphabetical order."""
    return F.struct(*[parts[k].alias(k) for k in sorted(parts)])


def _entry(types: dict[str, str], fact: Column, skip: tuple[str, ...]) -> Column:
    """One fact of a document: what it says, where that was seen, how sure it is and what speaks against it."""
    have = lambda name: fact[name] if name in types else None
    keep = lambda **parts: {k: v for k, v in parts.items() if v is not None and k not in skip}

    def places(of: Column) -> Column:
        return F.transform(of, lambda x: _ordered(**keep(artifact_id=x["artifact_id"], region_id=x["region_id"])))

    seen = keep(artifact_id=have("artifact_id"), region_id=have("region_id"), ocr_run_id=have("ocr_run_id"), supporting=places(fact["supporting"]) if "supporting" in types else None)
    derived = {"rule_id": F.lit("unit_sale_price/mrp-over-net-quantity"), "rule_version": F.lit(T.VERSION), "source_fact_ids": have("source_fact_ids")}
    against = None
    if "struct" in types.get("conflicts", ""):
        against = F.transform(
            fact["conflicts"],
            lambda x: _ordered(value=x["value"], confidence=F.round(x["confidence"], 4), provenance=_ordered(**keep(artifact_id=x["artifact_id"], region_id=x["region_id"]))),
        )
    told = for_contract(fact["status"])
    return _ordered(
        **keep(
            fact_id=have("fact_id"), field=fact["field"], status=told, value=fact["value"], confidence=F.round(fact["confidence"], 4),
            provenance=F.when(fact["artifact_id"].isNotNull(), _ordered(**seen)) if "artifact_id" in types else None,
            derivation=F.when(fact["source_fact_ids"].isNotNull(), _ordered(**derived)) if "source_fact_ids" in types else None,
            conflicts=against, confidence_breakdown=have("breakdown"), note=F.when(fact["note"] != "", fact["note"]) if "note" in types else None,
            internal_status=F.when(told != fact["status"], fact["status"]),
        )
    )


def snapshot_documents(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """(run_id, document, content_hash, semantic_hash) of every run of ``headers`` (run_id, package_id and any of ``HEADER``).

    A document is JSON of header, typed blocks and facts, keys in alphabetical order, facts in the
    order of their fields, nulls left out. The content hash covers all of it but the extraction run;
    the semantic one also leaves out ``RUN_KEYS`` wherever they stand, so it moves only with the result.
    """
    types = {c: t for c, t in facts.dtypes if c in ENTRY}
    listed = facts.groupBy("run_id").agg(F.collect_list(F.struct(*types)).alias("told"))  # each fact goes to its run once; both forms are made there
    entries = F.array_sort(F.transform("told", lambda x: F.struct(x["field"].alias("field"), _entry(types, x, ()).alias("full"), _entry(types, x, RUN_KEYS).alias("meaning"))))
    of_field = lambda f: F.filter("told", lambda x: (x["field"] == f) & carries_value(x["status"]))
    typed = [F.array_max(F.transform(of_field(f), lambda x: x["value"])).alias(f.replace(".", "__")) for f in PROJECTION]
    body = listed.select("run_id", entries.alias("f"), *typed)
    known = headers.select("run_id", "package_id", *[(F.col(c) if c in headers.columns else F.lit(None)).cast(t).alias(c) for c, t in HEADER.items()])
    joined = known.join(body, "run_id")
    blocks: dict[str, dict[str, Column]] = {}
    for field, (block, key) in PROJECTION.items():
        blocks.setdefault(block, {})[key] = F.col(field.replace(".", "__"))
    blocks["commodity"]["classification_confidence"] = F.round("classification_confidence", 4)

    def document(part: str, **more: Column) -> Column:
        return _ordered(
            schema_version=F.lit(SNAPSHOT_VERSION), package_id=F.col("package_id"), as_of=F.col("as_of"), jurisdiction=_ordered(country=F.coalesce("country", F.lit("IN")), state=F.col("state")),
            commercial_context=_ordered(**{c: F.col(c) for c in ("sale_channel", "is_imported", "is_for_retail", "is_ecommerce_listing")}),
            facts=F.transform("f", lambda x: x[part]), **{b: _ordered(**c) for b, c in blocks.items()}, **more,
        )

    return joined.select(
        "run_id", F.to_json(document("full", extraction_run_id=F.col("extraction_run_id"))).alias("document"),
        F.sha2(F.to_json(document("full")), 256).alias("content_hash"), F.sha2(F.to_json(document("meaning")), 256).alias("semantic_hash"),
    )


def hashes(facts: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(run_id, content_hash, semantic_hash) of the runs' documents; without headers a run's id names its package."""
    if headers is None:
        headers = facts.select("run_id").distinct().withColumn("package_id", F.col("run_id").cast("string"))
    return snapshot_documents(facts, headers).select("run_id", "content_hash", "semantic_hash")


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("run_id", "status").agg(F.count("*").alias("n"))
