"""Resolution: candidates of one run and field to one fact, by ordered folds.

Deduplication and value grouping depend on order, and value equality is no equivalence (a month
equals each of its days), so they are folds over a run and field's candidates in the order of score
and seq. A list of any length is folded whole, in memory that grows with it; ``MOST`` is a policy that
is off: where a deployment sets it, runs with longer lists are held back and no other run is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import geometry as G
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.schemas import INTERNAL_FIELDS, RESOLVED_FIELDS, VALUE
from factloom.sources import scratch

VERSION = "factloom-resolution-1"
POLICY = "factloom-confidence-1"
SAME_REGION = 0.60
DECISIVE_GAP = 0.25
#: Longest list that a deployment wants resolved; None: all are.
MOST: int | None = None
#: Copies in one list when pairs of classes become pairs of artifacts.
MEMBERS = 500
#: Note of a fact that was not resolved because its run has too many candidates; such a run is quarantined.
CROWDED = "Too many candidates to compare."
_BOX = "struct<l:double,t:double,r:double,b:double>"
_MEMBER = (
    f"struct<minus:double,seq:bigint,candidate_id:string,artifact_id:string,region_id:string,space:string,box:{_BOX},value:{VALUE},fold:string,"
    "ocr:double,attribution:double,quality:double>"
)
_GROUP = f"struct<lead:{_MEMBER},members:array<{_MEMBER}>>"


def fact_id() -> Column:
    """A fact's id: its run and field."""
    return T.prefixed_id("F-", F.col("run_id"), F.col("field"))


def agreement(views: Column) -> Column:
    return F.least(F.lit(1.15), F.when(views > 1, 1.0 + 0.05 * (views - 1)).otherwise(1.0))


def combine(ocr: Column, attribution: Column, quality: Column, agreed: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ocr * attribution * F.greatest(quality, F.lit(0.1)) * agreed))


def deduplicate(members: Column) -> Column:
    """Members in order without those that overlap an earlier kept one of the same artifact."""

    def again(kept: Column, m: Column) -> Column:
        return F.exists(
            kept, lambda k: (k["artifact_id"] == m["artifact_id"]) & (k["space"] == m["space"]) & (G.box_iou(k["box"], m["box"]) >= SAME_REGION)
        )

    empty = F.array().cast(f"array<{_MEMBER}>")
    apart = F.size(F.array_distinct(F.transform(members, lambda m: m["artifact_id"]))) == F.size(members)  # nothing to compare
    return F.when(apart, members).otherwise(F.aggregate(members, empty, lambda kept, m: F.when(again(kept, m), kept).otherwise(F.concat(kept, F.array(m)))))


def group_values(field: Column, members: Column) -> Column:
    """Groups (lead, members): a member joins the first group whose lead has an equal value."""
    empty = F.array().cast(f"array<{_GROUP}>")

    def add(groups: Column, m: Column) -> Column:
        matches = F.transform(groups, lambda g, i: F.when(V.equal(field, g["lead"], m), i))
        at = F.array_min(matches)
        joined = F.transform(
            groups,
            lambda g, i: F.when(
                i == at, F.struct(V.richer(field, g["lead"], m).alias("lead"), F.concat(g["members"], F.array(m)).alias("members"))
            ).otherwise(g),
        )
        fresh = F.concat(groups, F.array(F.struct(m.alias("lead"), F.array(m).alias("members"))))
        return F.when(at.isNull(), fresh).otherwise(joined)

    return F.aggregate(members, empty, add)


def _described(groups: Column) -> Column:
    """Each group with its confidence, best member and views, most confident first; ties keep order."""

    def one(g: Column, i: Column) -> Column:
        best = F.get(g["members"], F.lit(0))  # members come by score, so the first is the best
        views = F.size(F.array_distinct(F.transform(g["members"], lambda m: m["artifact_id"])))
        sure = combine(best["ocr"], best["attribution"], best["quality"], agreement(views))
        return F.struct(
            (-sure).alias("minus"), i.alias("place"), sure.alias("confidence"), views.alias("views"), g["lead"]["value"].alias("value"), best.alias("best"),
            F.transform(F.slice(g["members"], 2, F.greatest(F.size(g["members"]) - 1, F.lit(0))), lambda m: F.struct(m["artifact_id"].alias("artifact_id"), m["region_id"].alias("region_id"))).alias("supporting"),
        )

    return F.array_sort(F.transform(groups, one))


def fold() -> Column:
    """What candidates' texts are compared by. Python folds what is not ASCII, and Spark forgets how rows were dealt where Python ran: add it before they are."""
    value = F.col("value").cast(VALUE)
    return T.folded(T.clean(F.coalesce(value["name"], value["text"])))


def crowded(candidates: DataFrame) -> DataFrame:
    """(run_id, field): lists of candidates longer than ``MOST``, where one is set."""
    return candidates.groupBy("run_id", "field").agg(F.count("field").alias("n")).filter(F.col("n") > MOST).select("run_id", "field")


def run_groups(candidates: DataFrame) -> DataFrame:
    """(run_id, told): the groups of each field that has candidates, a row for every run; see ``value_groups``."""
    if MOST is not None:  # a run stays, its crowded fields go
        many = crowded(candidates).withColumn("many", F.lit(True))
        candidates = candidates.join(many, ["run_id", "field"], "left").withColumn("field", F.when(F.col("many").isNull(), F.col("field")))
    box = G.bounds(F.col("geom"))
    value = F.col("value").cast(VALUE)
    member = F.struct(
        (-(F.col("attribution_confidence") * F.col("recognition_confidence"))).alias("minus"), F.col("seq").cast("bigint").alias("seq"),
        "candidate_id", "artifact_id", "region_id", F.col("geom")["space"].alias("space"), box.cast(_BOX).alias("box"), value.alias("value"),
        fold().alias("fold") if "fold" not in candidates.columns else F.col("fold"),
        F.col("recognition_confidence").alias("ocr"), F.col("attribution_confidence").alias("attribution"),
        F.coalesce("region_quality", F.lit(1.0)).alias("quality"),
    )
    told = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", member.alias("member"))))
    listed = candidates.groupBy("run_id").agg(told.alias("told"))  # the one shuffle, and none if candidates are dealt by run
    of_field = lambda f: F.array_sort(F.transform(F.filter("told", lambda t: t["field"] == f), lambda t: t["member"])).cast(f"array<{_MEMBER}>")
    fields = F.array_distinct(F.transform("told", lambda t: t["field"]))
    return listed.select("run_id", F.transform(fields, lambda f: F.struct(f.alias("field"), _let(of_field(f), lambda m: _folded(f, m)).alias("groups"))).alias("told"))


def _let(value: Column, body) -> Column:
    """Evaluate a value once per row and pass it on."""
    return F.transform(F.array(value), body)[0]


def _folded(field: Column, members: Column) -> Column:
    """Described groups of members in order; most lists have one member, so there is nothing to compare."""
    one = F.transform(members, lambda x: F.struct(x.alias("lead"), F.array(x).alias("members"))).cast(f"array<{_GROUP}>")
    groups = F.when(F.size(members) == 1, one).otherwise(_let(deduplicate(members), lambda m: group_values(field, m)))
    return _let(groups, _described)


def value_groups(candidates: DataFrame) -> DataFrame:
    """(run_id, field, groups) of all candidates; see ``resolve`` for their columns. Where ``MOST`` is set, crowded lists are left out."""
    return run_groups(candidates).select("run_id", F.explode("told").alias("t")).select("run_id", "t.field", "t.groups")


def resolve(candidates: DataFrame, runs: DataFrame | None, fields: tuple[str, ...] = RESOLVED_FIELDS) -> DataFrame:
    """One fact for every run and field: OBSERVED, CONFLICTING or UNKNOWN.

    candidates: run_id, field, candidate_id, artifact_id, region_id, geom, value, attribution_confidence,
    recognition_confidence, region_quality, seq. runs: run_id; None if every run has candidates, one without
    any a row whose field is null. Fields without candidates are UNKNOWN,
    never absent. Where ``MOST`` is set, so are those with more candidates, which say so and hold their run back.
    """
    every = run_groups(candidates)
    if runs is not None:
        every = runs.select("run_id").distinct().join(every, "run_id", "left")
    if MOST is None:
        every = every.withColumn("many", F.lit(None).cast("array<string>"))
    else:
        every = every.join(crowded(candidates).groupBy("run_id").agg(F.collect_list("field").alias("many")), "run_id", "left")
    every = every.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    mine = F.get(F.filter("told", lambda t: t["field"] == F.col("field")), F.lit(0))["groups"]
    found = every.select("run_id", "field", mine.alias("groups"), F.array_contains("many", F.col("field")).alias("crowded"))
    top, second, n = F.get("groups", F.lit(0)), F.get("groups", F.lit(1)), F.coalesce(F.size("groups"), F.lit(0))
    gap = top["confidence"] - second["confidence"]
    status = F.when(F.col("groups").isNull(), "UNKNOWN").when(n == 1, "OBSERVED").when(gap < DECISIVE_GAP, "CONFLICTING").otherwise("OBSERVED")
    rejected = F.array_join(F.transform(F.slice("groups", 2, F.greatest(n - 1, F.lit(0))), lambda g: F.format_string("%s @ %.2f", V.canonical(g["value"]), g["confidence"])), "; ")
    note = (
        F.when(F.col("crowded"), CROWDED).when(status == "UNKNOWN", "No candidate was read; that is no evidence that the declaration is absent.")
        .when(status == "CONFLICTING", F.format_string("%d incompatible values within %.2f of confidence.", n, F.lit(DECISIVE_GAP)))
        .when(n > 1, F.format_string("Provisionally resolved over %d rejected reading(s); gap %.2f. Rejected: %s", n - 1, gap, rejected))
        .when(top["views"] > 1, F.format_string("Agreed across %d view(s).", top["views"]))
        .otherwise("Single observation.")
    )
    seen = status == "OBSERVED"
    conflicts = F.transform("groups", lambda g: F.struct(g["value"].alias("value"), g["confidence"].alias("confidence"), g["best"]["artifact_id"].alias("artifact_id"), g["best"]["region_id"].alias("region_id")))
    breakdown = F.struct(
        top["best"]["ocr"].alias("ocr"), top["best"]["attribution"].alias("attribution"), top["best"]["quality"].alias("region_quality"),
        agreement(top["views"]).alias("resolution"), F.lit(POLICY).alias("policy_version"),
    )
    return found.select(
        "run_id", "field", status.alias("status"), F.when(seen, top["value"]).alias("value"),
        F.when(status == "UNKNOWN", 0.0).otherwise(top["confidence"]).alias("confidence"),
        F.when(seen, top["best"]["artifact_id"]).alias("artifact_id"), F.when(seen, top["best"]["region_id"]).alias("region_id"),
        F.when(seen, top["supporting"]).alias("supporting"), F.when(seen, top["views"]).alias("views"), F.when(seen, breakdown).alias("breakdown"),
        F.when(status == "CONFLICTING", conflicts).alias("conflicts"), note.alias("note"),
        fact_id().alias("fact_id"), F.lit(None).cast("array<string>").alias("source_fact_ids"),
    )


def derive_unit_price(facts: DataFrame) -> DataFrame:
    """Replace an UNKNOWN unit price by price over quantity where both of those carry a value."""
    run = W.partitionBy("run_id")
    valued = F.col("status").isin("OBSERVED", "DERIVED")
    pick = lambda f: F.max(F.when((F.col("field") == f) & valued, F.struct("fact_id", "value", "confidence", "artifact_id", "region_id"))).over(run)
    inputs = facts.select("*", pick("package.mrp").alias("m"), pick("package.net_quantity").alias("q"))
    price = T.derive_unit_price(F.col("m")["value"]["amount"], F.col("q")["value"]["qty"], F.col("q")["value"]["unit"])
    joined = inputs.withColumn("derived", V.unit_price(price))
    here = (F.col("field") == "package.unit_sale_price") & (F.col("status") == "UNKNOWN") & F.col("derived").isNotNull()
    swap = {
        "status": F.lit("DERIVED"), "value": F.col("derived"), "confidence": F.least(F.col("m")["confidence"], F.col("q")["confidence"]),
        "artifact_id": F.col("m")["artifact_id"], "region_id": F.col("m")["region_id"], "note": F.lit("Computed from price and net quantity."),
        "source_fact_ids": F.array(F.col("m")["fact_id"], F.col("q")["fact_id"]),
    }
    return joined.select(*[F.when(here, swap[c]).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in facts.columns])


def not_testable(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the two presentation fields, which photographs without scale can't decide."""
    rows = runs.select("run_id").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in INTERNAL_FIELDS])))
    made = {"run_id": F.col("run_id"), "field": F.col("field"), "status": F.lit("NOT_TESTABLE"), "confidence": F.lit(0.0),
            "note": F.lit("No validated scale."), "fact_id": fact_id()}
    types = dict(facts.dtypes)
    return rows.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in facts.columns])


def identity_warnings(candidates: DataFrame) -> DataFrame:
    """(run_id, field, n_values): fields that tell packages apart and have several values over several artifacts."""
    groups = value_groups(candidates.filter(F.col("field").isin("package.net_quantity", "declarations.generic_name")))
    artifacts = F.array_distinct(F.flatten(F.transform("groups", lambda g: F.concat(F.array(g["best"]["artifact_id"]), F.transform(g["supporting"], lambda s: s["artifact_id"])))))
    return groups.filter((F.size("groups") > 1) & (F.size(artifacts) > 1)).select("run_id", "field", F.size("groups").alias("n_values"))


def near_duplicate_artifacts(texts: DataFrame, threshold: float = 0.85, min_chars: int = 4) -> DataFrame:
    """(run_id, a, b, overlap) of artifacts whose sets of texts overlap: shared over the smaller set.

    texts: run_id, artifact_id, clean. Texts are compared case-folded, shorter ones than ``min_chars``
    are ignored. A set of n texts that shares ``threshold`` of them with another shares one of its
    n - ceil(threshold * n) + 1 rarest: only those are looked up, so frequent texts make no pairs.

    Equal sets are one class, texts are 128-bit digests, and those of one class only are counted and go
    no further. Pairs are of classes until the end, where lists of members meet and are spread out by the reader.
    """
    folded = texts.filter("run_id IS NOT NULL AND artifact_id IS NOT NULL").select("run_id", "artifact_id", T.folded(F.col("clean")).alias("text"))
    long = folded.filter(F.char_length("text") >= min_chars).select("run_id", "artifact_id", F.unhex(F.md5("text")).alias("key"))
    sets = long.groupBy("run_id", "artifact_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    sets = scratch.written(sets.withColumn("digest", F.unhex(F.md5(F.array_join(F.transform("keys", F.hex), "")))), "texts-sets")
    classes = sets.groupBy("run_id", "digest").agg(F.min("artifact_id").alias("class_id"), F.first("keys").alias("keys"))
    each = classes.select("run_id", "class_id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    held = each.withColumn("held", F.count("*").over(W.partitionBy("run_id", "key"))).filter("held > 1")
    shared = scratch.written(held, "texts-shared")
    own = W.partitionBy("run_id", "class_id")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "key"))  # what no other class holds is rarest
    rare = shared.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    probe = rare.select("run_id", "key", F.col("class_id").alias("small"), F.col("n").alias("n_small"))
    met = probe.join(shared.select("run_id", "key", F.col("class_id").alias("other"), F.col("n").alias("n_other")), ["run_id", "key"]).filter("small != other AND n_small <= n_other")
    pairs = met.select("run_id", F.least("small", "other").alias("a"), F.greatest("small", "other").alias("b"), F.col("n_small").alias("least")).distinct()
    lists = shared.groupBy("run_id", "class_id").agg(F.collect_list(F.base64("key")).alias("keys"))
    side = lambda x: lists.select("run_id", F.col("class_id").alias(x), F.col("keys").alias(f"of_{x}"))
    both = pairs.join(side("a"), ["run_id", "a"]).join(side("b"), ["run_id", "b"])
    overlap = (F.size(F.array_intersect("of_a", "of_b")) / F.col("least")).alias("overlap")
    linked = both.select("run_id", "a", "b", overlap).filter(F.col("overlap") >= threshold)
    return _spread(linked, sets)


def _spread(linked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of artifacts from pairs of classes (run_id, a, b, overlap) and all pairs within a class; sets: run_id, artifact_id, digest.

    Members travel as lists of about ``MEMBERS``, so what is shuffled is a list a pair of lists and not a row a pair.
    """
    sizes = sets.groupBy("run_id", "digest").agg(F.min("artifact_id").alias("class_id"), F.ceil(F.count("*") / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("artifact_id"), F.col("parts"))
    named = sets.select("run_id", "digest", "artifact_id").join(sizes, ["run_id", "digest"])
    lists = scratch.written(named.groupBy("run_id", "class_id", part.alias("part")).agg(F.collect_list("artifact_id").alias("members"), F.max("parts").alias("parts")), "texts-members")
    copies = lists.filter("parts > 1 OR size(members) > 1").select("run_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("overlap")).distinct()
    side = lambda x: lists.select("run_id", F.col("class_id").alias(x), F.col("members").alias(f"in_{x}"))
    met = linked.unionByName(copies).join(side("a"), ["run_id", "a"]).join(side("b"), ["run_id", "b"])
    ones = met.select("run_id", F.col("a").alias("of"), F.col("b").alias("with"), "overlap", "in_b", F.explode("in_a").alias("x"))
    twos = ones.select("run_id", "of", "with", "overlap", "x", F.explode("in_b").alias("y")).filter("of != with OR x < y")
    return twos.select("run_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def text_classes(texts: DataFrame, min_chars: int = 4) -> DataFrame:
    """(run_id, artifact_id, class_id) of all artifacts: those with the same set of texts are one class, named by its least artifact.

    Copies are members, not pairs. Texts are compared as ``near_duplicate_artifacts`` does; an artifact without any is a class of its own.
    """
    folded = texts.select("run_id", "artifact_id", T.folded(F.col("clean")).alias("text"))
    kept = F.array_sort(F.collect_set(F.when(F.char_length("text") >= min_chars, F.col("text"))))
    sets = folded.groupBy("run_id", "artifact_id").agg(kept.alias("texts"))
    named = sets.select("run_id", "artifact_id", F.when(F.size("texts") > 0, F.sha2(F.to_json("texts"), 256)).alias("digest"))
    least = named.filter("digest IS NOT NULL").groupBy("run_id", "digest").agg(F.min("artifact_id").alias("class_id"))
    return named.join(least, ["run_id", "digest"], "left").select("run_id", "artifact_id", F.coalesce("class_id", "artifact_id").alias("class_id"))


def near_duplicate_classes(texts: DataFrame, threshold: float = 0.85, min_chars: int = 4) -> tuple[DataFrame, DataFrame]:
    """Membership (run_id, artifact_id, class_id) and pairs of classes (run_id, a, b, overlap) that overlap: copies are never paired."""
    members = text_classes(texts, min_chars)
    leaders = members.select("run_id", F.col("class_id").alias("artifact_id")).distinct()
    return members, near_duplicate_artifacts(texts.join(leaders, ["run_id", "artifact_id"], "left_semi"), threshold, min_chars)


def surface_coverage(artifacts: DataFrame) -> DataFrame:
    """Sorted distinct surfaces, whether the front is among them, and how many artifacts a run has."""
    return artifacts.groupBy("run_id").agg(
        F.array_sort(F.collect_set("surface")).alias("surfaces"), F.bool_or(F.col("surface") == "front").alias("has_front"), F.count("*").alias("artifacts")
    )
