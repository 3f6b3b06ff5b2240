"""Field attribution: each line proposes at most one candidate per rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V

VERSION = "factloom-attribution-1"
OWN, NEIGHBOUR, FRONT_BONUS, CAP = 0.94, 0.78, 0.03, 0.97

#: Labels that rules look for, by name.
LABELS = {
    "mrp": T.MRP_LABELS, "net_quantity": T.NET_QUANTITY_LABELS, "unit_price": T.UNIT_PRICE_LABELS, "made": T.MANUFACTURE_LABELS, "best": T.BEST_BEFORE_LABELS,
    "origin": T.ORIGIN_LABELS, "party": tuple(label for _, labels in T.ROLES for label in labels), "care": T.CARE_LABELS, "generic_name": T.GENERIC_NAME_LABELS,
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and pass it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def text() -> Column:
    return F.col("clean")


def near() -> Column:
    return F.col("near")


def surface() -> Column:
    return F.col("surface")


def everything() -> Column:
    """A line's own text and its neighbours', nearest first."""
    return F.col("__everything")


def labelled(name: str) -> Column:
    """Whether the line's own text holds one of these ``LABELS``."""
    return F.col(f"__own_{name}")


def labelled_near(name: str) -> Column:
    """Whether a neighbour's text holds one of these ``LABELS``."""
    return F.col(f"__near_{name}")


def confidence(own: Column) -> Column:
    base = F.when(own, OWN).otherwise(NEIGHBOUR) + F.when(surface() == "front", FRONT_BONUS).otherwise(0.0)
    return F.least(base, F.lit(CAP))


def _proposal(field: Column | str, value: Column, own: Column, rule: Column | str, why: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    row = F.struct(
        as_column(field).alias("field"), value.alias("value"), confidence(own).alias("attribution_confidence"),
        F.concat(as_column(rule), F.lit("@" + T.VERSION)).alias("normalization_rule"), as_column(why).alias("rationale"),
    )
    return F.transform(F.array(row), lambda r: F.when(r["value"].isNotNull() & r["field"].isNotNull(), r))[0]


def _numeric(field: str, labels: str, parse: Callable[[Column], Column], build: Callable[[Column], Column], rule: str, name: str, more: Column | None = None) -> Column:
    """A labelled number: the label here or near, the number here or else in all the text around."""
    here = labelled(labels)
    value = _let(F.coalesce(parse(text()), parse(everything())), build)
    why = F.when(here, f"{name} label in region").otherwise(f"{name} label in neighbour")
    why = F.concat(why, more) if more is not None else why
    return F.when(here | labelled_near(labels), _proposal(field, value, here, rule, why))


def mrp() -> Column:
    taxes = F.when(T.mentions_taxes(everything()), "; states inclusive of taxes").otherwise("")
    return _numeric("package.mrp", "mrp", T.parse_money, V.money, "mrp/label+currency", "MRP", taxes)


def net_quantity() -> Column:
    return _numeric("package.net_quantity", "net_quantity", T.parse_quantity, V.quantity, "net_quantity/label+unit", "net quantity")


def unit_sale_price() -> Column:
    return _numeric("package.unit_sale_price", "unit_price", T.parse_unit_price, V.unit_price, "unit_sale_price/printed", "unit price")


def dates() -> Column:
    """A line's own label decides; only a line without one may take the one kind of label near it."""
    made, best = labelled("made"), labelled("best")
    made_near, best_near = labelled_near("made"), labelled_near("best")
    own = made | best
    is_made = F.when(own, F.when(made != best, made)).otherwise(F.when(made_near != best_near, made_near))
    field = F.when(is_made, "declarations.manufacture_date").when(~is_made, "declarations.best_before")
    rule = F.when(own & made, "date/mfg-label").when(own, "date/best-before-label").otherwise("date/neighbour-label")
    told = _proposal(field, V.text(T.parse_date(text())), own, rule, F.when(own, "date label in region").otherwise("date label in neighbouring region"))
    return F.when(is_made.isNotNull(), told)  # lines without a label are not parsed


def country_of_origin() -> Column:
    told = _proposal("declarations.country_of_origin", V.text(T.parse_country(text())), F.lit(True), "origin/label", "country-of-origin label in region")
    return F.when(labelled("origin"), told)


def parties() -> Column:
    """The contract has no marketer: such lines are read and dropped."""

    def told(party: Column) -> Column:
        field = F.when(party["role"] != "marketer", F.concat(F.lit("declarations."), party["role"]))
        return _proposal(field, V.party(party), F.lit(True), F.concat(F.lit("party/"), party["role"]), F.concat(party["role"], F.lit(" label in region")))

    return F.when(labelled("party"), _let(T.parse_party(text()), told))


def consumer_care() -> Column:
    """The label must be the line's own; a neighbour may only complete it, the nearest that can."""
    joined = F.filter(F.transform(near(), lambda n: T.parse_consumer_care(F.trim(F.concat_ws(" ", text(), n)))), lambda v: v.isNotNull())

    def told(own: Column) -> Column:
        value = F.coalesce(own, F.get(joined, F.lit(0)))
        rule = F.when(own.isNotNull(), "consumer_care/label+contact").otherwise("consumer_care/label+adjacent-contact")
        why = F.when(own.isNotNull(), "consumer-care label and contact in region").otherwise("consumer-care label with contact in the next region")
        return _proposal("declarations.consumer_care", V.text(value), own.isNotNull(), rule, why)

    return F.when(labelled("care"), _let(T.parse_consumer_care(text()), told))


def generic_name() -> Column:
    told = _proposal("declarations.generic_name", V.text(T.parse_generic_name(text())), F.lit(True), "generic_name/label", "generic-name label in region")
    return F.when(labelled("generic_name"), told)


#: The extension point: a rule is a function without arguments that returns a proposal column.
ATTRIBUTORS: list[Callable[[], Column]] = [mrp, net_quantity, unit_sale_price, dates, country_of_origin, parties, consumer_care, generic_name]


def attribute(lines: DataFrame, attributors: list[Callable[[], Column]] | None = None, every: bool = False) -> DataFrame:
    """One row per line and proposal; lines need clean, near and surface. Not a decision between them.

    With ``every``, a line that proposes nothing is a row without a field.
    """
    rules = [rule() for rule in attributors or ATTRIBUTORS]
    names = [f"__rule{i}" for i in range(len(rules))]  # columns of their own: evaluated once, in generated code
    # Columns of their own, too: texts are joined, lowered and searched for labels once a line. Labels don't go over the end of a line.
    texts = {"__everything": F.trim(F.concat_ws(" ", text(), F.array_join(near(), " "))), "__lowered": F.lower(text()), "__lowered_near": F.lower(F.array_join(near(), "\n"))}
    told = {f"__{side}_{name}": T.holds(F.col(column), labels) for side, column in (("own", "__lowered"), ("near", "__lowered_near")) for name, labels in LABELS.items()}
    proposed = lines.withColumns(texts).withColumns(told).withColumns(dict(zip(names, rules, strict=True)))
    each = F.explode_outer if every else F.explode
    return proposed.withColumn("p", each(F.array_compact(F.array(*names)))).drop(*names, *texts, *told).select("*", "p.*").drop("p")


def observed_statements(lines: DataFrame) -> DataFrame:
    """(run_id, statement, geometries): wordings worth keeping that are no contract fields."""
    found = F.array(
        F.when(T.mentions_not_for_retail(text()), "not_for_retail_sale"), F.when(T.mentions_taxes(text()), "mrp_inclusive_of_taxes")
    )
    rows = lines.select("run_id", "artifact_id", "seq", "geom", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("statement"))
    listed = rows.groupBy("run_id", "statement").agg(F.array_sort(F.collect_list(F.struct("artifact_id", "seq", "geom"))).alias("g"))
    return listed.select("run_id", "statement", F.transform("g", lambda s: s["geom"]).alias("geometries"))
