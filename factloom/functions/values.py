"""The polymorphic value: builders, field-aware equality, detail and canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.schemas import DATE_FIELDS, PARTY_FIELDS

_PARTS = ("amount", "currency", "qty", "unit", "per_value", "per_unit", "text", "name", "address")
_KINDS = {"amount": "double", "qty": "double", "per_value": "double"}


def build(kind: str, **parts: Column) -> Column:
    """A value with the given parts; null where the first of them is null."""
    first = next(iter(parts))
    columns = [F.lit(kind).alias("kind")] + [parts.get(p, F.lit(None)).cast(_KINDS.get(p, "string")).alias(p) for p in _PARTS]
    return F.transform(F.array(F.struct(*columns)), lambda v: F.when(v[first].isNotNull(), v))[0]


def money(amount: Column) -> Column:
    return build("money", amount=F.round(amount, 2), currency=F.lit("INR"))


def quantity(q: Column) -> Column:
    return build("quantity", qty=q["value"], unit=q["unit"])


def unit_price(p: Column) -> Column:
    return build("unit_price", amount=F.round(p["amount"], 4), currency=F.lit("INR"), per_value=p["per_value"], per_unit=p["per_unit"])


def text(value: Column) -> Column:
    return build("text", text=value)


def party(p: Column) -> Column:
    return build("party", name=p["name"], address=p["address"])


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) < tolerance


def equal(field: Column, a: Column, b: Column) -> Column:
    """Whether two (value, fold) members declare the same: exact, or close in the field's own sense."""
    x, y = a["value"], b["value"]
    quantity_equal = F.when(
        T.base_unit(x["unit"]).isNotNull() & T.base_unit(y["unit"]).isNotNull(),
        (T.base_unit(x["unit"]) == T.base_unit(y["unit"])) & _close(T.base_magnitude(x["qty"], x["unit"]), T.base_magnitude(y["qty"], y["unit"]), 1e-6),
    ).otherwise((x["unit"] == y["unit"]) & (x["qty"] == y["qty"]))
    rate = lambda v: F.try_divide(v["amount"], T.base_magnitude(v["per_value"], v["per_unit"]))
    price_equal = (x["currency"] == y["currency"]) & (T.base_unit(x["per_unit"]) == T.base_unit(y["per_unit"])) & _close(rate(x), rate(y), 1e-4)
    money_equal = (x["currency"] == y["currency"]) & (F.abs(x["amount"] - y["amount"]) < 0.02)
    dates_equal = x["text"].startswith(y["text"]) | y["text"].startswith(x["text"])
    close = (
        F.when(field == "package.mrp", money_equal)
        .when(field == "package.net_quantity", quantity_equal)
        .when(field == "package.unit_sale_price", price_equal)
        .when(field.isin(*DATE_FIELDS), dates_equal)
        .otherwise(a["fold"] == b["fold"])
    )
    return x.eqNullSafe(y) | F.coalesce(close, F.lit(False))


def richer(field: Column, a: Column, b: Column) -> Column:
    """Of two equal members the one with more detail; the first of a tie."""
    by = lambda m: F.when(field.isin(*DATE_FIELDS), F.length(m["value"]["text"])).when(field.isin(*PARTY_FIELDS), F.length(m["value"]["address"])).otherwise(0)
    return F.when(F.coalesce(by(a), F.lit(0)) >= F.coalesce(by(b), F.lit(0)), a).otherwise(b)


def canonical(v: Column) -> Column:
    """Stable text of a value: sorted keys, absent ones left out; null for null."""
    number = lambda c: F.format_string("%.6f", c)
    named = {"address": v["address"], "amount": number(v["amount"]), "currency": v["currency"], "name": v["name"], "per_unit": v["per_unit"],
             "per_value": number(v["per_value"]), "qty": number(v["qty"]), "text": v["text"], "unit": v["unit"]}
    present = {"amount": v["amount"], "per_value": v["per_value"], "qty": v["qty"]}
    items = [F.when(present.get(k, c).isNotNull(), F.concat(F.lit(f"{k}="), c)) for k, c in named.items()]
    return F.when(v.isNotNull(), F.concat_ws("|", *items))
