"""Text normalizers as Column functions.

Parsers take text that ``clean`` or ``clean_unicode`` has put in order and return null where they
decline: an ambiguous or unlabelled value is never guessed. All are total; null in, null out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "factloom-text-1"

# Fixed values of the domain: labels, unit spellings, month names, confusable characters.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
CONFUSABLE, CONFUSED_WITH = "OoDQlI|!SsBZzGb", "000011115582266"
MRP_LABELS = ("maximum retail price", "max retail price", "mrp", "m.r.p", "अधिकतम खुदरा मूल्य")
NET_QUANTITY_LABELS = ("net quantity", "net qty", "net wt", "net weight", "net content", "net contents", "शुद्ध मात्रा")
UNIT_PRICE_LABELS = ("unit sale price", "unit price", "price per")
MANUFACTURE_LABELS = ("date of manufacture", "mfg date", "mfg", "manufactured on", "date of packing", "packed on", "pkd", "date of import")
BEST_BEFORE_LABELS = ("best before", "best before use", "use by", "expiry", "exp date", "exp", "consume before")
ORIGIN_LABELS = ("country of origin", "made in", "product of", "origin", "उत्पत्ति का देश")
CARE_LABELS = ("consumer care", "customer care", "customer service", "for complaints", "consumer complaints", "grievance")
GENERIC_NAME_LABELS = ("generic name", "common name", "name of commodity", "commodity")
ROLES = (
    ("manufacturer", ("manufactured by", "mfd by", "mfg by", "manufacturer")),
    ("packer", ("packed by", "packer", "repacked by")),
    ("importer", ("imported by", "importer")),
    ("marketer", ("marketed by", "marketer")),
)
UNITS = {
    "g": ("g", "gm", "gms", "gram", "grams", "ग्राम"),
    "kg": ("kg", "kgs", "kilogram", "kilograms", "किग्रा"),
    "mg": ("mg", "milligram", "milligrams"),
    "ml": ("ml", "mls", "millilitre", "milliliter", "मिली"),
    "l": ("l", "ltr", "ltrs", "litre", "liter", "litres", "liters"),
    "cm": ("cm", "centimetre", "centimeter"),
    "mm": ("mm", "millimetre", "millimeter"),
    "m": ("m", "metre", "meter"),
    "N": ("n", "no", "nos", "pcs", "pieces", "units", "u"),
}
BASE_UNITS = {
    "mg": ("g", 0.001), "g": ("g", 1.0), "kg": ("g", 1000.0), "ml": ("ml", 1.0), "l": ("ml", 1000.0),
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "N": ("N", 1.0),
}
MONTHS = (
    ("jan", "january"),
    ("feb", "february"),
    ("mar", "march"),
    ("apr", "april"),
    ("may",),
    ("jun", "june"),
    ("jul", "july"),
    ("aug", "august"),
    ("sep", "sept", "september"),
    ("oct", "october"),
    ("nov", "november"),
    ("dec", "december"),
)
LETTER = r"a-zA-Zऀ-ॿ"
MONEY = r"(?i)(?:₹|rs\.?|inr|rupees)\s*([0-9OolIS,. /-]+)"
QUANTITY = rf"(?<![\d.])([0-9][0-9OolIS,.]*)\s*([{LETTER}]{{1,12}})\.?(?![{LETTER}])"
PER = rf"(?i)(?:per|/|\bpr\b)\s*([0-9][0-9.,]*)?\s*([{LETTER}]{{1,12}})\.?(?![{LETTER}])"
DAY_MONTH_NAME = r"(?<!\d)(\d{1,2})\s*[/\-. ]\s*([a-zA-Z]{3,9})\s*[,/\-. ]\s*(\d{2,4})(?!\d)"
THREE_NUMBERS = r"(?<!\d)(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})(?!\d)"
MONTH_NAME = r"(?<![a-zA-Z])([a-zA-Z]{3,9})\s*[,/\-. ]\s*(\d{2,4})(?!\d)"
MONTH_NUMBER = r"(?<!\d)(\d{1,2})\s*[/\-.]\s*(\d{2,4})(?!\d)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+91[\-\s]?)?(?:1800[\-\s]?\d{3}[\-\s]?\d{3,4}|0?\d{10}|\d{3,5}[\-\s]\d{6,8})"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _let(value: Column, body) -> Column:
    """Evaluate a value once per row and pass it on."""
    return F.transform(F.array(value), body)[0]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """A match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clean(text: Column) -> Column:
    """Devanagari digits to ASCII, runs of white space to one space, ends trimmed; no Unicode folding."""
    digits = F.translate(text, DEVANAGARI_DIGITS, "0123456789")
    return F.trim(F.regexp_replace(digits, r"(?U)\s+", " "))


def clean_unicode(text: Column) -> Column:
    """``clean`` after compatibility normalization, which Spark lacks: one Arrow batch UDF."""
    from factloom.functions.udfs import nfkc

    return clean(F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text))


def folded(text: Column) -> Column:
    """Full case folding; only texts that are not ASCII leave the JVM."""
    from factloom.functions.udfs import casefold

    return F.coalesce(casefold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def mentions(text: Column, labels: tuple[str, ...]) -> Column:
    """Whether the cleaned text holds one of the labels, in any case."""
    return holds(F.lower(text), labels)


def holds(lowered: Column, labels: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of the labels."""
    return _any([lowered.contains(label) for label in labels])


def repair_numeric(token: Column) -> Column:
    """Letters that recognition confuses with digits, if a digit is there and nothing else is odd."""
    digit_shaped = token.rlike(r"^[OoDQlI|!SsBZzGb.,/\- ]*[0-9][0-9OoDQlI|!SsBZzGb.,/\- ]*$")
    return F.when(digit_shaped, F.translate(token, CONFUSABLE, CONFUSED_WITH)).otherwise(token)


def parse_decimal(token: Column) -> Column:
    """A number with group commas; null where a comma could be a decimal point."""
    plain = lambda bare: F.regexp_replace(F.translate(bare, ", ", ""), "/-?$", "")
    return _let(
        F.trim(token),
        lambda bare: F.when(
            ~bare.rlike(r"^(?:\d{1,3}(?:,\d{3})*|\d+),\d{2}$"), F.when(plain(bare).rlike(r"^\d+(?:\.\d+)?$"), plain(bare).try_cast("double"))
        ),
    )


def parse_money(text: Column) -> Column:
    """Amount in rupees after the first currency marker; null without marker or number."""
    cut = lambda token: F.trim(F.regexp_replace(repair_numeric(token), r"[^\d.,/-].*$", ""))
    amount = _let(F.trim(_found(text, MONEY, 1)), lambda token: parse_decimal(cut(token)))
    return _let(amount, lambda a: F.when(a > 0, a))


def mentions_taxes(text: Column) -> Column:
    return F.lower(text).rlike(r"incl\w*\.?\s*of\s+all\s+tax")


def mentions_not_for_retail(text: Column) -> Column:
    return text.rlike(r"(?i)not\s+for\s+retail\s+sale")


def unit_of(token: Column) -> Column:
    """Canonical unit of a spelling, or null."""
    spellings = {alias: unit for unit, names in UNITS.items() for alias in names}
    return F.try_element_at(_map(spellings), F.lower(token))


def parse_quantity(text: Column) -> Column:
    """First (value, unit) with a known unit and a positive number."""
    numbers = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(2))
    pairs = F.zip_with(numbers, units, lambda n, u: F.struct(parse_decimal(repair_numeric(n)).alias("value"), unit_of(u).alias("unit")))
    return F.get(F.filter(pairs, lambda p: p["unit"].isNotNull() & (p["value"] > 0)), F.lit(0))


def base_unit(unit: Column) -> Column:
    return F.try_element_at(_map({u: b for u, (b, _) in BASE_UNITS.items()}), unit)


def base_magnitude(value: Column, unit: Column) -> Column:
    return value * F.try_element_at(_map({u: f for u, (_, f) in BASE_UNITS.items()}), unit)


def parse_unit_price(text: Column) -> Column:
    """(amount, per_value, per_unit) of a printed unit price; one unit where no number stands."""
    printed = F.regexp_extract(text, PER, 1)
    per = F.when(printed == "", F.lit(1.0)).otherwise(parse_decimal(printed))
    raw = F.struct(parse_money(text).alias("amount"), per.alias("per_value"), unit_of(F.regexp_extract(text, PER, 2)).alias("per_unit"))
    return _let(raw, lambda p: F.when(p["amount"].isNotNull() & p["per_unit"].isNotNull() & (p["per_value"] > 0), p))


def derive_unit_price(mrp: Column, value: Column, unit: Column) -> Column:
    """Price per base unit; null for counted goods and empty quantities."""
    base, size = base_unit(unit), base_magnitude(value, unit)
    return F.when((base != "N") & (size > 0), F.struct((mrp / size).alias("amount"), F.lit(1.0).alias("per_value"), base.alias("per_unit")))


def normal_year(year: Column) -> Column:
    return F.when(year.between(0, 99), year + 2000).when(year.between(1990, 2100), year)


def month_number(name: Column) -> Column:
    names = {n: i + 1 for i, row in enumerate(MONTHS) for n in row}
    return F.try_element_at(_map(names), F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    return _let(F.format_string("%04d-%02d-%02d", year, month, day), lambda iso: F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso))


def _month(year: Column, month: Column) -> Column:
    return F.when(year.isNotNull() & month.between(1, 12), F.format_string("%04d-%02d", year, month))


def parse_date(text: Column) -> Column:
    """ISO date at the precision printed: YYYY-MM or YYYY-MM-DD; null if it could be read two ways."""
    number = lambda t: F.when(t != "", t.try_cast("int"))  # noqa: E731  an empty text would be an exception, made and caught
    part = lambda pattern, i: _let(F.regexp_extract(text, pattern, i), number)
    name = lambda pattern, i: month_number(F.regexp_extract(text, pattern, i))
    year = lambda pattern, i: _let(part(pattern, i), normal_year)
    # Parts are bound before they are looked at: each pattern is searched once for each of its groups.
    read = lambda body, **parts: _let(F.struct(*[p.alias(k) for k, p in parts.items()]), body)
    numeric = lambda d: F.when((d["a"] > 12) & (d["b"] <= 12), _day(d["year"], d["b"], d["a"])).when((d["b"] > 12) & (d["a"] <= 12), _day(d["year"], d["a"], d["b"]))
    month = lambda d: _month(d["year"], d["month"])
    named = read(month, year=year(MONTH_NAME, 2), month=name(MONTH_NAME, 1))
    return (
        F.when(text.rlike(DAY_MONTH_NAME), _day(year(DAY_MONTH_NAME, 3), name(DAY_MONTH_NAME, 2), part(DAY_MONTH_NAME, 1)))
        .when(text.rlike(THREE_NUMBERS), read(numeric, a=part(THREE_NUMBERS, 1), b=part(THREE_NUMBERS, 2), year=year(THREE_NUMBERS, 3)))
        .otherwise(F.coalesce(named, read(month, year=year(MONTH_NUMBER, 2), month=part(MONTH_NUMBER, 1))))
    )


def date_precision(iso: Column) -> Column:
    return F.when(F.length(iso) == 10, "day").when(F.length(iso) == 7, "month")


def parse_best_before_months(text: Column) -> Column:
    months = F.regexp_extract(F.lower(text), r"(\d{1,3})\s*months?\b", 1).try_cast("int")
    return F.when(months.between(1, 120), months)


def _first_label(text: Column, labels: list[tuple], strip: str, read) -> Column:
    """What ``read(tail, label row)`` makes of the text behind the first label that gives something.

    Labels are (kind, label) rows of one array, so the expression does not grow with their number.
    """
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label")) for kind, label in labels])

    def one(row: Column, lowered: Column) -> Column:
        at = F.position(row["label"], lowered)
        tail = F.regexp_replace(F.substr(text, at + F.length(row["label"])), f"^[{strip}]+", "")
        return F.when(at > 0, _let(tail, lambda t: read(t, row)))

    first = lambda lowered: F.get(F.filter(F.transform(rows, lambda row: one(row, lowered)), lambda v: v.isNotNull()), F.lit(0))
    return _let(F.lower(text), first)


def parse_country(text: Column) -> Column:
    """Country as printed behind the first origin label that has one."""

    def read(tail: Column, row: Column) -> Column:
        part = F.trim(F.regexp_replace(tail, r"(?s)(?:[,;|\n]|\s{2,}).*$", ""))
        cut = F.trim(F.regexp_replace(part, r"(?i)\s+(?:mrp|net|mfg|best|packed|marketed|manufactured|use|exp).*$", ""))
        return _let(F.regexp_replace(cut, r"[ .]+$", ""), lambda name: F.when(F.length(name).between(2, 56) & name.rlike(f"[{LETTER}]"), name))

    return _first_label(text, [("origin", x) for x in ORIGIN_LABELS], r" :–\-—,", read)


def parse_party(text: Column) -> Column:
    """(role, name, address) of the first role label with a name behind it."""

    def read(tail: Column, row: Column) -> Column:
        name = F.trim(F.substring_index(tail, ",", 1))
        address = F.when(tail.contains(","), F.trim(F.regexp_replace(tail, "^[^,]*,", ""))).otherwise("")
        return F.when(F.length(name) >= 2, F.struct(row["kind"].alias("role"), name.alias("name"), address.alias("address")))

    return _first_label(text, [(role, label) for role, labels in ROLES for label in labels], r" :–\-—.,", read)


def parse_generic_name(text: Column) -> Column:
    """The commodity behind an explicit label; the largest print is the brand and is not read."""

    def read(tail: Column, row: Column) -> Column:
        return _let(F.trim(F.regexp_replace(tail, r"(?s)(?:[.,;|\n]|\s{2,}).*$", "")), lambda name: F.when(F.length(name).between(2, 80), name))

    return _first_label(text, [("name", x) for x in GENERIC_NAME_LABELS], r" :–\-—.,", read)


def email(text: Column) -> Column:
    return _found(text, EMAIL)


def phone(text: Column) -> Column:
    return F.trim(_found(text, PHONE))


def parse_consumer_care(text: Column) -> Column:
    """The whole cleaned text if it has a label and a way to reach someone."""
    return F.when(mentions(text, CARE_LABELS) & (text.rlike(EMAIL) | text.rlike(PHONE)), text)


def surface_view(name: Column) -> Column:
    bare = F.lower(F.trim(name))
    known = F.when(bare.isin("front", "back", "side_1", "side_2", "extra", "unknown"), bare)
    return F.coalesce(known, F.when(bare.startswith("extra"), "extra"), F.lit("unknown"))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}$"), F.lit(False))


def normal_sha256(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.rlike("^[0-9a-f]{64}$"), lowered)


def valid_gtin(code: Column) -> Column:
    """Length 8, 12, 13 or 14 and a right check digit: weights 3 and 1 from the right."""
    bare = F.trim(code)
    digits = F.transform(F.reverse(F.split(bare, "")), lambda d: d.try_cast("int"))
    weighed = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i == 0, 0).otherwise(d * F.when(i % 2 == 1, 3).otherwise(1))), F.lit(0), lambda a, b: a + b
    )
    shaped = bare.rlike("^(?:[0-9]{8}|[0-9]{12,14})$")
    return F.coalesce(F.when(shaped, F.pmod(10 - F.pmod(weighed, F.lit(10)), F.lit(10)) == F.get(digits, F.lit(0))), F.lit(False))


def exif_rational(value: Column) -> Column:
    """"a/b" or a plain number; null for junk and zero."""
    parts = F.split(F.trim(value), "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    bottom = F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("double")).when(F.size(parts) == 1, 1.0)
    result = F.try_divide(top, bottom)
    return F.when(result > 0, result)


def exif_orientation(value: Column) -> Column:
    """1 to 8 from a number or a viewer's phrase; 1 where neither is known."""
    phrases = {
        "horizontal (normal)": 1, "mirrored horizontal": 2, "rotated 180": 3, "mirrored vertical": 4,
        "mirrored horizontal then rotated 90 ccw": 5, "rotated 90 cw": 6, "mirrored horizontal then rotated 90 cw": 7, "rotated 90 ccw": 8,
    }
    bare = F.lower(F.trim(value))
    number = bare.try_cast("int")
    return F.coalesce(F.when(number.between(1, 8), number), F.try_element_at(_map(phrases), bare), F.lit(1))


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id: the prefix and a hash of the natural key."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("~", *[p.cast("string") for p in parts]), 256))


def time_or_null(value: Column) -> Column:
    return F.try_to_timestamp(value)


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits)
