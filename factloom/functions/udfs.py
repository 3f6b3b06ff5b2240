"""The only Python functions over columns: what Spark's built-ins lack. All work on Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding, which ``lower`` is not: it maps sharp s to ss."""
    return text.map(str.casefold, na_action="ignore")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences: a column of differences as bits of one integer, so memory grows with one side."""
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for y in b:
        same = places.get(y, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = (right_up << 1) | 1, right_down << 1
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal & full
    return distance


@F.pandas_udf(DoubleType())
def word_error_rate(truth: pd.Series, read: pd.Series) -> pd.Series:
    """Edited words over words of the truth; for an empty truth 0 if nothing was read, else 1."""

    def one(t: str | None, r: str | None) -> float:
        want, got = (t or "").split(), (r or "").split()
        return edit_distance(want, got) / len(want) if want else float(bool(got))

    return pd.Series([one(t, r) for t, r in zip(truth, read, strict=True)], dtype="float64")
