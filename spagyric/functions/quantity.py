"""Values, ranges and uncertainties out of texts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d+(?:\.\d+)?(?:e-?\d+)?"


def _clean(c: Column) -> Column:
    """One minus, one point, no thousands separators: a lone comma before three digits groups, else it is a
    decimal comma."""
    c = F.translate(c, "–−‐‑―・·", "-----..")
    commas = F.length(c) - F.length(F.translate(c, ",", ""))
    after = F.element_at(F.split(c, ","), -1)
    decimal = (commas == 1) & ~after.contains(".") & (F.length(after) != 3)
    c = F.when(decimal, F.translate(F.translate(c, ".", ""), ",", ".")).otherwise(F.translate(c, ",", ""))
    return F.regexp_replace(c, r"\s*[×x]\s*10\s*\^?\s*\(?(-?\d+)\)?", "e$1")


def values(c: Column) -> Column:
    """ARRAY<DOUBLE> of one value, or of the two ends of a range; a fraction is its quotient, and one by zero is
    no value. Uncertainties are left out."""
    t = F.regexp_replace(F.regexp_replace(_clean(c), r"±.*$", ""), r"\(.*$", "")
    fraction = t.rlike(r"^\s*\d+\s*/\s*\d+\s*$")
    parts = F.split(t, "/")
    quotient = F.try_divide(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    # a hyphen between two numbers parts them, any other belongs to the number behind
    spread = F.regexp_replace(t, rf"(?<![e])(?<=\d)\s*-\s*(?=\d)", " to ")
    found = F.regexp_extract_all(spread, F.lit(rf"(-?\s?{NUMBER})"), F.lit(1))
    numbers = F.transform(found, lambda x: F.regexp_replace(x, r"\s", "").cast("double"))
    return F.when(fraction, F.array_compact(F.array(quotient))).otherwise(F.slice(numbers, 1, 2))


def error(c: Column) -> Column:
    """The uncertainty behind ±, or the bracketed one in units of the last digit; null if there is none."""
    t = _clean(c)
    plus = F.nullif(F.regexp_extract(t, r"±\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    bracket = F.nullif(F.regexp_extract(t, r"\d\s*\((\d+(?:\.\d+)?)\)", 1), F.lit("")).cast("double")
    decimals = F.length(F.regexp_extract(t, r"\d\.(\d+)\s*\(", 1))
    return F.coalesce(plus, bracket * F.pow(F.lit(10.0), -decimals))


def midpoint(c: Column) -> Column:
    v = values(c)
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))
