"""Quantities recorded in different units, brought to common ones.

Distinct unit spellings of all quantities are looked up together in a character n-gram index of the known spellings,
candidates are verified by a weighted edit distance, and the alias dictionary that results is joined to all rows.

Defined cases: null, empty and digit-free values ("rt") have no quantity; a spelling that fits no unit, or
two units equally well, is unknown, and the next place is asked (units field, value, cited sentence);
repeated rows stay repeated; columns other than the named ones are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spagyric.session import settled, shared_checkpoints

#: Known spellings of each unit, folded (see ``folded``).
TEMPERATURES = {
    "K": ["k", "°k", "degk", "degreek", "degreesk", "kelvin", "kelvins", "degreeskelvin"],
    "C": ["c", "°c", "degc", "degreec", "degreesc", "celsius", "degreecelsius", "degreescelsius", "degcelsius", "°celsius", "centigrade", "degreescentigrade"],
    "F": ["f", "°f", "degf", "degreef", "degreesf", "fahrenheit", "degreefahrenheit", "degreesfahrenheit", "degfahrenheit", "°fahrenheit"],
    "MK": ["mk", "millikelvin", "millikelvins"],
}
FREQUENCIES = {
    "HZ": ["hz", "hertz", "s-1", "/s", "1/s", "cps"],
    "KHZ": ["khz", "kilohertz"],
    "MHZ": ["mhz", "megahertz"],
    "GHZ": ["ghz", "gigahertz"],
}
KINDS = {"temperature": TEMPERATURES, "frequency": FREQUENCIES}
#: Dictionaries up to this many spellings are broadcast, larger ones joined by shuffle.
BROADCAST_SPELLINGS = 50_000

_SIGN = r"[-+–−‐‑—]"
_NUM = _SIGN + r"?\s?\d+(?:[.,]\d+)*(?:\s*[×x]\s*10\s*\^?\s*[-−–]?\d+|[eE][-+]?\d+)?"
_ABOUT = r"(?:[<>~≈≥≤]|ca\.?|circa|about|approx\.?|around|between|from)?"
_DECOMPOSED = r"(?:\(?\s*(?:decomp|dec)(?:osition|osed)?\.?\s*\)?)?"
QUANTITY = rf"^\s*{_ABOUT}\s*({_NUM})\s*(?:\(\d+\))?\s*(?:(?:±|\+/?-)\s*\d+(?:[.,]\d+)*)?(?:\s*(?:to|and|\.\.+|[-–—−‐‑])\s*({_NUM})(?:\(\d+\))?)?\s*{_DECOMPOSED}\s*"


def folded(c: Column) -> Column:
    """A spelling without case, blanks, dots and the differences between degree signs."""
    c = F.translate(c, "ºo˚∘⁻¹−–", "ºo°°-1--")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "℃", "°C"), "℉", "°F"), "º", "°")
    return F.lower(F.regexp_replace(c, r"[\s\p{Z}.​-‍﻿]+", ""))


def with_spellings(df: DataFrame, tail: str, two: str, one: str) -> DataFrame:
    """Replaces a text by what may be the unit at its head: its first two words, and its first."""
    words = F.split(F.regexp_replace(tail, r"^[\s\p{Z}]*" + _DECOMPOSED + r"[\s\p{Z}]*", ""), r"[\s\p{Z}]+", 3)
    clean = lambda c: F.nullif(F.regexp_replace(c, r"[,;:)\]]+$", ""), F.lit(""))
    first, second = F.get(F.col(tail), F.lit(0)), F.get(F.col(tail), F.lit(1))
    return df.withColumn(tail, words).withColumns({two: clean(F.concat_ws("", first, second)), one: clean(first)}).drop(tail)


def tail_of(value: Column) -> Column:
    """What follows the number or range; null where the text begins with no number."""
    return F.when(value.rlike(QUANTITY), F.regexp_replace(value, QUANTITY, ""))


#: Characters of a spelling that cost little when they are left out or added, and what they cost.
_CHEAP = {"°": 0.3, "s": 0.3, "-": 0.1, "^": 0.1, "*": 0.1, "'": 0.1}


def _weighted(a: str, b: str) -> float:
    """Edit distance from spelling a to known spelling b; slips that look alike cost little. Infinite where a has so
    many characters that aren't cheap that no limit can be met, which also bounds the work of long spellings."""
    solid = sum(x not in _CHEAP for x in a)
    if solid - len(b) > limit_of(b):
        return float("inf")
    alike = {("o", "°"), ("0", "°"), ("*", "°")}
    gap = lambda x: _CHEAP.get(x, 1.0)
    row = [0.0]
    for y in b:
        row.append(row[-1] + gap(y))
    for x in a:
        last, row = row, [row[0] + gap(x)]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + gap(x), row[-1] + gap(y), last[j] + (0 if x == y else 0.15 if (x, y) in alike else 1.0)))
    return row[-1]


def limit_of(known: str) -> float:
    """The distance up to which a spelling denotes a known one."""
    return 0.2 * len(known) if len(known) >= 5 else 0.35


@F.pandas_udf(T.DoubleType())
def weighted_distance(spelling: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([_weighted(a, b) for a, b in zip(spelling, known)], dtype=float)


def _grams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))


def known_spellings(spark: SparkSession) -> DataFrame:
    """(kind, unit, known): the vocabulary, which doesn't grow."""
    return spark.createDataFrame([(k, u, s) for k, units in KINDS.items() for u, ss in units.items() for s in ss], "kind string, unit string, known string")


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(kind, spelling, unit) of each distinct (kind, spelling) that denotes a unit of its kind."""
    index = known_spellings(spellings.sparkSession).select("kind", "unit", "known", F.explode(_grams(F.col("known"))).alias("gram"))
    seen = spellings.select("kind", "spelling", folded(F.col("spelling")).alias("fold")).where("fold <> ''")
    fold = seen.select("kind", "fold").distinct()
    pairs = fold.select("kind", "fold", F.explode(_grams(F.col("fold"))).alias("gram")).join(F.broadcast(index), ["kind", "gram"]).groupBy("kind", "fold", "unit", "known").agg(F.count("*").alias("shared"))
    near = pairs.where(F.col("shared") * 4 >= F.least(F.length("fold"), F.length("known"))).withColumn("d", weighted_distance("fold", "known"))
    limit = F.when(F.length("known") >= 5, 0.2 * F.length("known")).otherwise(0.35)
    best = near.where(F.col("d") <= limit).groupBy("kind", "fold", "unit").agg(F.min("d").alias("d")).groupBy("kind", "fold").agg(F.min("d").alias("d"), F.sort_array(F.collect_list(F.struct("d", "unit"))).alias("all"))
    sole = best.where((F.size("all") == 1) | (F.get(F.col("all"), F.lit(1))["d"] > F.col("d"))).select("kind", "fold", F.get(F.col("all"), F.lit(0))["unit"].alias("unit"))
    return seen.join(sole, ["kind", "fold"]).select("kind", "spelling", "unit")


def with_unit(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Adds ``unit``, which the first of the candidate spelling columns denotes that denotes one of its ``kind``; drops
    the candidates. One dictionary serves all kinds."""
    shared_checkpoints(df.sparkSession)
    df = df.checkpoint()  # read twice, and made by a join and regular expressions
    every = df.select("kind", F.explode(F.array(*candidates)).alias("spelling")).where("spelling is not null").distinct()
    alias = alias_dictionary(every).checkpoint()
    small = alias.count() <= BROADCAST_SPELLINGS
    for i, c in enumerate(candidates):
        side = alias.select("kind", F.col("spelling").alias(c), F.col("unit").alias(f"_unit{i}"))
        df = df.join(F.broadcast(side) if small else side, ["kind", c], "left")
    return df.withColumn("unit", F.coalesce(*(F.col(f"_unit{i}") for i in range(len(candidates))))).drop(*candidates, *(f"_unit{i}" for i in range(len(candidates))))


def cited_tail(sentence: Column, value: Column, specifier: Column) -> Column:
    """What follows the value in its sentence, all of it. Of several places the one behind the specifier counts, else
    the sentence's begin, else one behind a verb, else the last."""
    text = F.concat(sentence, F.lit(" ¶"))
    quote = lambda c: F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\\E", ""), F.lit(r"\E"))
    v = F.concat(quote(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(r"(?!\d|[.,]\d)(.+)"))
    link = r"\s+(?:(?:is|was|were|of|at|:|=)\s*)?"
    patterns = [
        F.when(F.length(F.trim(specifier)) > 0, F.concat(F.lit(r"(?s)^.*"), quote(specifier), F.lit(link), v)),
        F.concat(F.lit(r"(?s)^\s*"), v),
        F.concat(F.lit(r"(?s)^.*(?:was|is|of|at)\s+"), v),
        F.concat(F.lit(r"(?s)^.*(?<![\d.,–−-])"), v),
    ]
    return F.coalesce(*(F.nullif(F.call_function("regexp_extract", text, p, F.lit(1)), F.lit("")) for p in patterns))


def to_common(v: Column, unit: Column) -> Column:
    """Kelvin for temperatures, megahertz for frequencies."""
    return (
        F.when(unit == "K", v)
        .when(unit == "C", v + 273.15)
        .when(unit == "F", (v + 459.67) * 5 / 9)
        .when(unit == "MK", v / 1000)
        .when(unit == "MHZ", v)
        .when(unit == "HZ", v / 1e6)
        .when(unit == "KHZ", v / 1e3)
        .when(unit == "GHZ", v * 1e3)
    )


def with_interval(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Adds ``low`` and ``high`` in the common unit, low <= high; a single value is both ends. Qualifiers and
    uncertainties don't count. A comma groups thousands where there are several, or before three digits of
    a value in Hz or kHz; else it is a decimal comma."""
    ends = ["low", "high"]
    for i, c in enumerate(ends):
        df = df.withColumn(c, F.nullif(F.regexp_extract(value, QUANTITY, i + 1), F.lit("")))
    for c in ends:
        df = df.withColumn(c, F.regexp_replace(F.translate(F.regexp_replace(c, r"[\s\p{Z}]+", ""), "–−‐‑—×", "-----x"), r"x10\^?", "e"))
    for c in ends:
        grouped = F.col(c).rlike(r",\d+,") | (F.col(unit).isin("HZ", "KHZ") & F.col(c).rlike(r",\d{3}(?!\d)"))
        df = df.withColumn(c, F.when(grouped, F.translate(c, ",", "")).otherwise(F.translate(c, ",", ".")).try_cast("double"))
    for c in ends:
        df = df.withColumn(c, to_common(F.col(c), F.col(unit)))
    high = F.coalesce("high", "low")
    return settled(df.withColumns({"low": F.least(F.col("low"), high), "high": F.greatest(F.col("low"), high)}))


_PLACES = ["u", "v2", "v1", "s2", "s1"]


def _told(kind: str, *candidates: str) -> Column:
    """Whether one of the spellings is literally a known one; all others may need the next place."""
    known = sorted({s for ss in KINDS[kind].values() for s in ss})
    return F.coalesce(*(F.nullif(folded(F.col(c)).isin(known), F.lit(False)) for c in candidates), F.lit(False))


def melting_spellings(mp: DataFrame, sentences: DataFrame | None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(rec_id, keep, value, kind, the five places) of every record whose value begins with a number: the spelling in
    the units field, the first two words and the first word behind the value, and the same of the cited sentence. The
    sentence is read wherever field and value hold no literally known spelling."""
    key = ["doc_id", "el_idx", "sent_idx"]
    has = F.length(F.trim(F.regexp_replace("raw_units", r"[\s\p{Z}]+", ""))) > 0
    rows = mp.select("rec_id", *key, *(c for c in keep if c not in key), F.col("raw_value").alias("value"), F.when(has, F.col("raw_units")).alias("u"), tail_of(F.col("raw_value")).alias("tail"), "specifier").where("tail is not null")
    rows = settled(with_spellings(rows, "tail", "v2", "v1"))
    none = F.lit(None).cast("string")
    out = ["rec_id", *keep, "value", F.lit("temperature").alias("kind"), "u", "v2", "v1"]
    if sentences is None:
        return rows.select(*out, none.alias("s2"), none.alias("s1"))
    shared_checkpoints(mp.sparkSession)
    rows = rows.withColumn("_told", _told("temperature", "u", "v2", "v1")).checkpoint()  # read with the sentences and without
    told = F.col("_told")
    cited = sentences.select(*key, F.col("text").alias("cited")).dropDuplicates(key)
    lone = rows.where(~told).join(cited, key, "left").withColumn("rest", cited_tail(F.col("cited"), F.col("value"), F.col("specifier")))
    lone = with_spellings(lone, "rest", "s2", "s1").select(*out, "s2", "s1")
    return rows.where(told).select(*out, none.alias("s2"), none.alias("s1")).unionByName(lone)


def melting_points(mp: DataFrame, sentences: DataFrame | None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(rec_id, keep, value, unit) of every record whose value begins with a number."""
    return with_unit(melting_spellings(mp, sentences, keep), _PLACES).select("rec_id", *keep, "value", "unit")


def spectrum_spellings(nmr: DataFrame, fields: list[str]) -> DataFrame:
    """(rec_id, field, value, kind, the five places) of the quantities of spectra, in one pass."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_units").alias("units"), F.lit("frequency" if f == "frequency" else "temperature").alias("kind")) for f in fields))
    rows = nmr.select("rec_id", F.explode(parts).alias("p")).select("rec_id", "p.*")
    has = F.length(F.regexp_replace("units", r"[\s\p{Z}]+", "")) > 0
    rows = rows.select("rec_id", "field", "value", "kind", F.when(has, F.col("units")).alias("u"), tail_of(F.col("value")).alias("tail")).where("tail is not null")
    none = F.lit(None).cast("string")
    return with_spellings(rows, "tail", "v2", "v1").select("rec_id", "field", "value", "kind", "u", "v2", "v1", none.alias("s2"), none.alias("s1"))


def quantities(mp: DataFrame, sentences: DataFrame, nmr: DataFrame) -> DataFrame:
    """(rec_id, field, value, unit, low, high) of all melting points, NMR frequencies and temperatures, the
    ends in kelvin or megahertz; unit and ends are null where the unit is written nowhere."""
    every = melting_spellings(mp, sentences).withColumn("field", F.lit("raw_value")).unionByName(spectrum_spellings(nmr, ["frequency", "temperature"]))
    return with_interval(with_unit(every, _PLACES)).select("rec_id", "field", "value", "unit", "low", "high")


def not_common(q: DataFrame) -> DataFrame:
    """(rec_id, field, unit), once each, of the quantities not stated in the common unit."""
    return q.where(F.col("unit").isNotNull() & ~F.col("unit").isin("K", "MHZ")).select("rec_id", "field", "unit").distinct()
