"""Queries of the general data problems: units (2), moments (5), nested records (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.operators.moments import normal_moments, not_normal, source_rules
from spagyric.operators.quantities import not_common, quantities
from spagyric.operators.shredding import child_paths, flat_table, shred
from spagyric.session import table


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return quantities(table(spark, d, "mp_records"), table(spark, d, "sentences"), table(spark, d, "nmr_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_common(_quantities(spark, d))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity with a known unit in kelvin or megahertz."""
    common = F.when(F.col("field") == "frequency", "MHz").otherwise("K")
    return _quantities(spark, d).where("unit is not null").select("rec_id", "field", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), common.alias("common_unit")).distinct()


def _moments(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "publishers").select(F.col("publisher").alias("source"), "tz", "day_order")
    return normal_moments(table(spark, d, "article_meta"), "doc_id", "publisher", ["published_date", "online_date"], "harvested_at", declared)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return not_normal(_moments(spark, d), "doc_id")


def p5_moments(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).distinct()


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zones of the publishers are withheld and estimated from their rows among all zones of the dimension; whether the
    estimate has the declared zone's offset in every month of the years 2008 to 2023. The order of day and month is estimated
    too, but isn't held against the declared one: a source of a few rows may have no date that tells."""
    publishers = table(spark, d, "publishers")
    zones = sorted({r[0] for r in publishers.select("tz").distinct().collect() if r[0]})
    unknown = publishers.select(F.col("publisher").alias("source"), F.lit(None).cast("string").alias("tz"), F.lit(None).cast("string").alias("day_order"))
    rules = source_rules(table(spark, d, "article_meta"), "publisher", ["published_date", "online_date"], "harvested_at", unknown, zones)
    out = publishers.join(rules, F.col("publisher") == F.col("source"))
    months = F.expr("sequence(timestamp_ntz'2008-01-01 12:00:00', timestamp_ntz'2023-12-01 12:00:00', interval 1 month)")
    same = F.forall(months, lambda m: F.convert_timezone(F.col("zone"), F.lit("UTC"), m) == F.convert_timezone(F.col("tz"), F.lit("UTC"), m))
    return out.select("publisher", F.col("tz").alias("declared"), same.alias("agrees"))


def _shredded(spark: SparkSession, d: str) -> DataFrame:
    return shred(table(spark, d, "raw_records"), "rec_id", "payload")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    children = ("peaks", "peaks/coupling", "compound", "compound/names", "compound/labels")
    return child_paths(table(spark, d, "raw_records"), "rec_id", "payload", children).distinct()


def p7_peaks(spark: SparkSession, d: str) -> DataFrame:
    fields = ["shift", "value", "units", "multiplicity", "coupling", "coupling_units", "number", "assignment", "extinction", "extinction_units", "shape"]
    return flat_table(_shredded(spark, d), "rec_id", "peaks", fields).distinct()


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    fields = ["raw_value", "raw_units", "nucleus", "solvent", "frequency", "frequency_units"]
    return flat_table(_shredded(spark, d), "rec_id", "", fields).distinct()


#: Spellings in which units are rendered, none of them literally in the dictionary but the first of each.
_SPELLED = {"K": ["K", " kelvins", "° K"], "C": ["°C", " deg. C", "oC", " degrees Celsuis", " ℃"], "F": ["°F", " deg. F", " Farenheit"], "MK": [" mK", " milli-kelvin"]}


def p2_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Melting points rendered from parts with units in many spellings, in the field, behind the value or in a cited sentence far
    behind other words, and read back in kelvin."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    every = [(u, s) for u, ss in _SPELLED.items() for s in ss]
    spelled = F.element_at(F.array(*(F.lit(s) for _, s in every)), (k % len(every) + 1).cast("int"))
    value, place = (F.col("p_size") + 100).cast("string"), (k / len(every)).cast("bigint") % 3
    none = F.lit(None).cast("string")
    mp = part.select(F.col("p_partkey").alias("rec_id"), k.alias("doc_id"), F.lit(0).alias("el_idx"), F.lit(0).alias("sent_idx"), F.when(place == 1, F.concat(value, spelled)).otherwise(value).alias("raw_value"), F.when(place == 0, spelled).when(place == 2, F.lit("-")).alias("raw_units"), F.lit("mp").alias("specifier"))
    cited = F.concat(F.lit("It was cooled to 7 °C for "), F.repeat(F.lit("some time and "), 20), F.lit("gave a mp of "), value, spelled, F.lit(" after drying at 80 °C."))
    sentences = part.where(place == 2).select(k.alias("doc_id"), F.lit(0).alias("el_idx"), F.lit(0).alias("sent_idx"), cited.alias("text"))
    nmr = spark.createDataFrame([], "rec_id bigint, frequency string, frequency_units string, temperature string, temperature_units string")
    return quantities(mp, sentences, nmr).select("rec_id", "unit", F.round("low", 4).alias("kelvin"))


_UNIT_LIST = [u for u, ss in _SPELLED.items() for _ in ss]


def p5_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Order times rendered in many forms and offsets and read back as moments of UTC."""
    o = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), 7)")
    k = F.col("o_orderkey")
    shifted = lambda minutes: o + F.expr(f"make_dt_interval(0, 0, {minutes}, 0)")
    forms = [
        F.concat(F.date_format(shifted(330), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), F.concat(F.date_format(o, "yyyyMMdd'T'HHmmss"), F.lit("Z")), F.concat(F.date_format(shifted(-240), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0400")),
        F.concat(F.date_format(o, "d MMMM yyyy, HH:mm"), F.lit(" GMT")), F.concat(F.date_format(o, "MMMM d, yyyy h:mm a"), F.lit(" UTC")), F.unix_seconds(o.cast("timestamp")).cast("string"), F.date_format(o, "dd.MM.yyyy"), F.date_format(o, "MMM yyyy"),
    ]
    text = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("doc_id"), F.lit("Own Press").alias("publisher"), text.alias("published_date"), F.lit(None).cast("string").alias("online_date"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("harvested_at"))
    declared = spark.createDataFrame([("Own Press", "UTC", "dmy")], "source string, tz string, day_order string")
    return normal_moments(rows, "doc_id", "publisher", ["published_date", "online_date"], "harvested_at", declared).select("doc_id", "norm", "precision")


_ROOT = """
with j as (select rec_id, payload::json as p from raw_records where payload is not null and json_valid(payload)),
r as (select rec_id, case when len(json_keys(p)) = 1 and regexp_matches(json_keys(p)[1], '^[A-Z]') then json_extract(p, '$."' || json_keys(p)[1] || '"') else p end as r from j where json_type(p) = 'OBJECT')
"""


def _members(name: str, of: str, at: str, keys: str) -> str:
    """CTEs that take the members of an array, or a single one, out of an object, and drop class names around them."""
    value = f"json_extract({of}, '$.{at}')"
    return f"""
{name}_l as (select {keys}, case when json_type({value}) = 'ARRAY' then cast({value} as json[]) when {value} is null or json_type({value}) = 'NULL' then [] else [{value}] end as ms from {of}_o),
{name}_m as (select {keys}, unnest(range(len(ms))) as {name}_i, unnest(ms) as m from {name}_l),
{name}_o as (select {keys}, {name}_i, case when json_type(m) = 'OBJECT' and len(json_keys(m)) = 1 and regexp_matches(json_keys(m)[1], '^[A-Z]') then json_extract(m, '$."' || json_keys(m)[1] || '"') else m end as {name} from {name}_m)"""


def _full(x: str) -> str:
    """Whether a value, keys aside, holds a text that isn't empty, a number or a truth value."""
    return f"""regexp_matches(regexp_replace(cast({x} as varchar), '"[^"]*"\\s*:', '', 'g'), '"[^"]+"|[0-9]|true|false')"""


_CHILDREN = (
    _ROOT
    + ", r_o as (select rec_id, r from r), "
    + ",".join([_members("peak", "r", "peaks", "rec_id"), _members("coupling", "peak", "coupling", "rec_id, peak_i"), _members("compound", "r", "compound", "rec_id"), _members("names", "compound", "names", "rec_id, compound_i"), _members("labels", "compound", "labels", "rec_id, compound_i")])
)
ORACLE = {
    "p7_found": _CHILDREN
    + f"""
select distinct rec_id, 'peaks/' || peak_i as path from peak_o where json_type(peak) = 'OBJECT' and {_full('peak')}
union select rec_id, 'peaks/' || peak_i || '/coupling/' || coupling_i from coupling_o where json_type(coupling) = 'OBJECT' and {_full('coupling')}
union select rec_id, 'compound/' || compound_i from compound_o where json_type(compound) = 'OBJECT' and {_full('compound')}
union select rec_id, 'compound/' || compound_i || '/names/' || names_i from names_o where {_full('names')}
union select rec_id, 'compound/' || compound_i || '/labels/' || labels_i from labels_o where {_full('labels')}
""",
    "p5_zones": "select publisher, tz as declared, true as agrees from publishers",
    "p2_rendered": f"with x as (select p_partkey, p_size + 100 as v, {_UNIT_LIST!r}[p_partkey % {len(_UNIT_LIST)} + 1] as unit from part) select p_partkey as rec_id, unit, round(case unit when 'K' then v when 'C' then v + 273.15 when 'F' then (v + 459.67) * 5 / 9 else v / 1000 end, 4) as kelvin from x",
    "p5_rendered": """
with x as (select o_orderkey as k, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + interval 7 second as t from orders)
select k as doc_id, case when k % 8 in (3, 4) then strftime(t, '%Y-%m-%dT%H:%M:00Z') when k % 8 = 6 then strftime(t, '%Y-%m-%d') when k % 8 = 7 then strftime(t, '%Y-%m') else strftime(t, '%Y-%m-%dT%H:%M:%SZ') end as norm,
case when k % 8 = 6 then 'day' when k % 8 = 7 then 'month' else 'second' end as precision from x
""",
    "p7_records": _ROOT
    + """, f as (select distinct rec_id, nullif(json_extract_string(r, '$.raw_value'), '') as raw_value, nullif(json_extract_string(r, '$.raw_units'), '') as raw_units, nullif(json_extract_string(r, '$.nucleus'), '') as nucleus, nullif(json_extract_string(r, '$.solvent'), '') as solvent, nullif(json_extract_string(r, '$.frequency'), '') as frequency, nullif(json_extract_string(r, '$.frequency_units'), '') as frequency_units from r)
select rec_id, '' as path, cast(null as varchar) as parent, raw_value, raw_units, nucleus, solvent, frequency, frequency_units from f
""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_values, p2_rendered, p5_found, p5_moments, p5_zones, p5_rendered, p7_found, p7_peaks, p7_records)}
