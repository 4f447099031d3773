"""Timestamps of mixed formats, precisions and zones, brought to one unambiguous form.

A text is cut into a date part, a time of day and a zone; dates keep the precision they are written with,
moments go to UTC. Where no zone is written, the source's zone applies. The zone of every source is estimated: of the
candidate offset histories that one is chosen which its own rows violate least often. Violations are stated offsets and
abbreviations that a history doesn't have, local times that it skips, and moments behind their ingestion. A declared
zone is evidence too: it gives way only to a history with at least ``DECLARED`` violations less. The order of
day and month is chosen alike.

Defined cases: texts that name no real calendar date or time give null; a local time that occurs twice is
the earlier moment, one that a change of clocks skips is moved on by the change; a source that never
violates any history has UTC, and day before month. Repeated rows stay repeated.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spagyric.session import settled, shared_checkpoints

#: Names of months, folded to lower case without accents, in en, de, fr and es.
MONTHS = """
january januar janvier enero jan ene janv
february februar fevrier febrero feb fev fevr febr
march marz maerz mars marzo mar mrz
april avril abril apr avr abr
may mai mayo
june juni juin junio jun
july juli juillet julio jul juil
august aout agosto aug ago
september septembre septiembre setiembre sep sept
october oktober octobre octubre oct okt
november novembre noviembre nov
december dezember decembre diciembre dec dez dic
"""
_MONTH_OF = {name: i + 1 for i, line in enumerate(MONTHS.strip().split("\n")) for name in line.split()}

#: How many violations a declared zone or order outweighs.
DECLARED = 10

_ZONE = r"Z|z|[+\-−]\d{2}:?\d{2}|[+\-−]\d{2}|[A-Z]{2,5}"
_CLOCK = rf"(?:[T ]|, )(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)? ?([AaPp]\.?[Mm]\.?(?![A-Za-z]))? ?({_ZONE})?$"
#: What a date part looks like once names of months are n<number> and all separators hyphens.
_SHAPE = r"^(?:\d{8}|\d{4}|n?\d{1,2}-\d{4}|\d{4}-n?\d{1,2}(?:-\d{1,2})?|\d{1,2}-n?\d{1,2}-(?:\d{4}|\d{2})|n\d{1,2}-\d{1,2}-\d{4})$"


def abbreviations(zones: list[str]) -> dict[str, int]:
    """'zone abbreviation' -> minutes east of UTC, as the zone used them since 1995."""
    out = {}
    for z in zones:
        for year in range(1995, datetime.now(timezone.utc).year + 1):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 1, tzinfo=ZoneInfo(z))
                if at.tzname().isalpha():
                    out[f"{z} {at.tzname()}"] = int(at.utcoffset().total_seconds() // 60)
    return out


def _literal(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in (d or {"": 0}).items() for x in kv))


def with_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds _timed, _clock (hour, minute, second, half of the day, zone; empty where not written), _date (an
    array of number texts), _slashed and _epoch (seconds)."""
    t = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    df = df.withColumn("_t", F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", r"$1-$2-$3T$4:$5:$6"))
    df = df.withColumn("_timed", F.col("_t").rlike(_CLOCK))
    df = df.withColumns({
        "_clock": F.when(F.col("_timed"), F.split(F.regexp_replace("_t", "^.*?" + _CLOCK, "$1|$2|$3|$4|$5"), r"\|")),
        "_date": F.regexp_replace(F.when(F.col("_timed"), F.regexp_replace("_t", _CLOCK, "")).otherwise(F.col("_t")), r"^\p{L}{2,9}\.?, |(?<=\d)(?:st|nd|rd|th|er)\b|\b(?:de|del|of)\b", ""),
        "_epoch": F.when(F.col("_t").rlike(r"^(\d{9,10}|\d{12,13})$"), F.floor(F.col("_t").cast("bigint") / F.when(F.length("_t") >= 12, 1000).otherwise(1))),
    })
    df = df.withColumn("_name", F.lower(F.translate(F.regexp_extract("_date", r"\p{L}{3,}", 0), "äÄéÉèûÛô", "aAeEeuUo")))
    number = F.concat(F.lit("-n"), F.coalesce(F.element_at(_literal(_MONTH_OF), F.col("_name")).cast("string"), F.lit("x")), F.lit("-"))
    df = df.withColumns({"_slashed": F.col("_date").rlike(r"^\d{1,2}[/-]\d{1,2}[/-]"), "_date": F.call_function("regexp_replace", F.col("_date"), F.lit(r"\p{L}{3,}"), number)})
    df = df.withColumn("_date", F.regexp_replace(F.regexp_replace("_date", r"[-/., ]+", "-"), "^-|-$", ""))
    df = df.withColumn("_date", F.when(F.col("_date").rlike(r"^\d{8}$"), F.regexp_replace("_date", r"^(....)(..)", "$1-$2-")).when(F.col("_date").rlike(_SHAPE), F.col("_date")))
    return df.withColumn("_date", F.split("_date", "-"))


def _with_date(df: DataFrame, order: str) -> DataFrame:
    """Adds _y, _m, _d as INT; a part that isn't written is null, and _y is null where no form fits."""
    p = [F.get(F.col("_date"), F.lit(i)) for i in range(3)]
    n, named_first = F.size("_date"), p[0].startswith("n")
    year_first = F.length(p[0]) == 4
    month_first = named_first | (F.col("_slashed") & (F.col(order) == "mdy"))
    year = F.when(year_first, p[0]).when(n == 2, p[1]).otherwise(p[2])
    month = F.when(n < 2, None).when(year_first, p[1]).when((n == 2) | month_first, p[0]).otherwise(p[1])
    day = F.when(n < 3, None).when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0])
    df = df.withColumns({"_y": F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), "_m": F.translate(month, "n", ""), "_d": day})
    return df.withColumns({c: F.col(c).try_cast("int") for c in ("_y", "_m", "_d")})


def _offset(zone: Column, source_zone: Column, known: dict[str, int]) -> Column:
    """Minutes east of UTC that a written zone states; null where none is written or it isn't known."""
    digits = F.regexp_replace(F.translate(zone, "−:", "-"), "^([+-][0-9]{2})$", "$1" + "00")
    signed = F.when(zone.rlike(r"^[+\-−]"), F.when(digits.startswith("-"), -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")))
    return F.coalesce(F.when(F.upper(zone).isin("Z", "UTC", "GMT"), F.lit(0)), signed, F.element_at(_literal(known), F.concat_ws(" ", source_zone, zone)))


def _local(df: DataFrame) -> DataFrame:
    """Adds _zone as written, and _local, the written time of day at the written date as TIMESTAMP_NTZ, or null."""
    part = lambda i: F.nullif(F.get(F.col("_clock"), F.lit(i)), F.lit(""))
    df = df.withColumns({"_h": part(0).try_cast("int"), "_half": F.upper(F.substring(part(3), 1, 1)), "_zone": part(4)})
    h = F.col("_h")
    hour = F.when(F.col("_half").isNull(), h).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(F.col("_half") == "P", 12).otherwise(0))
    whole_day = F.col("_m").isNotNull() & F.col("_d").isNotNull()
    return df.withColumn("_local", F.when(whole_day, F.try_make_timestamp_ntz(F.col("_y"), F.col("_m"), F.col("_d"), hour, part(1).try_cast("int"), F.coalesce(part(2), F.lit("0")).try_cast("decimal(8,6)"))))


#: Texts that may say something about the zone or the order of their source: a zone at the end, a numeric date, an early
#: hour, in which clocks are changed.
_TELLING = r"[A-Za-z]{2,5}$|[+\-−]\d{2}:?(?:\d{2})?$|^\s*\d{1,2}[/-]\d{1,2}[/-]|(?:^|\D)(?:0?[0-4]|12):\d"


def source_rules(df: DataFrame, source: str, texts: list[str], ingested: str, declared: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """(source, zone, day_order, violations) for every value of ``source`` in ``df``, null among them.

    declared: (source, tz, day_order), a dimension that doesn't grow; tz and day_order may be null. zones: the candidates,
    by default UTC and all declared ones. Only texts that can tell something are cut into parts.
    """
    zones = sorted({*(zones or [r[0] for r in declared.select("tz").distinct().collect() if r[0]]), "UTC"})
    known = abbreviations(zones)
    sources = df.select(F.col(source).alias("source")).distinct()
    rows = df.select(F.col(source).alias("source"), F.col(ingested).cast("timestamp_ntz").alias("_seen"), F.explode(F.array(*texts)).alias("_text"))
    recent = [F.col("_text").contains(F.substring(F.year(F.col("_seen") + F.expr(f"interval {d} day")).cast("string"), 3, 2)) for d in (-1, 1)]
    rows = rows.where(F.col("_text").rlike(_TELLING) | recent[0] | recent[1])
    rows = with_parts(rows, "_text").withColumn("_order", F.lit("dmy"))
    slash = lambda i: (F.col("_slashed") & (F.get(F.col("_date"), F.lit(i - 1)).try_cast("int") > 12)).cast("int")
    rows = settled(_local(_with_date(rows, "_order")))
    judged = rows.select("source", "_seen", "_local", "_zone", slash(2).alias("_2"), slash(1).alias("_1"), F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    judged = judged.withColumn("_utc", F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("_local")))
    stated = _offset(F.col("_zone"), F.col("zone"), known)
    has = F.timestamp_diff("MINUTE", F.col("_utc"), F.col("_local"))
    skipped = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("_utc")) != F.col("_local")
    wrong = (
        F.when(F.col("_zone").isNull(), ((F.col("_utc") > F.col("_seen")) | skipped).cast("int"))
        .when(F.upper("_zone").isin("Z", "UTC", "GMT"), F.lit(0))
        .when(stated.isNull(), F.lit(1))
        .otherwise((stated != has).cast("int"))
    )
    per = judged.groupBy("source", "zone").agg(F.coalesce(F.sum(wrong), F.lit(0)).alias("violations"), F.sum("_2").alias("not_dmy"), F.sum("_1").alias("not_mdy"))
    said = F.broadcast(declared.select(F.col("source").alias("_said"), "tz", "day_order"))  # as large as the dimension
    full = sources.select(F.col("source").alias("_s"), F.explode(F.array(*map(F.lit, zones))).alias("_z"))
    per = full.join(per, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("zone")), "left").join(said, F.col("_s").eqNullSafe(F.col("_said")), "left")
    cost = F.coalesce("violations", F.lit(0)) + F.when(F.col("tz").isNotNull() & (F.col("_z") != F.col("tz")), DECLARED).otherwise(0)
    best = F.struct(cost.alias("cost"), (F.col("_z") != F.col("tz")).alias("other"), F.col("_z") != "UTC", "_z")
    out = per.groupBy("_s").agg(F.min_by("_z", best).alias("zone"), F.min(cost).alias("violations"), F.max("not_dmy").alias("not_dmy"), F.max("not_mdy").alias("not_mdy"), F.max("day_order").alias("said"))
    dmy, mdy = F.coalesce("not_dmy", F.lit(0)) + F.when(F.col("said") == "mdy", DECLARED).otherwise(0), F.coalesce("not_mdy", F.lit(0)) + F.when(F.col("said") == "dmy", DECLARED).otherwise(0)
    return out.select(F.col("_s").alias("source"), "zone", F.when(mdy < dmy, "mdy").otherwise("dmy").alias("day_order"), "violations")


def normal_moments(df: DataFrame, key: str, source: str, texts: list[str], ingested: str, declared: DataFrame) -> DataFrame:
    """(key, field, text, norm, precision) of every non-null text; norm and precision are null where the text
    names no real date. precision: second, day, month or year."""
    shared_checkpoints(df.sparkSession)
    rules = source_rules(df, source, texts, ingested, declared).checkpoint()
    side = rules.select(F.col("source").alias("_source"), "zone", "day_order")
    side = F.broadcast(side) if rules.count() <= 10_000 else side
    zones = sorted({r[0] for r in declared.select("tz").distinct().collect() if r[0]} | {"UTC"})
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in texts)))
    rows = df.select(key, F.col(source).alias("_by"), fields.alias("_f")).select(key, "_by", "_f.field", "_f.text").where("text is not null")
    rows = rows.join(side, F.col("_by").eqNullSafe(F.col("_source")), "left")
    rows = _local(_with_date(with_parts(rows, "text"), "day_order"))
    rows = rows.withColumn("_off", _offset(F.col("_zone"), F.col("zone"), abbreviations(zones)))
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(_epoch as decimal(18,6)))")
    utc = (
        F.when(F.col("_epoch").isNotNull(), epoch)
        .when(F.col("_off").isNotNull(), F.expr("_local - make_dt_interval(0, 0, _off, 0)"))
        .otherwise(F.convert_timezone(F.coalesce("zone", F.lit("UTC")), F.lit("UTC"), F.col("_local")))
    )
    day = F.try_make_timestamp_ntz(F.col("_y"), F.when(F.size("_date") < 2, 1).otherwise(F.col("_m")), F.when(F.size("_date") < 3, 1).otherwise(F.col("_d")), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    rows = rows.withColumns({"_utc": utc, "_day": F.when(~F.col("_timed") & (F.col("_y") > 0), day)})
    grain = F.when(F.col("_d").isNotNull(), "day").when(F.col("_m").isNotNull(), "month").otherwise("year")
    rows = settled(rows)
    rows = rows.withColumn("precision", F.when(F.col("_utc").isNotNull(), "second").when(F.col("_day").isNotNull(), grain))
    moment = F.concat(F.regexp_replace(F.substring(F.col("_utc").cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    date = F.substring(F.col("_day").cast("string"), F.lit(1), F.when(F.col("precision") == "day", 10).when(F.col("precision") == "month", 7).otherwise(4))
    norm = F.when(F.col("precision") == "second", moment).otherwise(date)
    return settled(rows.select(key, "field", "text", norm.alias("norm"), "precision"))


def not_normal(moments: DataFrame, key: str) -> DataFrame:
    """(key, field, norm), once each, of the texts that aren't their normal form already."""
    return moments.where("norm is not null and norm <> text").select(key, "field", "norm").distinct()
