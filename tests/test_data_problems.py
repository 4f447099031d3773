"""Units, moments and nested records: cases, and the defined results of odd ones."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spagyric.operators import moments as M
from spagyric.operators import quantities as Q
from spagyric.operators import shredding as D

MP = "rec_id bigint, doc_id bigint, el_idx int, sent_idx int, raw_value string, raw_units string, specifier string, unit string, value string"
SENT = "doc_id bigint, el_idx int, sent_idx int, text string, low string"
NMR = "rec_id bigint, frequency string, frequency_units string, temperature string, temperature_units string, tail string"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_units_from_field_value_and_sentence(spark):
    mp = spark.createDataFrame(
        [
            (1, 1, 0, 0, "14", "°C", "mp", "x", "y"),
            (2, 1, 0, 0, "355–360", "deg F", "mp", None, None),
            (3, 1, 0, 0, "298.1 - 300.1 Kelvin", None, "mp", None, None),
            (4, 1, 0, 1, "176", None, "mp", None, None),  # the sentence has another 176 with another unit
            (5, 1, 0, 2, "150", None, "mp", None, None),  # unit nowhere
            (6, 1, 0, 0, "rt", "°C", "mp", None, None),
            (7, None, None, None, None, None, None, None, None),
            (8, 1, 0, 0, "35 dec", " ", "Tm", None, None),
            (9, 1, 0, 0, "1" * 50_000, "x" * 50_000, "mp", None, None),
            (1, 1, 0, 0, "14", "°C", "mp", "x", "y"),
            (10, 1, 0, 0, "20 Celsus", None, "mp", None, None),
        ],
        MP,
    )
    sent = spark.createDataFrame([(1, 0, 0, "35 dec C was recorded as the Tm of 2.", ""), (1, 0, 1, "The mixture was cooled to 176 °F and afforded 1a, mp 176 ºC, Rf 0.84.", ""), (1, 0, 2, "1a, mp 150, Rf 0.8, dried at 110 °C.", ""), (None, None, None, None, None)], SENT)
    nmr = spark.createDataFrame([(20, "400,130,000", "Hz", "298", "mK", "t"), (21, "4.0×10^8 s-1", None, "25 oC", None, None), (22, "399,95", "kHz", "ambient", None, None), (23, None, None, None, None, None), (24, "0.4", "GHz", "r.t.", "K", None)], NMR)
    q = Q.quantities(mp, sent, nmr).cache()
    found = rows(Q.not_common(q), "rec_id", "field", "unit")
    assert found == {(1, "raw_value", "C"), (2, "raw_value", "F"), (4, "raw_value", "C"), (8, "raw_value", "C"), (10, "raw_value", "C"), (20, "frequency", "HZ"), (20, "temperature", "MK"), (21, "frequency", "HZ"), (21, "temperature", "C"), (22, "frequency", "KHZ"), (24, "frequency", "GHZ")}
    ends = {(r.rec_id, r.field): (r.low and round(r.low, 3), r.high and round(r.high, 3)) for r in q.collect()}
    assert ends[2, "raw_value"] == (452.594, 455.372)
    assert ends[3, "raw_value"] == (298.1, 300.1)
    assert ends[20, "frequency"] == (400.13, 400.13)
    assert ends[21, "frequency"] == (400.0, 400.0)
    assert ends[24, "frequency"] == (400.0, 400.0)


def test_units_of_empty_tables(spark):
    out = Q.quantities(*(spark.createDataFrame([], s) for s in (MP, SENT, NMR)))
    assert Q.not_common(out).count() == 0


@pytest.mark.parametrize("a,b,near", [("degreescelsius", "degreescelsius", True), ("celsuis", "celsius", False), ("celsus", "celsius", True), ("oc", "°c", True), ("dec", "degc", False), ("was", "k", False)])
def test_weighted_distance(a, b, near):
    limit = 0.2 * len(b) if len(b) >= 5 else 0.35
    assert (Q._weighted(a, b) <= limit) is near


META = "doc_id bigint, publisher string, published_date string, online_date string, harvested_at timestamp, zone string, norm string"
NOW = datetime(2024, 1, 2)


def normal(spark, cases, declared=(("London Press", "Europe/London", "dmy"), ("York Press", "America/New_York", "mdy"))):
    df = spark.createDataFrame([(i, p, t, None, NOW, "z", "n") for i, (p, t) in enumerate(cases)], META)
    out = M.normal_moments(df, "doc_id", "publisher", ["published_date", "online_date"], "harvested_at", spark.createDataFrame(list(declared), "source string, tz string, day_order string"))
    return {r.doc_id: (r.norm, r.precision) for r in out.collect()}


def test_moments(spark):
    cases = {
        ("London Press", "12 Apr 2008, 01:35 BST"): "2008-04-12T00:35:00Z",
        ("York Press", "November 2, 2014 1:18 AM EST"): "2014-11-02T06:18:00Z",
        ("York Press", "November 2, 2014 1:18 AM"): "2014-11-02T05:18:00Z",  # occurs twice: the earlier
        ("York Press", "03/09/2008 03:23"): "2008-03-09T07:23:00Z",
        ("London Press", "03/09/2008"): "2008-09-03",
        ("York Press", "March 14, 2009 12:52 AM"): "2009-03-14T04:52:00Z",
        ("London Press", "June 2, 2022 12:29 PM"): "2022-06-02T11:29:00Z",
        ("London Press", "15. Dezember 2012"): "2012-12-15",
        ("London Press", "4 février 2009"): "2009-02-04",
        ("London Press", "21 de noviembre de 2013"): "2013-11-21",
        ("London Press", "05.10.18"): "2018-10-05",
        ("London Press", "October 2008"): "2008-10",
        ("London Press", "08/2016"): "2016-08",
        ("London Press", "2009"): "2009",
        ("London Press", "20130114"): "2013-01-14",
        ("London Press", "1561981793"): "2019-07-01T11:49:53Z",
        ("London Press", "1520758119448"): "2018-03-11T08:48:39Z",
        ("London Press", "123456789"): "1973-11-29T21:33:09Z",
        ("London Press", "20160718T075308Z"): "2016-07-18T07:53:08Z",
        ("London Press", "2019-01-07T03:54:49.529568+0200"): "2019-01-07T01:54:49Z",
        ("London Press", "Thu, 17 Jan 2008 05:28:06 +0530"): "2008-01-16T23:58:06Z",
        (None, "2013-10-31T23:33Z"): "2013-10-31T23:33:00Z",
        ("London Press", "30 February 2008"): None,
        ("London Press", "2014-13-26"): None,
        ("London Press", "0000-00-00"): None,
        ("London Press", "2008-01-01 25:00:00"): None,
        ("London Press", "in press"): None,
        ("London Press", ""): None,
        ("London Press", "x" * 100_000): None,
    }
    got = normal(spark, list(cases))
    assert {k: got[i][0] for i, k in enumerate(cases)} == cases


def test_unknown_zone_is_estimated_from_stated_offsets(spark):
    stated = [("Nowhere", f"2019-0{m}-10T10:00:00{'-05:00' if m < 3 else '-04:00'}") for m in range(1, 8)]
    got = normal(spark, [*stated, ("Nowhere", "2019-07-01 12:00:00"), ("Nowhere", "07/15/2018")])
    assert got[7] == ("2019-07-01T16:00:00Z", "second")
    assert got[8] == ("2018-07-15", "day")


def test_moments_of_no_rows(spark):
    assert normal(spark, []) == {}


RAW = "rec_id bigint, payload string, path string, fields string"


def brute(payload):
    """Paths of child rows by plain recursion."""
    x = D.unwrapped(D.parsed(payload))
    out = set()

    def full(v):
        return any(map(full, v)) if isinstance(v, list) else any(map(full, v.values())) if isinstance(v, dict) else v is not None and v != ""

    def members(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    for i, p in enumerate(members((x or {}).get("peaks"))):
        p = D.unwrapped(p)
        out |= {f"peaks/{i}"} if full(p) else set()
        for j, c in enumerate(members(p.get("coupling") if isinstance(p, dict) else None)):
            c = D.unwrapped(c)
            out |= {f"peaks/{i}/coupling/{j}"} if isinstance(c, dict) and full(c) else set()
    for i, c in enumerate(members((x or {}).get("compound"))):
        c = D.unwrapped(c)
        out |= {f"compound/{i}"} if full(c) else set()
        for f in ("names", "labels", "roles"):
            out |= {f"compound/{i}/{f}/{j}" for j, n in enumerate(members(c.get(f) if isinstance(c, dict) else None)) if full(n)}
    return out


PAYLOADS = [
    json.dumps({"NmrSpectrum": {"peaks": [{"NmrPeak": {"shift": "1.0", "coupling": [{"value": "2"}, None, {"value": "3", "units": "Hz"}]}}, None, {}, {"NmrPeak": {}}, {"shift": "2", "coupling": "7.1"}], "compound": {"Compound": {"names": ["a", None, "b"], "labels": "1"}}}}),
    json.dumps({"peaks": {"value": "404"}, "compound": [{}, {"names": []}, {"roles": ["x"]}, None, {"names": "n"}]}),
    json.dumps({"peaks": {"shift": "1", "coupling": {"value": "3"}}, "apparatus": {"Apparatus": {"name": "A"}}}),
    '{"peaks": [{"shift": "1.0"}, {"sh',
    "[1, 2]", "null", "", None, json.dumps({"compound": None, "peaks": []}),
    json.dumps({"raw_value": "x" * 200_000, "compound": {"labels": ["1"]}}),
]


def test_shredding_against_recursion(spark):
    df = spark.createDataFrame([(i, p, "p", "f") for i, p in enumerate(PAYLOADS)], RAW)
    out = D.shred(df, "rec_id", "payload")
    got = {}
    for r in out.where("name <> ''").collect():
        got.setdefault(r.rec_id, set()).add(r.path)
    assert got == {i: b for i, p in enumerate(PAYLOADS) if (b := brute(p))}
    parents = {(r.rec_id, r.path) for r in out.collect()}
    assert all((r.rec_id, r.parent) in parents or r.parent == "" for r in out.where("name <> ''").collect())
    peaks = D.flat_table(out, "rec_id", "peaks", ["shift", "coupling"])
    assert (0, "peaks/4", "", "2", "7.1") in rows(peaks, "rec_id", "path", "parent", "shift", "coupling")


def test_shredding_levels():
    s = D.Shredder()
    s.add([json.loads(PAYLOADS[0]), {"peaks": None}])
    values, reps, defs = s.columns["peaks/coupling/value"]
    assert values == ["2", None, "3", None, None, None, None, None]
    assert reps == [0, 2, 2, 1, 1, 1, 1, 0]
    assert max(defs) == defs[0] and defs[-1] == 0


def test_shredding_of_no_rows(spark):
    assert D.shred(spark.createDataFrame([], RAW), "rec_id", "payload").count() == 0
    assert D.shred(spark.createDataFrame([(1, None, "", "")], RAW), "rec_id", "payload").where(F.lit(True)).count() == 0


def test_places_of_units_are_read_whole(spark):
    """A spelling of any length, a unit far behind in a sentence, and field and value that say something else."""
    spelled = "degrees" + "-" * 16 + " fahrenheit"
    mp = spark.createDataFrame([(1, 1, 0, 0, "90", spelled, "mp", "", ""), (2, 1, 0, 1, "91", "n/a", "mp", "", ""), (3, 1, 0, 2, "120 (subl.)", None, "mp", "", ""), (4, 1, 0, 3, "50", None, "mp", "", "")], MP)
    sent = spark.createDataFrame([(1, 0, 1, "A mp of 91 °C.", ""), (1, 0, 2, "mp 120 (subl.) °C", ""), (1, 0, 3, "The mp was 50" + " " * 60 + "°C here.", "")], SENT)
    nmr = spark.createDataFrame([], NMR)
    assert rows(Q.not_common(Q.quantities(mp, sent, nmr)), "rec_id", "unit") == {(1, "F"), (2, "C"), (3, "C"), (4, "C")}


def test_members_by_definition_levels():
    """Levels alone tell which members there are; values aren't looked at."""
    s = D.Shredder()
    s.add([json.loads(PAYLOADS[0])])
    for values, _, _ in s.columns.values():
        values[:] = ["?"] * len(values)
    assert s.members("peaks").tolist() == [[0, 0], [0, 4]] and s.members("peaks/coupling").tolist() == [[0, 0, 0], [0, 0, 2]]
    s.columns["peaks/coupling/value"][2][0] -= 1
    assert s.members("peaks/coupling").tolist() == [[0, 0, 2]]


def test_zone_is_estimated_against_a_wrong_declaration(spark):
    stated = [("Odd Press", f"2019-0{m}-1{d}T10:00:00{'-05:00' if m < 3 else '-04:00'}") for m in range(1, 8) for d in range(3)]
    declared = (("Odd Press", "Europe/London", "dmy"), ("York Press", "America/New_York", "mdy"))
    assert normal(spark, [*stated, ("Odd Press", "2019-07-01 12:00:00")], declared)[21] == ("2019-07-01T16:00:00Z", "second")
    assert normal(spark, [*stated[:3], ("Odd Press", "2019-07-01 12:00:00")], declared)[3] == ("2019-07-01T11:00:00Z", "second")
