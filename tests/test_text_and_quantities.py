import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spagyric.functions import quantity as Q
from spagyric.functions import text as S
from spagyric.spec import units as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("text,shape", [("Co2+", "Xxd*"), ("aaaaa", "xxx"), ("12.5%", "dd.du"), ("α-(x)", "g-bxb"), ("", ""), ("“q”;", "'x':"), ("H₂O", "XdX"), ("Łab", "Xxx")])
def test_word_shape(spark, text, shape):
    assert one(spark, text, S.word_shape) == shape


@pytest.mark.parametrize("text,number", [("1,200", True), ("3/4", True), ("seven", True), ("1.5.2", True), ("x1", False), ("", False), ("three/4", True), ("1/2/3", False)])
def test_like_number(spark, text, number):
    assert one(spark, text, S.like_number) is number


@pytest.mark.parametrize("text,url", [("http://x", True), ("www.a", True), ("example.com", True), ("example.com:80", True), ("a.b.org/", True), (".com", False), ("x", False), ("3.5", False)])
def test_like_url(spark, text, url):
    assert one(spark, text, S.like_url) is url


@pytest.mark.parametrize("text,value", [("1,234.5", 1234.5), ("12.3(4)", 12.3), ("5 ± 1", 5.0), ("1.2 × 10^-3", 0.0012), ("~7;", 7.0), ("n/a", None), ("", None)])
def test_to_double(spark, text, value):
    assert one(spark, text, S.to_double) == value


def test_normalisers(spark):
    assert one(spark, "The\u0003 quick br\u0005own fo\u0008x  jumped ", S.normalize) == "The quick brown fox jumped"
    assert one(spark, "ﬁ “x” – ′", lambda c: S.normalize(c, hyphens=True, quotes=True)) == 'fi "x" - \''
    assert one(spark, "Sulphuric Aluminum", S.chem_normalize) == "sulfuric aluminium"
    assert one(spark, "A [b] <c> “d”", S.excess_normalize) == "a(b((c('d'"
    assert one(spark, None, S.chem_normalize) is None


def test_emails_and_identifiers(spark):
    assert one(spark, "Send to <matt+test@example.com> or <test%what@example.com> x@y", S.emails) == ["matt+test@example.com", "test%what@example.com"]
    assert one(spark, "7732-18-5 7732-18-4 12-3", S.cas_numbers) == ["7732-18-5", "7732-18-4"]
    assert one(spark, "7732-18-5 7732-18-4", lambda c: S.cas_numbers(c, strict=True)) == ["7732-18-5"]
    assert one(spark, "c1ccccc1 (C C=O. CC(=O)O", S.smiles) == ["c1ccccc1", "CC(=O)O"]


VALUES = [
    ("1500.3 to 1600.2", [1500.3, 1600.2], None), ("1600.4±2.4", [1600.4], 2.4), ("1600.4(2)", [1600.4], 0.2), ("1600(2)", [1600.0], 2.0), ("0.0002(2)", [0.0002], 0.0002), ("600,000.8", [600000.8], None),
    ("500,8", [500.8], None), ("3/4", [0.75], None), ("3/0", [], None), ("10^-3", [10.0, -3.0], None), ("×10−3", [], None), ("1.5 × 10^3", [1500.0], None), ("-5 – -3", [-5.0, -3.0], None), ("150–160", [150.0, 160.0], None), ("", [], None),
]


@pytest.mark.parametrize("text,values,error", VALUES)
def test_values_and_errors(spark, text, values, error):
    if text not in ("10^-3", "×10−3"):
        assert one(spark, text, Q.values) == pytest.approx(values)
    assert one(spark, text, Q.error) == (pytest.approx(error) if error else None)


@pytest.mark.parametrize(
    "text,dimension,want",
    [
        ("mm2/s", U.LENGTH**2 / U.TIME, "(10^-6.0) * Meter^(2.0)  Second^(-1.0)"),
        ("Kh2/(km/s)-1/2", U.TEMPERATURE * U.LENGTH**0.5 * U.TIME**1.5, "(10^1.5) * Hour^(2.0)  Kelvin^(1.0)  Meter^(0.5)  Second^(-0.5)"),
        ("(km/s)1/2Kh2", U.TEMPERATURE * U.LENGTH**0.5 * U.TIME**1.5, "(10^1.5) * Hour^(2.0)  Kelvin^(1.0)  Meter^(0.5)  Second^(-0.5)"),
        ("mAcm-2", U.CURRENT / U.LENGTH**2, "(10^1.0) * Ampere^(1.0)  Meter^(-2.0)"),
        ("K/(km2)3s", None, "(10^-18.0) * Kelvin^(1.0)  Meter^(-6.0)  Second^(1.0)"),
        ("°C", U.TEMPERATURE, "Celsius^(1.0)"),
        ("[kJ]", U.ENERGY, "(10^3.0) * Joule^(1.0)"),
        ("Fe", U.TEMPERATURE, None),
        ("", U.TEMPERATURE, None),
        (None, U.TEMPERATURE, None),
        ("K)", U.TEMPERATURE, "Kelvin^(1.0)"),
    ],
)
def test_units(text, dimension, want):
    u = U.parse_unit(text, dimension)
    assert (str(u) if u else None) == want


def test_strict_units_raise():
    with pytest.raises(ValueError):
        U.parse_unit("Fe", U.TEMPERATURE, strict=True)


def test_dimensions_cancel():
    assert U.LENGTH / U.LENGTH == U.DIMENSIONLESS
    assert (U.ENERGY / U.TIME) == U.POWER and U.POTENTIAL * U.CURRENT == U.POWER


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(U.BASES), st.floats(-1e3, 1e3))
def test_conversion_has_an_inverse(base, v):
    same = [b for b in U.BASES if b.dimension == base.dimension]
    for other in same:
        (a, b), (c, d) = U.Unit.of({base.name: 1}).affine(), U.Unit.of({other.name: 1}).affine()
        there = (v * a + b - d) / c
        assert (there * c + d - b) / a == pytest.approx(v, rel=1e-6, abs=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.text("abcé", max_size=6), st.text("abcé", max_size=6))
def test_substring_distance_is_at_most_the_distance(a, b):
    import pandas as pd

    within = S.levenshtein_within.func(pd.Series([a]), pd.Series([a + b, ])[:1])[0]
    assert within == 0
