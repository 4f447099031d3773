"""Patterns, words, tags, abbreviations, extraction, resolving and relations."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spagyric.operators import extract as X
from spagyric.operators import grammar as G
from spagyric.operators import relations as L
from spagyric.operators import resolve as R
from spagyric.operators import tagging as A
from spagyric.operators.tokens import paragraphs, sentence_spans, word_spans
from spagyric.spec import models as M

T = [G.token(w, pos=p) for w, p in zip("the melting point of X is 14 K .".split(), "DT JJ NN IN NN VB CD NN .".split())]


def test_patterns():
    value = (G.Regex(r"^\d").named("value") + G.Word("K").named("units")).named("quantity")
    (nodes, a, b), = value.scan(T)
    assert (a, b) == (6, 8) and nodes[0].first("value") == "14" and nodes[0].first("units") == "K"
    assert [w for w, *_ in [(n[0].words(), s, e) for n, s, e in (G.Tag("NN").named("n")).scan(T)]] == [["point"], ["X"], ["K"]]
    assert (G.Word("melting") + G.Many(G.Tag("NN"), least=1) + G.Tag("NN")).parse(T, 1) is None  # greedy, nothing given back
    assert (G.Word("melting") | G.Word("melting") + G.Word("point")).parse(T, 1)[1] == 2
    assert (G.Word("melting") ^ G.Word("melting") + G.Word("point")).parse(T, 1)[1] == 3
    assert (~G.Word("x") + G.Word("the")).parse(T, 0)[1] == 1
    assert (G.Start() + G.SkipTo(G.Word("X"), include=True)).parse(T, 0)[1] == 5
    assert len(list(G.maybe(G.Word("zzz")).scan(T))) == len(T) + 1
    joined = G.many(G.Regex("^[a-z]+$")).then(G.join).named("words")
    assert joined.parse(T, 0)[0][0].text == "the melting point of"
    assert G.many(G.Anything()).hidden().parse(T, 0) == ([], len(T))
    assert G.Regex(r"^(\d)", group=1).parse(T, 6)[0][0].text == "1"
    assert G.Word("14").where(lambda n: False).parse(T, 6) is None


def test_pattern_columns_equal_patterns(spark):
    p = G.First((G.IWord("THE"), G.Regex(r"^\d"), G.Every((G.Tag("NN"), G.Not(G.Word("K"))))))
    df = spark.createDataFrame([(w, t) for w, t in T], "w string, tags map<string,string>")
    got = [r.x for r in df.select(p.column(F.col("w"), F.col("tags")).alias("x")).collect()]
    assert got == [p.parse(T, i) is not None for i in range(len(T))]


def test_words_of_chemistry():
    words = lambda s: [w for w, _, _ in word_spans(s)]
    assert words("heated at 12°C in CH2Cl2.") == ["heated", "at", "12", "°C", "in", "CH2Cl2", "."]
    assert words("2,4-dinitro(phenyl)amine (3b)") == ["2,4-dinitro(phenyl)amine", "(", "3b", ")"]
    assert words("copper(II) chloride, 5′-oxo") == ["copper(II)", "chloride", ",", "5′-oxo"]


@settings(max_examples=150, deadline=None)
@given(st.text("aB1.,-()°C K′α\n", max_size=40), st.sampled_from(["chem", "plain", "fine"]))
def test_spans_are_exact_and_lose_nothing(text, kind):
    spans = word_spans(text, kind)
    assert all(text[a:b] == w for w, a, b in spans)
    assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    assert "".join(w for w, _, _ in spans) == re.sub(r"\s", "", text)
    sents = sentence_spans(text)
    assert all(text[a:b] == s for s, a, b in sents)
    assert re.sub(r"\s", "", "".join(s for s, _, _ in sents)) == re.sub(r"\s", "", text)


def test_sentences():
    assert [s for s, _, _ in sentence_spans("See Fig. 2 for mp. It is 3.5 K (ca. 4 K). New? Yes!")] == ["See Fig. 2 for mp. It is 3.5 K (ca. 4 K).", "New?", "Yes!"]
    assert len(sentence_spans("One. Two.")) == 2 and sentence_spans("") == []


def test_abbreviations():
    assert A.abbreviations("as histone deacetylase ( HDAC ) inhibitor".split()) == [(["HDAC"], ["histone", "deacetylase"])]
    assert A.abbreviations("( see text ) and ( 12 )".split()) == []


def test_mentions_and_taggers():
    ws = "sodium chloride and 4-bromotoluene were obtained as white solid".split()
    assert [" ".join(ws[a:b]) for a, b in A.spans_of(ws, A.chemical_tags(ws))] == ["sodium chloride", "4-bromotoluene"]
    tag = A.dictionary_tagger([["acetic", "acid"], ["acid"]])
    assert tag("acetic acid acid x".split()) == ["B-CM", "I-CM", "B-CM", "O"]
    data = [("the cat sat".split(), ["DT", "NN", "VB"]), ("a dog ran".split(), ["DT", "NN", "VB"])] * 5
    p = A.Perceptron.loads(A.Perceptron().train(data, rounds=5).dumps())
    assert p("the dog sat".split()) == ["DT", "NN", "VB"]
    assert A.viterbi([[1, 0], [0, 1], [1, 0]], [[0, -5], [-5, 0]])[0] == [0, 0, 0]
    assert A.clauses("A and B boil at 1 and 2 respectively".split()) == [[0, 3, 4, 5], [2, 3, 4, 7]]


def test_trigger_lets_every_match_through(spark):
    texts = ["The melting point of ethanol is 14 K", "mp 12 °C", "nothing here", "m.p. 3 K", "The Tm of toluene was 3–4 °C", "Melting range 80 °C of 4-bromotoluene"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = {r.text for r in df.where(X.trigger([M.MELTING_POINT], F.col("text"))).collect()}
    assert {t for t in texts if list(X.sentence_records(t, [M.MELTING_POINT]))} <= kept


def test_records_of_sentences():
    (_, method, r, _), = X.sentence_records("BiFeO3 with a Curie temperature of approximately 1100 K", [M.CURIE_TEMPERATURE])
    assert (method, r["specifier"], r["raw_units"], r["compound"]) == ("template", "Curie temperature", "K", {"names": ["BiFeO3"]}) and "1100" in r["raw_value"]
    (_, _, r, _), = X.sentence_records("1H NMR (400 MHz, DMSO) δ 8.34 (s, 1H), 8.10 (d, J = 9.3 Hz, 1H), 7.22–7.30 (m, 2H).", [M.NMR_SPECTRUM])
    assert r["nucleus"] == "1H" and r["solvent"] == "DMSO" and r["frequency"] == "400" and len(r["peaks"]) == 3
    assert r["peaks"][1] == {"shift": "8.10", "multiplicity": "d", "coupling": "9.3", "coupling_units": "Hz", "number": "1H"}
    assert list(X.sentence_records("", [M.MELTING_POINT])) == []
    grid = [["Compound", "Tm (K)", "Ref."], ["TiO2", "100", "1"], ["no name", "78.3", "2"], ["MnO", "–", "3"]]
    assert [(i, r.get("compound"), r["raw_value"]) for i, _, r in X.table_rows(grid, [M.MELTING_POINT])] == [(0, {"names": ["TiO2"]}, "100"), (1, None, "78.3")]


def test_ranges_tie_like_composites():
    assert M.within(M.SENTENCE, M.SENTENCE) and not M.within(1 * M.SENTENCE, 1 * M.SENTENCE)
    assert M.beyond(0 * M.SENTENCE, 0 * M.SENTENCE) and not M.beyond(M.SENTENCE, M.SENTENCE)
    assert M.within(2 * M.PARAGRAPH, M.SECTION) and not M.within(M.SECTION + M.SENTENCE, M.SECTION)


def test_models():
    r = {"raw_value": "1", "raw_units": "K", "specifier": "mp", "compound": {"names": ["b", "a"]}}
    assert M.MELTING_POINT.serialize(r) == {"MeltingPoint": {"raw_value": "1", "raw_units": "K", "specifier": "mp", "compound": {"Compound": {"names": ["a", "b"]}}}}
    assert M.MELTING_POINT.deserialize(M.MELTING_POINT.serialize(r))["compound"] == {"names": ["a", "b"]}
    assert [m.name for m in M.MELTING_POINT.flatten()] == ["Apparatus", "Compound", "MeltingPoint"]
    assert M.MELTING_POINT.get(r, "compound.names") == ["b", "a"]
    assert M.MELTING_POINT.is_superset(r, {"raw_value": "1", "compound": {"names": ["a"]}})
    assert not M.MELTING_POINT.required_fulfilled({"raw_value": "1"})


def _rows(*items):
    by = M.BUILT_IN
    return [R.Record(by[m], dict(d), at, "x", {}, 0) for m, d, at in items]


def test_contexts_come_from_the_nearest():
    q = {"raw_value": "1", "raw_units": "K", "specifier": "mp"}
    rows = _rows(("Compound", {"names": ["far"]}, (0, 0, 0)), ("Compound", {"names": ["near"]}, (2, 0, 0)), ("MeltingPoint", q, (2, 1, 0)), ("MeltingPoint", {"raw_value": "2"}, (3, 0, 0)))
    out = R.resolve_document(rows)
    assert [r.data.get("compound") for r in out if r.model.name == "MeltingPoint"] == [{"names": ["near"]}]


def test_compounds_unite_but_not_across_labels():
    rows = _rows(("Compound", {"names": ["a"], "labels": ["1"]}, (0, 0, 0)), ("Compound", {"names": ["a", "b"]}, (1, 0, 0)), ("Compound", {"names": ["b"], "labels": ["2"]}, (2, 0, 0)))
    out = [r.data for r in R.resolve_document(rows)]
    assert {"names": ["a", "b"], "labels": ["1"]} in out and {"names": ["b"], "labels": ["2"]} in out
    again = R.resolve_document(R.resolve_document(_rows(("Compound", {"names": ["a"]}, (0, 0, 0)), ("Compound", {"names": ["a"]}, (1, 0, 0)))))
    assert len(again) == 1


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_resolving_does_not_depend_on_partitions(spark, parts):
    texts = [(d, 0, f"We obtained 4-bromotoluene ({d}a). The melting point was {d + 100} K. It is stable.") for d in range(12)]
    from spagyric.operators.tokens import sentences

    df = spark.createDataFrame(texts, "doc_id bigint, el_idx int, t string").repartition(parts).orderBy(F.rand(parts))
    found = X.records(sentences(df, ["doc_id", "el_idx"], "t"), ["doc_id", "el_idx", "sent_idx"], [M.MELTING_POINT])
    names = X.records(sentences(df, ["doc_id", "el_idx"], "t"), ["doc_id", "el_idx", "sent_idx"], [M.COMPOUND])
    out = R.resolve(found.unionByName(names), [M.MELTING_POINT, M.COMPOUND])
    got = {r.doc_id: json.loads(r.payload)["compound"] for r in out.where("model = 'MeltingPoint'").collect()}
    assert got == {d: {"labels": [f"{d}a"], "names": ["4-bromotoluene"]} for d in range(12)}


def test_paragraphs_keep_nothing_empty(spark):
    df = spark.createDataFrame([(1, "a\r\n \r\nb\n\n\n\nc"), (2, None), (3, "  \n\n "), (4, "")], "doc_id bigint, text string")
    assert [(r.doc_id, r.el_idx, r.text) for r in paragraphs(df, "doc_id", "text").orderBy("doc_id", "el_idx").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_relations():
    assert L.find([1, 2, 3, 4, 5, 6], [5, 6]) == [4] and L.find([1, 1, 1], [1, 1]) == [0, 1]
    words = "The Curie temperature Tc of MnO is 120 K ,".split()
    es = [("Curie temperature", "spec", 1, 3), ("temperature", "spec", 2, 3), ("MnO", "name", 5, 6), ("120", "value", 7, 8)]
    cs = L.candidates(es, ("spec", "name", "value"))
    assert cs[0] == (es[0], es[2], es[3])
    m = L.Snowball(("spec", "name", "value"))
    assert m.predict(words, es) == []
    m.learn(words, cs[0])
    again = L.Snowball.loads(m.dumps())
    assert again.predict(words, es)[0][1] == pytest.approx(1.0) and again.clusters[0].pattern == m.clusters[0].pattern
    assert L.candidates([("x", "a", i, i + 1) for i in range(30)] + [("y", "b", i, i + 1) for i in range(40, 70)], ("a", "b"), most=400) == []
    assert L.associate([(0, 1), (4, 5)], [(1, 2)], [1, -1, 1, 2, 3])[0][1] == 0
