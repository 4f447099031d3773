"""Parsers, assignment of values, tables, taggers and settings."""

import json

import pytest
from pyspark.sql import functions as F

from spagyric.operators import extract as X
from spagyric.operators import grammar as G
from spagyric.operators import relations as R
from spagyric.operators import tagging as T
from spagyric.operators.parsers import FieldParser, PatternParser, Question, QuestionParser, Sentence
from spagyric.spec import models as M
from spagyric.spec.config import FAST, Config

YIELD = M.Model("Yield", (M.Field("value", required=True), M.Field("remarks", ("list", "string")), M.Field("compound", M.COMPOUND)))


def found(text, models, **more):
    return [(m, r.get("raw_value", r.get("value")), (r.get("compound") or {}).get("names")) for m, _, r, _ in X.sentence_records(text, models, **more)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("BiFeO3 has TN of 643 K and Tc of 1103 K.", [("NeelTemperature", "643", ["BiFeO3"]), ("CurieTemperature", "1103", ["BiFeO3"])]),
        ("MnO shows Curie and Neel temperatures of 10 K and 20 K.", [("CurieTemperature", "10", ["MnO"]), ("NeelTemperature", "20", ["MnO"])]),
        ("The Curie temperatures of MnO, FeO and CoO are 10, 20 and 30 K, respectively.", [("CurieTemperature", "10", ["MnO"]), ("CurieTemperature", "20", ["FeO"]), ("CurieTemperature", "30", ["CoO"])]),
        ("The Neel temperature rises from 100 K in MnO to 120 K in FeO.", [("NeelTemperature", "100", ["MnO"]), ("NeelTemperature", "120", ["FeO"])]),
        ("At 300 K the Curie temperature of MnO was measured as 120 K.", [("CurieTemperature", "120", ["MnO"])]),
        ("Barium titanate has a Tc of 393 K; lead titanate one of 763 K.", [("CurieTemperature", "393", ["Barium titanate"])]),
        ("A Curie temperature between 10 and 20 K was found for nickel.", [("CurieTemperature", "10 and 20", ["nickel"])]),
        ("The Curie temperature is unknown.", []), ("", []),
    ],
)
def test_values_go_to_their_own_property(text, want):
    assert found(text, [M.CURIE_TEMPERATURE, M.NEEL_TEMPERATURE]) == want


def test_pattern_parser_reads_named_nodes():
    number = G.Regex(r"^\d+$").named("value")
    root = G.Word("in").hidden() + number + G.Word("%").hidden() + G.maybe(G.Word("(").hidden() + G.many((G.IWord("crude") | G.IWord("pure")).named("remarks") + G.some(G.Word(",").hidden())))
    parser = PatternParser(YIELD, root, ("%",))
    assert [r for _, r, _ in parser.parse(Sentence("Obtained in 73 % (crude, pure) and in 5 %."))] == [{"value": "73", "remarks": ["crude", "pure"]}, {"value": "5"}]
    own = PatternParser(YIELD, number, interpret=lambda model, nodes: iter([{"value": nodes[0].text * 2}]), most=1)
    assert [r for _, r, _ in own.parse(Sentence("1 2 3"))] == [{"value": "11"}]


def test_own_parsers_taggers_and_tokenizers(spark):
    df = spark.createDataFrame([(1, "Foo gave 7 %."), (2, "Nothing."), (3, None)], "id int, text string")
    root = G.Tag("B-CM").named("compound_name").hidden() + G.SkipTo(G.Regex(r"^\d+$")).hidden() + G.Regex(r"^\d+$").named("value")
    out = X.records(df, ["id"], [M.COMPOUND], parsers=[PatternParser(YIELD, root)], tagger=lambda ws: ["B-CM" if w == "Foo" else "O" for w in ws], tokenizer=lambda t: [(w, t.index(w), t.index(w) + len(w)) for w in t.split()])
    assert {(r.id, r.model, r.payload) for r in out.collect()} == {(1, "Compound", '{"names": ["Foo"]}'), (1, "Yield", '{"value": "7"}')}


def test_field_parser_of_nested_models():
    setting = M.Model("Setting", (M.Field("solvent", pattern=r"in (?P<v>[a-z]+)"),))
    model = M.Model("Assay", (M.Field("code", pattern=r"A\d+", required=True), M.Field("tags", ("list", "string"), pattern=r"#\w+"), M.Field("setting", setting), M.Field("compound", M.COMPOUND)))
    s = Sentence("A1 of ethanol #x #y in water and A2 of toluene #z in brine.")
    s.compounds = X.compounds(s)
    assert [(r["code"], r["tags"], r["setting"]["solvent"]) for _, r, _ in FieldParser(model).parse(s)] == [("A1", ["#x", "#y"], "water"), ("A2", ["#z"], "brine")]
    assert list(FieldParser(YIELD).parse(s)) == []


def test_questions_are_asked_in_turn():
    asked = []

    def answer(question, text):
        asked.append(question)
        return {"Which compound?": [("MnO", 0.9), ("FeO", 0.5), ("x", 0.01)], "What of MnO?": [("10", 0.8)]}.get(question, [])

    parser = QuestionParser(YIELD, (Question("compound", "Which compound?"), Question("value", "What of {compound}?")), answer)
    assert [(r, c) for _, r, c in parser.parse(Sentence("text"))] == [({"compound": {"names": ["MnO"]}, "value": "10"}, 0.72), ({"compound": {"names": ["FeO"]}}, 0.5)]
    assert asked == ["Which compound?", "What of MnO?", "What of FeO?"]


@pytest.mark.parametrize(
    "grid,caption,want",
    [
        ([["Compound", "Region", "mp (°C)"], ["MnO", "x", "12"], ["FeO", "y", "–"]], None, [("12", "°C", ["MnO"])]),
        ([["", "MnO", "FeO"], ["mp / K", "300", "310 °C"]], None, [("300", "K", ["MnO"]), ("310", "°C", ["FeO"])]),
        ([["Sample", "Value (K)"], ["MnO", "300"]], "Melting points of oxides", [("300", "K", ["MnO"])]),
        ([["Data", "Data", "Data"], ["No", "mp", "Compound"], ["", "(K)", ""], ["1", "5.5", "nickel"]], None, [("5.5", "K", ["nickel"])]),
        ([["Compound", "mp"], ["MnO", "300"]], None, []), ([], None, []), ([["mp"]], None, []),
    ],
)
def test_tables(grid, caption, want):
    assert [(r["raw_value"], r["raw_units"], (r.get("compound") or {}).get("names")) for _, _, r in X.table_rows(grid, [M.MELTING_POINT], caption)] == want


def test_chain_learns_what_follows_what():
    data = [("the red salt melts".split(), ["O", "B-CM", "I-CM", "O"]), ("a blue acid boils".split(), ["O", "B-CM", "I-CM", "O"]), ("it melts".split(), ["O", "O"])] * 5
    chain = T.Chain().train(data, rounds=8)
    assert chain("the blue salt boils".split()) == ["O", "B-CM", "I-CM", "O"]
    again = T.Chain.loads(chain.dumps())
    assert again("a red acid melts".split()) == ["O", "B-CM", "I-CM", "O"] and again([]) == []
    assert not any(b.startswith("I-") and a == "O" for ws in ("salt acid", "melts salt") for t in [again(ws.split())] for a, b in zip(["O", *t], t))


def test_association_as_operator(spark):
    span = "array<struct<start: int, end: int>>"
    df = spark.createDataFrame([(1, [(0, 1), (4, 5)], [(2, 3), (6, 7)], [1, -1, 1, 1, 5, 3, 5]), (2, None, [(0, 1)], [-1]), (3, [(0, 1)], [], [])], f"id int, p {span}, c {span}, h array<int>")
    assert {(r.id, r.child_idx, r.parent_idx) for r in R.associated(df, ["id"], "p", "c", "h").collect()} == {(1, 0, 0), (1, 1, 1)}


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"tokenizer": "fine", "readers": ["html"]}))
    c = Config.load(str(tmp_path / "c.json"))
    assert c.readers == ("html",) and c.arguments()["readers"][0].name == "html" and c.key() != FAST.key()
    assert [w for w, _, _ in c.arguments()["tokenizer"]("a-b")] == ["a", "-", "b"]
    with pytest.raises(ValueError):
        Config.of({"nonsense": 1})
    spark.conf.set("spagyric.pool", "mean")
    assert Config.of_session(spark).pool == "mean"
    spark.conf.unset("spagyric.pool")


def test_rank_and_pools(spark):
    from spagyric.api import ranked
    from spagyric.operators.resolve import merged_confidence, pooled_confidence

    df = spark.createDataFrame([(1, 0, {"a": 0.5, "b": 1.0}), (1, 1, {"a": 0.9, "b": 0.8}), (1, 2, None)], "doc_id int, el_idx int, confidence map<string,double>")
    assert [(r.el_idx, r["rank"]) for r in ranked(df, ["doc_id"], 2).orderBy("rank").collect()] == [(1, 1), (0, 2)]
    pool = lambda p: [x and round(x, 3) for (x,) in df.select(pooled_confidence(F.col("confidence"), p)).collect()]
    assert (pool("least"), pool("mean"), pool("product"), pool(F.array_max)) == ([0.5, 0.8, None], [0.75, 0.85, None], [0.5, 0.72, None], [1.0, 0.9, None])
    assert df.select(merged_confidence(F.col("confidence"), F.create_map(F.lit("a"), F.lit(0.6))).alias("m")).first().m == {"a": 0.5, "b": 1.0}


def test_latex(spark):
    from spagyric.functions.text import latex_commands, latex_to_unicode

    cases = {"\\mathbb{R}^2 $x^{2+}_{10}$ a_1": "ℝ^2 x²⁺₁₀ a_1", "\\Rightarrow \\neq \\varphi": "⇒≠ϕ", "$\\mathcal{B}\\mathbf{a1}$": "ℬ𝐚𝟏", "M\\\"{u}ller": "Müller"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert [(r.got, r.b) for r in df.select("b", latex_to_unicode(F.col("a")).alias("got")).collect() if r.got != r.b] == []
    low = spark.createDataFrame([("ludwig van beethoven", "the end of an era")], "a string, b string")
    assert tuple(low.select(latex_to_unicode(F.col("a"), "name"), latex_to_unicode(F.col("b"), "title")).first()) == ("Ludwig van Beethoven", "The End of an Era")
    assert len(latex_commands()) > 150


def test_word_clusters(spark):
    from spagyric.functions.text import with_clusters

    words = spark.createDataFrame([("Acid",), ("none",)], "w string")
    out = with_clusters(words, "w", spark.createDataFrame([("acid", "0110101")], "word string, cluster string"), (2, 4))
    assert {tuple(r) for r in out.collect()} == {("Acid", "0110101", "01", "0110"), ("none", None, None, None)}


def test_units_of_ones_own(spark):
    from spagyric.spec import units as U

    rankine = U.Base("Rankine", U.TEMPERATURE, 5 / 9, 0.0, r"°?R(?:ankine)?")
    model = M.quantity_model("BoilingPoint", U.TEMPERATURE, r"boiling points?", units=(rankine,))
    df = spark.createDataFrame([(1, "The boiling point was 671.6 °R here."), (2, "The boiling point was 5 Zz.")], "id int, text string")
    got = [(r.id, json.loads(r.payload)) for r in X.records(df, ["id"], [model]).collect()]
    assert [(i, p["raw_value"], p["raw_units"], p["units"]) for i, p in got] == [(1, "671.6", "°R", "Rankine^(1.0)")]
