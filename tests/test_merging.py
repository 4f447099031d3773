"""Merging beyond contexts: binding fields, everything at once, headings; and readers of single publishers."""

import json

import pytest

from spagyric.api import extract, sections
from spagyric.operators import resolve as R
from spagyric.session import local_session, shared_folder  # noqa: F401
from spagyric.sources import readers as S
from spagyric.sources.dom import parse
from spagyric.spec import models as M

BOUND = M.MELTING_POINT.extend("Bound", M.Field("phase", binding=True), M.Field("solvent", contextual=True))


def record(model, data, at=(0, 0, 0), confidence=None, section=0, element=None):
    return R.Record(model, data, at, "x", confidence or {}, section, element)


def test_binding_fields_keep_records_apart():
    a = record(BOUND, {"raw_value": "1", "phase": "alpha"})
    assert not R.merge_contextual(a, record(BOUND, {"solvent": "w", "phase": "beta"}, (0, 1, 0)), 1 * M.SENTENCE)
    assert R.merge_contextual(a, record(BOUND, {"solvent": "w", "phase": "alpha"}, (0, 1, 0), {"record": 0.4}), 1 * M.SENTENCE)
    assert a.data["solvent"] == "w" and a.confidence == {"record": 0.4}
    inner = M.Model("Inner", (M.Field("phase", binding=True), M.Field("x")))
    outer = M.Model("Outer", (M.Field("phase", binding=True), M.Field("inner", inner)))
    data = {"phase": "alpha", "inner": {"x": "1"}}
    R.consolidated(outer, data)
    assert data["inner"] == {"x": "1", "phase": "alpha"}


def test_merge_all_fills_any_field():
    a, b = record(M.MELTING_POINT, {"raw_value": "1", "compound": {"names": ["a"]}}), record(M.MELTING_POINT, {"units": "K", "compound": {"names": ["a"], "labels": ["2"]}}, (9, 9, 9))
    assert R.merge_all(a, b) and a.data == {"raw_value": "1", "units": "K", "compound": {"names": ["a"], "labels": ["2"]}}
    assert not R.merge_all(a, record(M.MELTING_POINT, {"raw_value": "2"})) and not R.merge_all(a, record(M.COMPOUND, {"names": ["a"]}))


def test_surer_records_of_a_sentence_come_first():
    rows = [record(M.MELTING_POINT, {"raw_value": "1", "raw_units": "K", "specifier": "mp"}, (0, 0, 1)), record(M.COMPOUND, {"names": ["a"]}, (0, 0, 0), {"record": 0.1}), record(M.COMPOUND, {"names": ["b"]}, (0, 0, 3), {"record": 1.0})]
    out = R.resolve_document(rows)
    assert [r.data["compound"]["names"] for r in out if r.model is M.MELTING_POINT] == [["b"]]


PAGE = b"<html><body><h1>T</h1><h2>Preparation of 4-bromotoluene</h2><p>We used toluene.</p><p>The melting point was 300 K.</p><h2>Methods</h2><p>It had a melting point of 310 K.</p></body></html>"


def test_headings_name_the_compound(spark):
    out = extract(spark.createDataFrame([(1, PAGE)], "doc_id bigint, content binary"), [M.MELTING_POINT, M.COMPOUND]).where("model = 'MeltingPoint'").collect()
    assert {(p["raw_value"], p["compound"]["names"][0]) for r in out for p in [json.loads(r.payload)]} == {("300", "4-bromotoluene"), ("310", "toluene")}


def test_adjacent_sections_count_as_one(spark):
    els = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate([("Heading", "Methods"), ("Paragraph", "a"), ("Heading", "Materials"), ("Heading", "Results")])], "doc_id int, el_idx int, el_type string, text string")
    assert [r.section for r in sections(els, "doc_id", "methods|materials").orderBy("el_idx").collect()] == [1, 1, 1, 2]
    assert [r.section for r in sections(els, "doc_id").orderBy("el_idx").collect()] == [1, 1, 2, 3]


def test_named_columns_span():
    xml = "<table><tgroup><colspec colname='a'/><colspec colname='b'/><colspec colname='c'/><thead><row><entry>H</entry><entry namest='b' nameend='c'>wide</entry></row></thead><tbody><row><entry morerows='1'>x</entry><entry>1</entry><entry>2</entry></row><row><entry colname='c'>3</entry></row></tbody></tgroup></table>"
    table = next(n for n in parse(xml, True).walk() if n.tag == "table")
    assert S.grid_of(table, S.XML) == [["H", "wide", "wide"], ["x", "1", "2"], ["x", "", "3"]]


def test_publisher_trees_are_mended():
    rsc = next(p for p in S.READERS if p.name == "rsc")
    html = '<html><body><div class="table_caption">Table of x</div><div class="rtable__wrapper"><table><tr><td>1</td></tr></table></div><p>Of <img src="http://x.org/images/entities/char_03b1.gif">-form<a href="#r"><sup><span class="sup_ref">1</span></sup></a>next</p></body></html>'
    els = S.elements_of(html, rsc)
    assert [e[3] for e in els if e[0] == "Paragraph"] == ["Of α-form1 next"]


def test_decoders_of_binary_formats(spark):
    df = spark.createDataFrame([(1, b"%PDF-1.4 abc"), (2, b"plain text"), (3, b"ZZ bad"), (4, b"QQ x")], "doc_id bigint, content binary")

    def fails(raw):
        raise OSError("broken")

    made = S.elements(df, decoders={b"%PDF": lambda raw: "One.\n\nTwo.", b"ZZ": fails, b"QQ": lambda raw: [("Title", None, [], "T", None, [], None)]}).collect()
    assert {(r.doc_id, r.el_type, r.text) for r in made} == {(1, "Paragraph", "One."), (1, "Paragraph", "Two."), (2, "Paragraph", "plain text"), (4, "Title", "T")}
    assert {r.doc_id for r in S.elements(df).collect()} == {2, 3, 4}


def test_tagged_corpora(spark, tmp_path):
    for form, text in {"slash": "The/DT acid/NN\nIt/PRP", "columns": "The\tDT\nacid\tNN\n\nIt PRP\n", "brackets": "(S (DT The) (NN acid))\n\n(S (PRP It))"}.items():
        (tmp_path / form).write_text(text)
        got = [[(t.text, t.tag) for t in r.tokens] for r in S.tagged_corpus(spark, str(tmp_path / form), form).orderBy("sent_idx").collect()]
        assert got == [[("The", "DT"), ("acid", "NN")], [("It", "PRP")]]


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session(), "checkpoints")


def test_xpath():
    from spagyric.sources.dom import xpath

    tree = parse('<div id="a"><p class="x y">One<b>two</b></p><p>Three</p><ul><li>1</li><li lang="de">2</li></ul></div>', False)
    text = lambda path: [x if isinstance(x, str) else x.text() for x in xpath(tree, path)]
    assert text("//p") == ["Onetwo", "Three"] and text("/div/p[2]") == ["Three"] and text("//li[last()]/@lang") == ["de"]
    assert text("//p[contains(@class, 'x')]/b/text()") == ["two"] and text("//li[@lang='de'] | //p[1]") == ["Onetwo", "2"]
    assert text("//b/..") == ["Onetwo"] and text("//*[@id='a']//li[.='1']") == ["1"] and text("//none") == []
    with pytest.raises(ValueError):
        xpath(tree, "//p[foo()]")


def test_columns_of_markup(spark):
    from pyspark.sql import functions as F

    from spagyric.sources.scrape import clean_html, feed_items, strip_html

    df = spark.createDataFrame([(1, "<p>a <b>b</b><script>x</script></p>"), (2, None)], "id int, h string")
    assert [tuple(r) for r in df.select(clean_html(F.col("h"), strip=("b",)), strip_html(F.col("h"))).collect()] == [("<p>a b</p>", "a b"), (None, None)]
    feed = spark.createDataFrame([(1, "<rss><channel><item><title>T</title><link>http://x.org/1</link><dc:identifier>doi:10.5555/12</dc:identifier></item></channel></rss>")], "id int, x string")
    assert [(r.title, r.doi) for r in feed_items(feed, "id", "x").collect()] == [("T", "10.5555/12")]


def test_cached_layers_know_their_input(spark, tmp_path):
    from spagyric.api import cached_layer

    made = []
    for rows in ([(1,)], [(1,)], [(2,)]):
        df = spark.createDataFrame(rows, "a int")
        assert cached_layer(spark, str(tmp_path), {"v": 1}, lambda df=df: made.append(1) or df, df).collect() == df.collect()
    assert len(made) == 2
