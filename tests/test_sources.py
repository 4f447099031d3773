import json

import pytest

from spagyric.sources import biblio as B
from spagyric.sources import dom as D
from spagyric.sources import readers as R
from spagyric.sources import scrape as W


def test_broken_markup_and_selectors():
    t = D.parse("<ul><li>a<li class='x y'>b</ul><p>one<p>two<br>three</div><a href='/q?x=1' id=k>L</a>")
    assert [D.text_of(n) for n in D.select(t, "li")] == ["a", "b"]
    assert [D.text_of(n) for n in D.select(t, "p")] == ["one", "twothreeL"]
    assert D.select(t, "li.x::text, a::attr(href)") == ["b", "/q?x=1"]
    assert D.select(t, "#k")[0].attrs["href"] == "/q?x=1" and D.select(t, "ul > li + li")[0].attrs["class"] == "x y"
    assert D.select(t, "a[href^=\"/q\"]") and not D.select(t, "a[href$=\"/q\"]") and len(D.select(t, "li:not(.x)")) == 1
    assert D.text_of(D.cleaned(D.parse("<p>a<b>b</b><script>x</script></p>"), strip=("b",))) == "ab"
    assert D.cleaned(D.parse("<p>a<b>b</b></p>"), strip=("b",)).children[0].html() == "<p>ab</p>"


@pytest.mark.parametrize(
    "text,name,reader",
    [
        ("<html><meta name=\"dc.Identifier\" scheme=\"doi\" content=\"10.1021/x\">", "a.html", "acs"), ("<html><meta name=\"citation_doi\" content=\"10.1039/x\">", "a.html", "rsc"), ("<!DOCTYPE article PUBLIC \"-//NLM//DTD x\">", "a.xml", "nlm"),
        ("<us-patent-grant>", "a.xml", "uspto"), ("<x xmlns=\"http://www.elsevier.com/xml/svapi/article/dtd\">", "a.xml", "elsevier"), ("<article dtd-version=\"1.2\">", "a.xml", "springer_jats"), ("<html>", "a.html", "html"), ("<a/>", "a.xml", "xml"), ("plain", "a.txt", None),
    ],
)
def test_detection(text, name, reader):
    p = R.reader_for(text, name)
    assert (p.name if p else None) == reader


def test_elements_of_bad_documents(spark):
    docs = [(1, None), (2, b""), (3, b"%PDF-1.4"), (4, b"\xff\xfeplain \xe9\n\nsecond"), (5, b"<html><body><p></p><table></table></body></html>"), (6, b"<html><table><tr><td>a<td>b<tr><td colspan=3>c</table></html>")]
    got = [(r.doc_id, r.el_type, r.text, r.grid) for r in R.elements(spark.createDataFrame(docs, "doc_id bigint, content binary")).orderBy("doc_id", "el_idx").collect()]
    assert [g[:2] for g in got] == [(4, "Paragraph"), (4, "Paragraph"), (5, "Table"), (6, "Table")]
    assert got[3][3] == [["a", "b", ""], ["c", "c", "c"]]


def test_elsevier_tables():
    xml = "<doc xmlns=\"http://www.elsevier.com/xml/svapi/article/dtd\"><ce:title>T</ce:title><ce:section-title>S</ce:section-title><ce:para>P <ce:italic>i</ce:italic></ce:para><ce:table><ce:caption>C</ce:caption><tgroup><row><entry morerows=\"1\">a</entry><entry>b</entry></row><row><entry>c</entry></row></tgroup></ce:table></doc>"
    found = R.elements_of(xml, R.reader_for(xml))
    assert [(k, t) for k, _, _, t, *_ in found] == [("Title", "T"), ("Heading", "S"), ("Paragraph", "P i"), ("Table", "C")]
    assert found[-1][-1] == [["a", "b"], ["a", "c"]]


def test_csv_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Compound,"Tc (K)"\nMnO,"120"\nFeO,\n', encoding="utf-8")
    assert R.csv_tables(spark, str(tmp_path)).first().grid == [["Compound", "Tc (K)"], ["MnO", "120"], ["FeO", ""]]


def test_scraped_fields():
    e = W.Entity({"n": W.Field("b", kind="int"), "x": W.Field("i", kind="float", all=True), "u": W.Field("a::attr(href)", kind="url", strip_query=True), "d": W.Field("time", kind="datetime"), "y": W.Field("u", kind="bool"), "m": W.Field("p", match=r"(\d+)"), "none": W.Field("zz", default="-")})
    row = e.scrape(D.parse("<b> 7</b><i>1.5</i><i>no</i><a href='http://h/p?q#f'></a><time>2020-01-02</time><u>True</u><p>v 12 w</p>"))
    assert (row["n"], row["x"], row["u"], row["d"].year, row["y"], row["m"], row["none"]) == (7, [1.5], "http://h/p", 2020, True, "12", "-")


def test_people():
    p = B.person("von Beethoven, Ludwig")
    assert (p["firstname"], p["lastname"]) == ("Ludwig", "von Beethoven")
    p = B.person("Juan de la Cierva y Codorníu")
    assert (p["firstname"], p["lastname"]) == ("Juan", "de la Cierva y Codorníu")
    p = B.person("George Oscar “Gob” Bluth, Jr.")
    assert (p["firstname"], p["middlename"], p["nickname"], p["lastname"], p["suffix"]) == ("George", "Oscar", "Gob", "Bluth", "Jr.")
    assert B.could_be("M. J. Halloway", "Martin Halloway") and not B.could_be("M. Halloway", "J. Halloway") and not B.could_be("M. Halloway", "M. Hallowey")
    assert B.person("")["lastname"] is None


def test_bibtex_and_xmp():
    e, = B.bibtex("@Article{C3, author = {M{\\\"u}ller, Ann and {The Group}}, pages =\"1693--1697\", url = {http://x}, month = jan, title={A {B} c}}")
    assert e["authors"][0] == "Ann Müller" and e["fields"] == {"pages": "1693-1697", "link": "http://x", "month": "January", "title": "A B c"}
    assert B.bibtex("") == [] and B.bibtex("@article{x") == [] and B.xmp("<broken") == {}
    assert json.dumps(B.xmp("<x/>")) == "{}"
