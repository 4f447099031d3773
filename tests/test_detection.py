import pytest

from spagyric.sources.readers import elements, metadata, reader_for

HEAD = "<script>" + "var x = 1;\n" * 5000 + "</script>"


@pytest.mark.parametrize("text,name", [(f'<html><head>{HEAD}<meta name="dc.Identifier" scheme="doi" content="10.1021/ja1"></head><body><p>A</p></body></html>', "acs"), (f"{HEAD}<html><body><p>A</p></body></html>", "html"), (f"{'a ' * 20_000}", None)])
def test_markers_behind_a_long_head(spark, text, name):
    p = reader_for(text)
    assert (p and p.name) == name
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, content string")
    assert metadata(docs).count() == (name is not None)
    assert name is None or [r.text for r in elements(docs).collect()] == ["A"]


def test_a_cited_publisher_is_not_the_publisher():
    body = "<p>A</p>" * 5000
    assert reader_for(f'<html><body>{body}<a href="https://link.springer.com/x">1</a></body></html>').name == "html"
    assert reader_for(f'<html>{HEAD}<head><meta content="SpringerLink"></head><body>{body}</body></html>').name == "springer"
