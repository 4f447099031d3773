import json

import pytest

from spagyric.api import cached_layer, extract, flat_records, layers, view
from spagyric.spec.models import COMPOUND, MELTING_POINT

HTML = b"""<html><body><h1>Synthesis</h1><h2>Results</h2><p>We obtained 4-bromotoluene (2b). It had a melting point of 130-132 \xc2\xb0C.</p>
<table><caption>Data of compounds</caption><tr><th>Compound<th>mp (K)</tr><tr><td>MnO<td>300</tr></table><h2>References</h2><p>A melting point of 5 K was found for toluene.</p></body></html>"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, HTML), (2, b"The melting point of ethanol is 159 K.\n\nNothing."), (3, None), (4, b"")], "doc_id bigint, content binary")


def test_extract(docs):
    out = extract(docs, [MELTING_POINT, COMPOUND], skip_section="references").where("model = 'MeltingPoint'").collect()
    got = {(r.doc_id, p["raw_value"], p["raw_units"], tuple(p["compound"]["names"])) for r in out for p in [json.loads(r.payload)]}
    assert got == {(1, "130-132", "°C", ("4-bromotoluene",)), (1, "300", "K", ("MnO",)), (2, "159", "K", ("ethanol",))}
    with pytest.raises(ValueError):
        extract(docs, [])


def test_flat_records_and_views(docs):
    flat = flat_records(extract(docs, [MELTING_POINT, COMPOUND]), MELTING_POINT)
    assert flat.where("doc_id = 2").first().compound.names == ["ethanol"]
    els, sents = layers(docs)
    assert view(els, "Heading").count() == 2 and sents.where("doc_id = 2").count() == 2


def test_cached_layers(spark, docs, tmp_path):
    made = []

    def make():
        made.append(1)
        return layers(docs)[0]

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert cached_layer(spark, str(tmp_path), config, make).count() == layers(docs)[0].count()
    assert len(made) == 2


def test_streamed_records(spark, tmp_path):
    from spagyric.streaming.documents import resolved_sink, stream_documents, stream_records

    spark.createDataFrame([(1, "The melting point of ethanol is 159 K."), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = stream_records(stream_documents(spark, str(tmp_path / "in")), [MELTING_POINT])
    run = resolved_sink(stream, [MELTING_POINT, COMPOUND], str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [json.loads(r.payload)["raw_value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["159"]
