import json

from spagyric.api import extract
from spagyric.spec.models import COMPOUND, MELTING_POINT


def test_abbreviations_of_a_document_unite_names(spark):
    text = "We dissolved it in tetrahydrofuran (THF).\n\nIt was stable.\n\nThe melting point of THF is 165 K."
    docs = spark.createDataFrame([(1, text), (2, "The melting point of THF is 165 K.")], "doc_id bigint, content string")
    out = [(r.doc_id, r.model, json.loads(r.payload)) for r in extract(docs, [MELTING_POINT, COMPOUND]).collect()]
    assert [p["compound"]["names"] for d, m, p in out if (d, m) == (1, "MeltingPoint")] == [["THF", "tetrahydrofuran"]]
    assert [p["names"] for d, m, p in out if (d, m) == (1, "Compound")] == [["THF", "tetrahydrofuran"]]
    assert [p["names"] for d, m, p in out if (d, m) == (2, "Compound")] == [["THF"]]
