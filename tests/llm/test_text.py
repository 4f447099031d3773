"""Look-alikes, byte-pair encoding and splitting."""

import random
import re
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

from spagyric.llm import bpe as B
from spagyric.llm import plainform as P
from spagyric.llm import splitting as S
from spagyric.session import table


def rewriter(*texts):
    return P.Rewriter(P.classes(Counter("".join(texts))))


@pytest.mark.parametrize(
    "text,plain",
    [
        ("ɑ-methyl", "α-methyl"), ("ß-x", "β-x"), ("µ-x", "μ-x"), ("α-methyl", "α-methyl"), ("1а", "1a"), ("Ѕ6", "S6"), ("Р17", "P17"),
        ("меравиновая кислoта-253", "меравиновая кислота-253"), ("Веларизин", "Веларизин"), ("суаnovelsifol", "cyanovelsifol"), ("MЅМ-3912", "MSM-3912"),
        ("ﬂuoro", "fluoro"), ("äb", "äb"), ("H₂O²", "H₂O²"), ("5‐x y", "5-x y"), ("2′-amino", "2′-amino"), ("ＴＺＲ－１", "TZR-1"), ("so­di​um", "sodium"),
        ("𝛼-x", "α-x"), ("", ""), (" plain ", " plain "), ("ø é ñ", "ø é ñ"), ("cobalt(ІІI)", "cobalt(III)"), ("x" * 100_000 + "‍", "x" * 100_000),
    ],
)
def test_plain_form(text, plain):
    assert rewriter(text)(text) == plain


def test_look_alikes_of_all_scripts(spark):
    """Letters of scripts in no list, by Unicode's skeletons; the representative is the corpus's most frequent member."""
    texts = ["Ꭺspirin", "օxide", "1‚2-diol", "½", "ɡlucose", "γ-x", "Страница"]
    counts = Counter("".join(texts))
    rewrite = P.Rewriter(P.classes(counts, P.skeletons(spark, counts)))
    assert [rewrite(t) for t in texts] == ["Aspirin", "oxide", "1,2-diol", "1/2", "glucose", "γ-x", "Страница"]
    shapes = {"l": "l", "ı": "l", "ӏ": "l", "ǀ": "l"}
    assert {P.look_alikes({a: 5, b: 9}, shapes)["ӏ"]["LATIN"] for a, b in (("l", "ı"), ("ı", "l"))} == {"l", "ı"}
    assert P.Rewriter(P.classes(counts))("Ꭺspirin") == "Ꭺspirin"  # without the skeletons only the list is known


def test_plain_form_is_stable():
    random.seed(5)
    chars = "abcАВСаеорсοΡ́​ -‐①ﬁ𝐚ｚßµα123 кил"
    for _ in range(300):
        text = "".join(random.choices(chars, k=random.randint(0, 12)))
        once = rewriter(text)(text)
        assert rewriter(once)(once) == once


def test_elements_with_nulls(spark):
    schema = "rec_id bigint, compound struct<names: array<string>, labels: array<string>, roles: array<string>>, text string, plain string"
    df = spark.createDataFrame([(1, (["a​", None, ""], None, None), "t", "p"), (2, None, None, None), (3, ([], ["1", "1"], None), None, None)], schema)
    got = {tuple(r) for r in P.plain_elements(df).collect()}
    assert got == {(1, "names", 0, "a​", "a"), (1, "names", 2, "", ""), (3, "labels", 0, "1", "1"), (3, "labels", 1, "1", "1")}
    assert P.plain_elements(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def truth():
    import base64

    import public_tokenizers as T

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    random.seed(1)
    fixed = ["", " ", "  ", " a", "a  b \n\n c ", "aaaaaaa", "a" * 3000, "ab" * 2000, "<|endoftext|> x", "　 x  \t y", "it's I'll 'tis\n 'x", " " * 300, "日本語" * 200, "x\n y\r\n z ", "".join(random.choices("abcdefgh", k=5000))]
    return fixed + ["".join(random.choices(" \n\tabAB12.,'é日", k=random.randint(1, 300))) for _ in range(400)]


def test_encoding_equals_the_library(truth):
    enc = B.Encoder(B.vocabulary_bytes())
    texts = odd_texts()
    flat, count = enc.encode(texts)
    at = 0
    for t, n in zip(texts, count):
        assert flat[at : at + n].tolist() == truth.encode_ordinary(t), t[:40]
        at += n
    assert enc.count(texts).tolist() == count.tolist()


def test_encoding_whole_table(spark, sf, truth):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in B.encode_column(docs, "doc_id", "text").collect()}
    assert got == {r.doc_id: truth.encode_ordinary(r.text or "") for r in docs.collect()}


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in B.encode_column(df, "doc_id", "text").collect()) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert B.encode_column(df.limit(0), "doc_id", "text").count() == 0


LONG = "One sentence here. Another one there!\nA new line follows it. " * 400 + "y" * 9000 + " end.\n\n\nLast " + "日" * 1500


@pytest.mark.parametrize("size", [2000, 1 << 15])
def test_pieces(spark, truth, size):
    df = spark.createDataFrame([(1, LONG, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (5, "a b " * 300, 0), (6, "z" * 30_000, 0)], "doc_id bigint, text string, piece int")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    over = {k for k, t in texts.items() if len(truth.encode_ordinary(t)) > S.LIMIT}
    found = S.oversized(df, "doc_id", "text", size=size)
    assert {(r.doc_id, r.n_tokens) for r in found.collect()} == {(k, len(truth.encode_ordinary(texts[k]))) for k in over}
    by = {}
    for r in S.split(df, "doc_id", "text", size=size).orderBy("doc_id", "piece").collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == over
    for k, ps in by.items():
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert ps[0].start == 0 and ps[-1].end == len(texts[k])
        for p, q in zip(ps, ps[1:]):
            assert p.start < q.start <= p.end < q.end
            assert len(truth.encode_ordinary(texts[k][q.start : p.end])) <= S.OVERLAP + 1
        for p in ps:
            assert p.text == texts[k][p.start : p.end]
            assert len(truth.encode_ordinary(p.text)) <= S.LIMIT
    ends = Counter("natural" if re.search(r"[.!?]$|\n$", p.text) else "other" for p in by[1][:10])
    assert ends["natural"] == 10


def test_pieces_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.split(df, "doc_id", "text").count() == 0 and S.oversized(df, "doc_id", "text").count() == 0


def test_segments_tile_a_text(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id bigint, text string")
    parts = S.segments(S.text_ranges(df, "doc_id", "text", 1000), "doc_id").orderBy("begin").collect()
    assert "".join(p.body for p in parts) == LONG and [p.begin for p in parts][:1] == [0]


def test_sums_are_exact(truth):
    """Lengths of units add up to the length of any run of them, blank lines and all kinds of texts included."""
    enc = B.Encoder(B.vocabulary_bytes())
    random.seed(9)
    for text in [*odd_texts(), "a\n\nb c", "x" * 600 + "1" * 600 + ".'s" * 300, "日本。語" * 300]:
        parts = S.units(text)
        assert "".join(parts) == text
        size = enc.sizes(parts)
        for _ in range(3):
            a, b = sorted(random.randint(0, len(parts)) for _ in range(2))
            assert size[a:b].sum() == len(truth.encode_ordinary("".join(parts[a:b])))


PARAGRAPHS = [("Sentence %d of it. It goes on here\n" % i) * (i % 4) + "\n" * (i % 3) + "word " * (i % 50) + "9" * (i % 7) for i in range(900)]


def test_pieces_do_not_depend_on_ranges(spark, truth):
    random.seed(4)
    texts = ["".join(PARAGRAPHS), LONG, "z" * 3000 + " " + "ab1." * 2000, "".join(random.choices(" \n\tabAB12.,'é日", k=9000)), " " * 5000 + "word. " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    of = lambda size: sorted(map(tuple, S.split(df, "doc_id", "text", size=size).collect()))
    whole = of(1 << 20)
    assert of(1500) == whole
    for _, _, start, end, n, text in whole:
        assert n == len(truth.encode_ordinary(text)) <= S.LIMIT and end - start == len(text)


def test_files_by_byte_ranges(spark, tmp_path):
    text = "".join(PARAGRAPHS) + "é日𝛼" * 400 + " end. " * 500
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    paths = spark.createDataFrame([((tmp_path / f).as_uri(),) for f in ("a.txt", "b.txt")], "path string")
    ranges = S.file_ranges(spark, paths, 3001)
    assert "".join(r.part for r in ranges.orderBy("k").collect()) == text and ranges.count() > 5
    got = sorted(tuple(r)[1:] for r in S.split_ranges(ranges, "path").collect())
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert got == sorted(tuple(r)[1:] for r in S.split(df, "doc_id", "text").collect())
