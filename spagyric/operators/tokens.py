"""Elements, sentences and words of texts, as layers of one DataFrame each.

Paragraphs and neighbour windows are Catalyst expressions; the splitters of sentences and words are Arrow-
batched Python, which the reference semantics of tokens need. Null and empty texts give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends with a stop and no sentence.
ABBREVIATIONS = set("""
fig figs dr prof no nos ca al e.g i.e vs ref refs eq eqs approx vol mr mrs ms st cf abs m.p b.p mp m.pt resp calc calcd
anal sat conc temp max min av aq equiv tab sec chem phys soc lett rev sci univ inc ltd co dept viz etc wt
""".split())

SPAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, el_idx, text): the parts of plain text between blank lines, trimmed, empty ones left out."""
    parts = F.split(F.col(text), r"\r?\n[ \t]*\r?\n|\r[ \t]*\r")
    trimmed = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return df.select(key, F.posexplode(trimmed).alias("el_idx", "text"))


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end): cut behind stops that end no abbreviation or initial and are followed by a capital,
    digit, bracket or the end, and at line breaks."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n+", text):
        before = text[start : m.start()]
        word = re.search(r"[^\s(\[]*$", before)[0].lower()
        follows = text[m.end() :].lstrip()[:1]
        if m[0][0] == ".":
            if follows and follows.islower() or word.strip(".") in ABBREVIATIONS or re.fullmatch(r"[a-z]", word) and text[m.start() - 1].isupper():
                continue
        _span(text, start, m.start() if m[0][0] == "\n" else m.end(), out)
        start = m.end()
    _span(text, start, len(text), out)
    return out


def _span(text: str, a: int, b: int, out: list) -> None:
    part = text[a:b]
    lead = len(part) - len(part.lstrip())
    part = part.strip()
    if part:
        out.append((part, a + lead, a + lead + len(part)))


@F.pandas_udf(SPAN)
def _sentences(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else sentence_spans(x))


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sent_idx, text, start_pos, end_pos); offsets are relative to the text."""
    rows = df.select(*keys, F.posexplode(_sentences(text)).alias("sent_idx", "s"))
    return rows.select(*keys, "sent_idx", F.col("s.text").alias("text"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


_NUMERIC = r"\d+(?:[.,]\d+)*(?:\(\d+\))?"
_FINE = re.compile(r"\w+|[^\w\s]", re.U)
_PLAIN = re.compile(rf"{_NUMERIC}|\w+(?:['’-]\w+)*|\.\.\.|[^\w\s]", re.U)
#: Names of chemicals keep their brackets, locants and primes; a quantity is parted from its unit.
_UNITS = r"°C|℃|°F|K|nm|mm|cm|mol|mmol|mg|kg|g|mL|ml|L|h|min|s|Hz|MHz|kHz|GHz|eV|V|W|J|kJ|ppm|%"
_CHEM = re.compile(
    rf"(?P<quantity>{_NUMERIC})(?=(?:{_UNITS})(?![\w-]))"
    rf"|(?:{_UNITS})(?![\w-])"
    r"|(?:[(\[][^\s()\[\]]*[)\]]-?)?\w+(?:(?:[-‐‑,′'’:+./]|\([^\s()]*\)|\[[^\s\[\]]*\])+\w+|′|\([^\s()]*\)(?=[\w-]))*(?:\([IVX]+\))?"
    r"|\.\.\.|[^\w\s]",
    re.U,
)


def word_spans(text: str, kind: str = "chem", units: str | None = None) -> list[tuple[str, int, int]]:
    """(word, start, end). kind: 'fine' parts at every change, 'plain' keeps numbers and hyphenated words, 'chem'
    keeps names of chemicals and parts values from units; units: a pattern of the units of the active models, so
    that '12K' is parted only if a model wants kelvin."""
    rule = {"fine": _FINE, "plain": _PLAIN}.get(kind)
    if rule is None:
        rule = _CHEM if units is None else re.compile(_CHEM.pattern.replace(_UNITS, units), re.U)
    out = []
    for m in rule.finditer(text):
        word, a, b = m[0], m.start(), m.end()
        while kind == "chem" and len(word) > 1 and word[-1] in ".,:/+'’":
            word = word[:-1]
            out.append((word, a, a + len(word))) if len(word) == 1 or word[-1] not in ".,:/+'’" else None
        if b - a > len(word):
            rest = text[a + len(word) : b]
            if not out or out[-1][2] != a + len(word):
                out.append((word, a, a + len(word)))
            out += [(c, a + len(word) + i, a + len(word) + i + 1) for i, c in enumerate(rest)]
        else:
            out.append((word, a, b))
    return out


def words(c: Column, kind: str = "chem", units: str | None = None) -> Column:
    """ARRAY<STRUCT<text, start, end>> of the words."""

    @F.pandas_udf(SPAN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else word_spans(x, kind, units))

    return run(c)


def tokens(df: DataFrame, keys: list[str], text: str, kind: str = "chem") -> DataFrame:
    """(keys, tok_idx, text, start_pos, end_pos), one row for each word."""
    rows = df.select(*keys, F.posexplode(words(F.col(text), kind)).alias("tok_idx", "w"))
    return rows.select(*keys, "tok_idx", F.col("w.text").alias("text"), F.col("w.start").alias("start_pos"), F.col("w.end").alias("end_pos"))


def spans_between(c: Column, pattern: str) -> Column:
    """ARRAY of the parts between matches of a regular expression, empty ones left out."""
    return F.filter(F.split(c, pattern), lambda x: x != "")


# --- neighbours --------------------------------------------------------------------------------------------------


def with_heading(elements: DataFrame, doc: str = "doc_id", order: str = "el_idx") -> DataFrame:
    """Adds ``heading``, the text of the last heading or title up to each element. Documents are the unit of the
    window; elements are streamed through it, not gathered."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("heading", F.last(F.when(F.col("el_type").isin("Heading", "Title"), F.col("text")), ignorenulls=True).over(w))


def with_neighbours(df: DataFrame, doc: list[str], order: list[str], text: str = "text", before: int = 1, after: int = 1) -> DataFrame:
    """Adds ``preceding`` and ``following``, arrays of the texts around each row."""
    w = Window.partitionBy(*doc).orderBy(*order)
    preceding = F.collect_list(text).over(w.rowsBetween(-before, -1))
    following = F.collect_list(text).over(w.rowsBetween(1, after))
    return df.withColumn("preceding", preceding).withColumn("following", following)


def section_filter(elements: DataFrame, allow: str | None = None, skip: str | None = None, doc: str = "doc_id") -> DataFrame:
    """The elements of sections whose heading fits ``allow`` and doesn't fit ``skip``; what comes before any
    heading stays unless ``allow`` is given."""
    rows = with_heading(elements, doc)
    if allow:
        rows = rows.where(F.col("heading").rlike(f"(?i){allow}"))
    if skip:
        rows = rows.where(F.col("heading").isNull() | ~F.col("heading").rlike(f"(?i){skip}"))
    return rows
