"""Free-entered values mapped to the entries of a reference list.

Values and the forms of entries are read in two ways: as their words, and as one word without blanks and punctuation, so
that a part written in two words, or two in one, makes no difference. Each distinct token is joined to the vocabulary of
the reference list by edit distance, over a join on deletion variants; the corrected tokens are combined by
soft TF-IDF, which ranks the forms that they cover token by token. The entry ranked first is what the value denotes, unless
another comes as near as ``MARGIN``. A value that ends with a stop may be cut off, and then reads as any form that begins
with it, at the price of ``CUT``.

Words that don't denote anything (grades, temperatures) don't count. Everything is a join over distinct values and
tokens; neither list is collected, and the index is broadcast only up to ``BROADCAST_INDEX`` rows.

Defined cases: null values are no case, empty and blank ones denote nothing, values that denote several
entries or none get 0 and are thus reported; repeated rows give one result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spagyric.session import shared_checkpoints

#: Words beside a solvent that don't tell which one it is.
FILLERS = """
in as solvent dry anhydrous abs absolute freshly fresh distilled redistilled degassed dried deoxygenated purified neat
hplc grade reagent acs analytical spectroscopic technical pure commercial solution sol the a of at with using
k c rt temp temperature room
""".split()
#: Words of fewer letters are right as they are: in abbreviations and formulas one letter makes another entry.
SHORT = 5
#: Score of a form that a cut-off value begins as written, and without words that denote nothing; score that is enough, and
#: the lead that the first entry needs.
CUT, CUT_CORE, ENOUGH, MARGIN = 0.98, 0.96, 0.7, 0.01
#: What a slip in the first letter counts for more than another: slips seldom hit it.
FIRST = 0.02
#: Letters that tell what a cut-off value begins.
BEGIN = 3
#: An index of up to this many rows is broadcast.
BROADCAST_INDEX = 1_000_000


def folded(text: str) -> str:
    """Lower case, plain digits and hyphens, no outer punctuation or blanks."""
    text = text.translate(str.maketrans("₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹‐‑‒–—−", "01234567890123456789------")).casefold()
    return re.sub(r"\s+", " ", text).strip()


def tokens(text: str) -> list[str]:
    """Maximal runs of letters and digits, brackets inside formulas being part of them."""
    return re.findall(r"[^\W_]+(?:\([^\W_]+\)[^\W_]*)*|\([^\W_]+\)[^\W_]+", folded(text))


def letters(text: str) -> str:
    """The text without blanks, hyphens and other punctuation but brackets around parts of formulas."""
    return re.sub(r"[\s\-.,'’]+", "", folded(text))


def _variants(token: str, most: int) -> set[str]:
    """The token with up to ``most`` characters deleted."""
    out = level = {token}
    for _ in range(most):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], before[j - 2] + 1)
        before, row = row, new
    return row[-1]


def allowed(token: str) -> int:
    """Edits a token may be off by; digits aren't letters and are never off."""
    n = sum(c.isalpha() for c in token)
    return 0 if n < SHORT else 1 if n < 7 else 2


def enclosed(text: str) -> bool:
    """Whether the first bracket closes with the last character."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


def core(value: str) -> str:
    """A folded value without words that denote nothing, conditions and brackets around the whole."""
    text = re.sub(r"\b\d+(?:\.\d+)?\s?(?:k\b|°\s?c\b|%)|\(\s*\)", " ", folded(value))
    text = re.sub(r"\(\s*(?:" + "|".join(FILLERS) + r"|[\s,.])*\)", " ", text)
    text = " ".join(w for w in re.split(r"[\s,;]+", text) if w and w.strip(".()") not in FILLERS).strip()
    while text.startswith("(") and text.endswith(")") and enclosed(text):
        text = text[1:-1].strip()
    return text


def reach(token: str) -> int:
    """Edits between a token and the longest word that it may be a slip of."""
    n = sum(c.isalpha() for c in token)
    return allowed("x" * (n + 2)) if allowed("x" * (n + 1)) else 0


def readings(text: str, entered: bool = True) -> list[tuple[int, str]]:
    """(reading, token). Reading 0 has words, 1 and 2 one word for all, with '=' in front, of the core and as written;
    3 and 4 the begin of such a word, with '<' and '~'. entered: a value, of which a form is taken as it is."""
    whole = folded(text)
    bare = core(text).rstrip(".…") if entered else whole
    joined = lambda x: letters(re.sub(r"\s+-+\s+", "/", x))
    out = [(0, t) for t in tokens(bare)]
    out += [(1 + i, "=" + x) for i, x in enumerate(dict.fromkeys((joined(bare), *([joined(whole)] if entered else [])))) if x]
    if entered and text.strip().endswith((".", "…")):
        out += [(3 + i, mark + x) for i, (mark, x) in enumerate((("<", joined(whole.rstrip("…"))), ("~", joined(bare)))) if len(x) >= BEGIN]
    return out


def closeness(token: str, word: str) -> float | None:
    """How close a token is to a word of the vocabulary, None if it can't be a slip of it."""
    if token[0] in "<~":
        return (CUT if token[0] == "<" else CUT_CORE) if word.startswith("=" + token[1:]) else None
    if token == word:
        return 1.0
    if re.findall(r"\d+", token) != re.findall(r"\d+", word):
        return None
    a, b = token.lstrip("="), word.lstrip("=")
    d = edits(a, b)
    return None if d > allowed(b) else 1 - d / max(len(a), len(b)) - FIRST * (a[0] != b[0])


def _read(df: DataFrame, text: str, entered: bool) -> DataFrame:
    """(text, reading, token, n, k), once each: n tokens in the reading, k of them different."""

    def run(batches):
        for b in batches:
            out = []
            for t in b[text]:
                found = readings(t, entered)
                once = list(dict.fromkeys(found))
                out += [(t, r, x, sum(r == q for q, _ in found), sum(r == q for q, _ in once)) for r, x in once]
            yield pd.DataFrame(out, columns=[text, "reading", "token", "n", "k"])

    return df.select(text).mapInPandas(run, f"{text} string, reading int, token string, n int, k int")


def _spread(df: DataFrame, token: str, known: bool, longest: int) -> DataFrame:
    """(token, variant): hashes of what a token has in common with tokens it may be a slip of. known: of the vocabulary,
    whose words also have all their begins. Nothing within reach of tokens much longer than the longest word."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b[token]:
                mark, bare = (t[0], t[1:]) if t[0] in "=<~" else ("", t)
                if mark in ("<", "~"):
                    rows.append((t, "<" + bare))
                    continue
                if len(bare) > longest + 2:
                    continue
                rows += [(t, mark + v) for v in _variants(bare, allowed(bare) if known else reach(bare))]
                if known and mark:
                    rows += [(t, "<" + bare[:i]) for i in range(BEGIN, len(bare) + 1)]
            yield pd.DataFrame(rows, columns=[token, "_v"])

    return df.select(token).mapInPandas(run, f"{token} string, _v string").select(token, F.xxhash64("_v").alias("variant"))


def repairs(seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, close) of the distinct tokens in ``seen``: words of the vocabulary within the allowed edits."""
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    index = _spread(vocabulary, "word", True, longest).distinct().checkpoint()
    small = index.count() <= BROADCAST_INDEX

    def verify(batches):
        for b in batches:
            out = b.assign(close=pd.Series([closeness(t, w) for t, w in zip(b["token"], b["word"])], index=b.index, dtype="float64"))
            yield out[out["close"].notna()]

    pairs = _spread(seen, "token", False, longest).join(F.broadcast(index) if small else index, "variant").select("token", "word").distinct()
    return pairs.mapInPandas(verify, "token string, word string, close double")


def ranked(values: DataFrame, forms: DataFrame) -> DataFrame:
    """(value, entry, score) of all entries one of whose forms a value covers: each of its tokens is close to one of the
    form's and each of the form's to one of its. score: soft TF-IDF of the best form.

    values: (value) distinct; forms: (entry, text).
    """
    texts = forms.select("text").distinct()
    held = _read(texts, "text", False).selectExpr("text", "token as word", "n as m", "k as j").checkpoint()
    total = texts.count()
    weight = held.groupBy("word").agg(F.count_distinct("text").alias("df")).select("word", F.pow(F.log(1 + F.lit(total) / F.col("df")), 2).alias("idf2"))
    read = _read(values, "value", True).checkpoint()
    close = repairs(read.select("token").distinct(), held.select("word").distinct())
    met = read.join(close, "token").join(weight, "word").join(held.select("word", "text", "m", "j"), "word")
    per = met.groupBy("value", "reading", "text").agg((F.sum(F.col("close") * F.col("idf2")) / F.sum("idf2")).alias("score"), F.count_distinct("token").alias("tokens"), F.count_distinct("word").alias("words"), *(F.max(c).alias(c) for c in "nkmj"))
    covered = per.where("tokens = k and words = j and n = m")
    return covered.join(forms.distinct(), "text").groupBy("value", "entry").agg(F.max("score").alias("score"))


def map_values(values: DataFrame, entries: DataFrame, number: str, forms: str) -> DataFrame:
    """(value, entry) of the distinct non-null values; entry is 0 if a value denotes no single entry.

    entries: the reference list, (number, forms ARRAY<STRING>).
    """
    shared_checkpoints(values.sparkSession)
    distinct = values.select("value").where("value is not null").distinct().checkpoint()
    listed = entries.select(F.col(number).alias("entry"), F.explode(forms).alias("text")).where("trim(text) <> ''")
    rank = ranked(distinct, listed)
    first = rank.groupBy("value").agg(F.max("score").alias("top"))
    near = rank.join(first, "value").where(F.col("score") > F.col("top") - MARGIN)
    sole = near.where(F.col("top") >= ENOUGH).groupBy("value").agg(F.count("*").alias("k"), F.max_by("entry", "score").alias("entry")).where("k = 1")
    return distinct.join(sole.select("value", "entry"), "value", "left").select("value", F.coalesce("entry", F.lit(0)).alias("entry"))


def solvent_mapping(records: DataFrame, solvents: DataFrame) -> DataFrame:
    """(rec_id, solvent_id), once each, of the records whose solvent isn't literally the name of an entry.

    records: (rec_id, solvent). Values are mapped once each; hot values meet a join that can be split.
    """
    rows = records.select("rec_id", F.col("solvent").alias("value")).where("value is not null").distinct()
    odd = rows.join(solvents.select(F.col("name").alias("value")), "value", "left_anti")  # broadcast by Spark if it is small
    forms = solvents.select("solvent_id", F.array_compact(F.concat(F.array("name", "formula"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("forms"))
    mapped = map_values(odd, forms, "solvent_id", "forms")
    return odd.join(mapped, "value").select("rec_id", F.col("entry").alias("solvent_id")).distinct()
