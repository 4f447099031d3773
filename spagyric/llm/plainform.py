"""Text that looks alike, brought to one form.

Two relations are closed to classes by union-find. Equivalent are code points and strings that are the same text: a
full-width form and its letter, a letter with an accent behind it and the precomposed one, a ligature and its letters,
anything invisible and the empty string. Look-alike are letters of one shape in different scripts, by Unicode's
skeletons of confusable characters (from the library that Spark brings along) and a list of letters. Of each class the
representative, for look-alikes one for each script, is its most frequent plain member in the corpus. A multi-pattern
automaton finds the members of the equivalence classes in a text, the longest at each place, and writes the
representative; then each letter of a word becomes its class's representative in the word's own script.

The corpus gives only counts of code points, at most as many as Unicode has; no texts are collected.

Defined cases: null and empty texts stay as they are, texts of any length are rewritten whole, a mixed word
belongs to the script of most of its letters that look like no other script's, else to Latin, superscripts, subscripts and
primes stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of one shape, Latin with its Cyrillic and Greek counterparts.
LOOK_ALIKES = """
a а ɑ α
c с ϲ
d ԁ
e е
h һ
i і ι
j ј ϳ
k к κ
l ӏ
n ո
o о ο
p р ρ
q ԛ
s ѕ
u υ
v ν ѵ
w ԝ
x х χ
y у
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι Ӏ
J Ј
K К Κ
M М Μ
N Ν
O О Ο
P Р Ρ
S Ѕ
T Т Τ
X Х Χ
Y У Υ Ү
Z Ζ
ß β
ɣ γ
µ μ
"""
#: Greek letters that are plain where they stand alone.
LOCANTS = "αβγδωμ"
#: Hyphens besides those that Unicode calls dash punctuation.
HYPHENS = "−⁃"

#: Strokes between the parts of a fraction.
STROKES = "⁄∕"
#: Marks whose skeletons may stand for them, as quotes, primes and dots may not.
MARKS = ",.;:/()[]{}<>=+!?&%"

_WORD = re.compile(r"(?:(?![²³¹⁰-₟])[^\W\d_])+")


@lru_cache(maxsize=65536)
def script_of(c: str) -> str | None:
    """The script of a letter, the first word of its Unicode name; None for other characters."""
    return unicodedata.name(c, "OTHER").partition(" ")[0] if c.isalpha() else None


def invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r" or "︀" <= c <= "️" or c in "͏ᅟᅠㅤ"


def equivalent(c: str) -> str | None:
    """The plain string a single code point stands for regardless of its word, or None."""
    if invisible(c):
        return ""
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp"):
        return " " if c != " " else None
    if kind == "Pd" or c in HYPHENS:
        return "-" if c != "-" else None
    if c in STROKES:
        return "/"
    compat = unicodedata.decomposition(c)
    if compat.startswith(("<super>", "<sub>")) or c == "″":
        return None
    full = unicodedata.normalize("NFKC", c)
    full = "".join("-" if unicodedata.category(x) == "Pd" else " " if x.isspace() else "/" if x in STROKES else x for x in full)
    return full if full != c else None


def phonetic(c: str) -> bool:
    """Latin letters of phonetic alphabets, and signs kept apart for old encodings; they are never plain."""
    return "ɐ" <= c <= "ʯ" or "ᴀ" <= c <= "ᶿ" or c in "ßµ"


class Classes:
    """Union-find over strings; a member's class is known by its root."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def frequency(x: str, counts: dict[str, int]) -> int:
    """How often a string can occur at most."""
    return min((counts.get(c, 0) for c in x), default=0)


def equivalences(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative of every string that isn't plain regardless of its word."""
    sets = Classes()
    marks = [c for c in counts if unicodedata.combining(c)]
    for c in counts:
        if (to := equivalent(c)) is not None:
            sets.union(c, to)
        for m in marks:
            whole = unicodedata.normalize("NFC", c + m)
            if len(whole) == 1 and whole != c:
                sets.union(c + m, whole)
    out: dict[str, str] = {}
    for members in sets.members():
        plain = [x for x in members if all(equivalent(c) is None and not unicodedata.combining(c) for c in x)]
        best = min(plain, key=lambda x: (-frequency(x, counts), x), default=None)
        out |= {x: best for x in members if best is not None and x not in plain}
    return out


def look_alikes(counts: dict[str, int], skeletons: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    """letter -> {script: representative} of every letter that looks like another, and mark -> {'': representative}."""
    sets = Classes()
    for line in LOOK_ALIKES.strip().split("\n"):
        first, *rest = line.split()
        for x in rest:
            sets.union(first, x)
    shapes: dict[tuple, list[str]] = {}
    for c, shape in (skeletons or {}).items():
        if c.isalpha() and c not in LOCANTS and equivalent(c) is None and not unicodedata.decomposition(c):
            shapes.setdefault((shape, c.isupper()), []).append(c)
        elif not c.isalnum() and shape in MARKS and c not in MARKS and equivalent(c) is None:
            sets.union(c, shape)
    for same in shapes.values():
        for c in same[1:]:
            sets.union(same[0], c)
    out: dict[str, dict[str, str]] = {}
    for members in sets.members():
        best: dict[str, str] = {}
        for x in sorted(members, key=lambda x: (-counts.get(x, 0), x)):
            if not phonetic(x) and equivalent(x) is None:
                best.setdefault(script_of(x) or "", x)
        best = {"": min(members)} if "" in best else best
        out |= {x: best for x in members if len(members) > 1}
    return out


def classes(counts: dict[str, int], skeletons: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The rules of a corpus, out of how often each code point occurs in it: ``equivalences`` and ``look_alikes``."""
    plain = equivalences(counts)
    after = dict(counts)
    for member, to in plain.items():  # what will stand in the texts
        for c in to:
            after[c] = after.get(c, 0) + frequency(member, counts)
    return plain, look_alikes(after, skeletons)


class Rewriter:
    """Rewrites texts by the rules of ``classes``."""

    def __init__(self, rules: tuple[dict[str, str], dict[str, dict[str, str]]]):
        self.plain, self.alike = rules
        self.machine = ahocorasick.Automaton()
        for member in self.plain:
            if member:
                self.machine.add_word(member, member)
        self.machine.make_automaton() if len(self.machine) else None
        self.marks = str.maketrans({c: best[""] for c, best in self.alike.items() if "" in best})
        self.locant = {x: best["GREEK"] for x, best in self.alike.items() if phonetic(x) and best.get("GREEK", "?") in LOCANTS}

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(start, member), leftmost and longest, without overlap."""
        out: list[tuple[int, str]] = []
        if len(self.machine):
            found: dict[int, str] = {}
            for end, member in self.machine.iter(text):
                start = end - len(member) + 1
                if len(member) > len(found.get(start, "")):
                    found[start] = member
            at = 0
            for start in sorted(found):
                if start >= at:
                    out.append((start, found[start]))
                    at = start + len(found[start])
        return out

    def __call__(self, text: str) -> str:
        """First what is equivalent regardless of its word, then look-alikes by the script of their word."""
        if text.isascii() and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
            return text
        while True:
            out, at = [], 0
            for start, member in self.matches(text):
                out += [text[at:start], self.keep(text, start, member)]
                at = start + len(member)
            new = unicodedata.normalize("NFC", "".join([*out, text[at:]]))
            if new == text:
                break
            text = new
        text = text.translate(self.marks) if self.marks else text
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self._word(m[0], m.string, m.end()), text))

    def keep(self, text: str, start: int, member: str) -> str:
        """The representative of a member of an equivalence class; letters whose word decides are left to it."""
        return member if member in self.locant else self.plain[member]

    def _word(self, word: str, text: str, end: int) -> str:
        if word.isascii():
            return word
        if len(word) == 1:
            if word in LOCANTS:
                return word
            if word in self.locant and text[end : end + 1] in ("-", "", ","):
                return self.locant[word]
            return self.alike.get(word, {}).get("LATIN", word)
        scripts = [script_of(c) for c in word]
        kinds = set(scripts)
        if len(kinds) == 1 and not any(map(phonetic, word)):
            return word
        own = max(sorted(kinds), key=lambda s: (sum(x == s and len(self.alike.get(c, {})) < 2 for c, x in zip(word, scripts)), s == "LATIN"))
        return "".join(c if s == own and not (phonetic(c) and c not in "ßµ") else self.alike.get(c, {}).get(own, c) for c, s in zip(word, scripts))


def code_points(texts: DataFrame, text: str) -> dict[str, int]:
    """Counts of all code points in a text column: at most one row for each that Unicode has."""
    points = texts.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy("c").count()
    return {r[0]: r[1] for r in points.collect()}


def skeletons(spark: SparkSession, points: Iterable[str]) -> dict[str, str]:
    """The skeleton of each letter and mark by Unicode's data on confusable characters, and of the ASCII ones. Empty
    where the library can't be reached from the driver: then the list of letters is all that is known."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return {}
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    wanted = {c for c in points if not c.isascii() and (c.isalpha() or unicodedata.category(c)[0] in "PS")} | {chr(i) for i in range(33, 127)}
    return {c: checker.getSkeleton(c) for c in sorted(wanted)}


_rewriters: dict[int, Rewriter] = {}


def rewriter(texts: DataFrame, text: str):
    """The corpus's rewriter as a function of columns of strings."""
    spark = texts.sparkSession
    counts = code_points(texts, text)
    rules = classes(counts, skeletons(spark, counts))
    shared = spark.sparkContext.broadcast(rules)  # bounded by Unicode

    @F.pandas_udf(T.StringType())
    def plain(s: pd.Series) -> pd.Series:
        key = id(shared.value)  # one a worker
        if key not in _rewriters:
            _rewriters[key] = Rewriter(shared.value)
        rewrite = _rewriters[key]
        return s.map(lambda x: None if x is None else rewrite(x))

    return plain


def elements(mp: DataFrame, fields: list[str] = ["names", "labels"]) -> DataFrame:  # noqa: B006
    """(rec_id, field, pos, text) of every non-null element of the compounds' arrays; no shuffle."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"compound.{f}").alias("texts")) for f in fields))
    rows = mp.select("rec_id", F.explode(parts).alias("p")).select("rec_id", "p.field", F.posexplode("p.texts").alias("pos", "text"))
    return rows.where("text is not null")


def plain_elements(mp: DataFrame, fields: list[str] = ["names", "labels"]) -> DataFrame:  # noqa: B006
    """``elements`` with ``plain``, the one form of each."""
    rows = elements(mp, fields)
    return rows.withColumn("plain", rewriter(rows, "text")("text"))


def comparable(plain: Column) -> Column:
    """What plain texts are compared by: apart from case and outer or repeated blanks."""
    return F.lower(F.trim(F.regexp_replace(plain, " +", " ")))
