"""Scalar functions on text columns. All are Catalyst expressions but those marked, which have no built-in.

Every function gives null for null unless it says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
GREEK = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρστυφχψω"
HYPHENS = "‐‑⁃‒–—―"
MINUSES = "-−－⁻"
DOUBLE_QUOTES = "“”„‟\""
SINGLE_QUOTES = "‘’‚‛'`´′"
TILDES = "∼∽∿˜～"
SLASHES = "⁄∕"
BULLETS = "■◼●▲○◆▼⧫△◇▽⬚□"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()
TOP_LEVEL = "com org edu gov net mil aero asia biz cat coop info int jobs mobi museum name pro tel travel us uk de fr es it nl eu jp cn in ru br au ca ch se no fi dk at be pl io".split()
ELEMENT_SYMBOLS = """
H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru
Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At
Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og
""".split()


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


# --- normalisation -------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC; Spark has no such function, so this one is Arrow-batched Python. ASCII text isn't touched."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize(c: Column, form: bool = True, strip: bool = True, collapse: bool = True, hyphens: bool = False, quotes: bool = False, ellipsis: bool = False, slashes: bool = False, tildes: bool = False) -> Column:
    """Unicode form, control characters, odd white space and, if asked for, kinds of punctuation brought to ASCII."""
    c = nfkc(c) if form else c
    c = F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]", "")
    c = F.regexp_replace(F.translate(c, "\u000b\u000c\u0085\u2028\u2029", "   \n\n"), r"\r\n?", "\n")
    if hyphens:
        c = F.regexp_replace(F.translate(c, "\u00ad", ""), _class(HYPHENS + MINUSES), "-")
    if quotes:
        c = F.regexp_replace(F.regexp_replace(c, _class(DOUBLE_QUOTES), '"'), "[″‶]", "''")
        c = F.regexp_replace(F.regexp_replace(c, "[‴‷]", "'''"), _class(SINGLE_QUOTES + "‵"), "'")
    if ellipsis:
        c = F.replace(F.replace(c, F.lit("…"), F.lit("...")), F.lit(" . . . "), F.lit(" ... "))
    if slashes:
        c = F.regexp_replace(c, _class(SLASHES), "/")
    if tildes:
        c = F.regexp_replace(c, _class(TILDES), "~")
    if strip:
        c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(c, r"(?U)\s+", " ") if collapse else c


def excess_normalize(c: Column, form: bool = True) -> Column:
    """For fuzzy comparison: lower case, no white space, one kind of quote, and both kinds of brackets as '('."""
    c = normalize(F.lower(c), form=form, hyphens=True, quotes=True, ellipsis=True, tildes=True)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), "[\"']", "'"), r"[<\[{()}\]>]", "(")


def chem_normalize(c: Column, form: bool = True) -> Column:
    """Strict normalisation and one spelling of elements."""
    c = normalize(c, form=form, hyphens=True, quotes=True, ellipsis=True, tildes=True)
    for old, new in (("sulph", "sulf"), ("aluminum", "aluminium"), ("cesium", "caesium")):
        c = F.regexp_replace(c, f"(?i){old}", new)
    return c


# --- measures and predicates ---------------------------------------------------------------------------------


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


@F.pandas_udf(T.IntegerType())
def levenshtein_within(part: pd.Series, whole: pd.Series) -> pd.Series:
    """Least edit distance between a text and any substring of another (Arrow-batched: no built-in)."""

    def one(a, b):
        if a is None or b is None:
            return None
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return min(row)

    return pd.Series([one(a, b) for a, b in zip(part, whole)], dtype="Int32")


def bracket_level(c: Column) -> Column:
    """Opening brackets less closing ones."""
    return F.length(F.regexp_replace(c, r"[^(\[{]", "")) - F.length(F.regexp_replace(c, r"[^)\]}]", ""))


def is_punct(c: Column) -> Column:
    return c.rlike(r"^\p{P}*$")


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def like_url(c: Column) -> Column:
    last = F.split(F.element_at(F.split(c, r"\."), -1), ":")[0]
    known = last.rlike("/$") | last.isin(TOP_LEVEL)
    dotted = (F.length(c) >= 2) & ~c.startswith(".") & ~c.endswith(".") & c.contains(".")
    return c.startswith("http://") | (c.startswith("www.") & (F.length(c) >= 5)) | (dotted & known)


def like_number(c: Column) -> Column:
    """Digits (commas and stops don't count), fractions of such, and words for numbers."""
    bare = F.regexp_replace(c, "[,.]", "")
    words = "|".join(NUMBER_WORDS)
    return bare.rlike(rf"(?U)^(?:\d+|{words})(?:/(?:\d+|{words}))?$")


def word_shape(c: Column) -> Column:
    """Each character as its class, runs of a class cut at three."""
    # classes are written as private characters first, so that no later class meets an earlier one's letter
    steps = [(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", "\ue000"), (_class(GREEK), "\ue001"), (r"\p{Lu}", "\ue002"), (r"\p{L}", "\ue003"), (_class(DOUBLE_QUOTES + SINGLE_QUOTES), "\ue004"), ("[:;]", "\ue005"), ("[!?.]", "\ue006"), (r"[(\[{)\]}]", "\ue007"), ("[°%]", "\ue008"), (_class(BULLETS), "\ue009"), (r"[^\ue000-\ue009,$&-]", "*")]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    c = F.translate(c, "".join(chr(0xE000 + i) for i in range(10)), "dgXx':.bul")
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1$1")


#: The accepted forms of a number: a sign, digits in groups of three or not, a fraction, a power of ten.
_DIGITS = r"(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d*)?"
_POWER = r"(?:\s*[×x*]\s*10\s*\^?\s*([-−–+]?\d+)|[eE]([-+]?\d+))?"
_FORM = rf"(?U)^[^\w.+−–-]*([-−–+]?)\s*({_DIGITS}){_POWER}\s*(?:\(\d+(?:\.\d+)?\)|±\s*\d+(?:\.\d+)?)?[^\w]*$"


def to_double(c: Column) -> Column:
    """A number out of a tolerant text: '1,234', '12.3(4)', '5 ± 1', '1.2 × 10^-3', '~7'. Null if there is none."""
    part = lambda i: F.regexp_extract(c, _FORM, i)
    digits = F.regexp_replace(part(2), ",", "")
    power = F.translate(F.concat(part(3), part(4)), "−–+", "--")
    number = F.concat(F.when(part(1).isin("-", "−", "–"), F.lit("-")).otherwise(F.lit("")), digits, F.when(power != "", F.concat(F.lit("e"), power)).otherwise(F.lit("")))
    return F.coalesce(F.trim(c).try_cast("double"), F.when(digits.rlike(r"\d"), number.try_cast("double")))


# --- extraction ----------------------------------------------------------------------------------------------

EMAIL = r"([A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"


def emails(c: Column) -> Column:
    """ARRAY of the addresses in a text."""
    return F.regexp_extract_all(F.translate(c, "․", "."), F.lit(EMAIL), F.lit(1))


def strip_querystring(c: Column) -> Column:
    """A URL without query and fragment."""
    return F.regexp_replace(c, r"[?#].*$", "")


def unapostrophe(c: Column) -> Column:
    """Without an apostrophe, and an s behind it, at the end."""
    return F.regexp_replace(c, "['’՚Ꞌ＇`´]s?$", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def cas_numbers(c: Column, strict: bool = False) -> Column:
    """ARRAY of CAS registry numbers among the words. strict: the check digit must fit."""
    found = F.filter(_words(c), lambda w: w.rlike(r"^\d{1,7}-\d\d-\d$"))
    if not strict:
        return found

    def checks(w: Column) -> Column:
        digits = F.reverse(F.regexp_replace(F.regexp_replace(w, r"-\d$", ""), "-", ""))
        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + i * F.substring(digits, i, F.lit(1)).cast("int"))
        return total % 10 == F.substring(w, -1, 1).cast("int")

    return F.filter(found, checks)


def inchikeys(c: Column) -> Column:
    return F.filter(_words(c), lambda w: w.rlike(r"^[A-Z]{14}-[A-Z]{10}-[A-Z\d]$"))


#: The layers of an InChI by the letter that begins them, and what may stand in each; the formula and the atoms'
#: connections and hydrogens come first, others in any order. Written from the layers' definitions.
_LAYERS = {"c": r"[0-9(),;*-]+", "h": r"[0-9(),;*hHD-]+", "q": r"[0-9+;*mnp-]+", "p": r"[0-9+;-]+", "b": r"[0-9,;*mn+-]+", "t": r"[0-9,;*mnu?+-]+", "m": r"[01.]+", "s": r"[123]", "i": r"[0-9,;*hHDTdt+-]*", "f": r"[A-Za-z0-9.]*", "r": r"[A-Za-z0-9.]+", "o": r"[0-9(),]+"}


def inchis(c: Column) -> Column:
    """ARRAY of InChI strings among the words: 'InChI=' may be absent, a formula, or a lone proton, may not; each layer
    behind it is of a known kind."""
    element = r"(?:[A-Z][a-z]?\d*)"
    formula = rf"(?:\d*{element}+(?:\.\d*{element}+)*|p\+1)"
    layer = "(?:" + "|".join(f"{k}{inside}" for k, inside in _LAYERS.items()) + ")"
    return F.filter(_words(c), lambda w: w.rlike(rf"^(?:InChI=)?1S?/{formula}(?:/{layer})*$"))


def smiles(c: Column) -> Column:
    """ARRAY of words that may be SMILES: atoms, of the organic subset or in square brackets (isotope, symbol, chirality,
    hydrogens, charge, class), each with bonds, branches and ring closures around it; more than two characters, as
    many closing as opening brackets, no stop at the end."""
    bracketed = r"\[(?:\d{1,3})?(?:" + "|".join(sorted({*ELEMENT_SYMBOLS, *"b c n o p s se as te".split()}, key=lambda x: (-len(x), x))) + r"|\*)(?:@{1,2}|@(?:TH|AL|SP|TB|OH)\d{1,2})?(?:H\d?)?(?:\++\d{0,2}|-+\d{0,2})?(?::\d+)?\]"
    subset = "|".join("Cl Br B C N O P S F I b c n o p s".split()) + r"|\*"
    bond, ring = r"[-=#$:/\\.~]", r"(?:\d|%\d\d|%\(\d+\))"
    atom = rf"(?:{subset}|{bracketed})(?:{bond}?{ring})*"
    whole = rf"^{atom}(?:[()]*{bond}?[()]*{bond}?{atom})*\)*$"
    return F.filter(_words(c), lambda w: (F.length(w) > 2) & w.rlike(whole) & (bracket_level(w) == 0))


# --- processors: composable functions of columns --------------------------------------------------------------

Processor = Callable[[Column], Column]


def chain(*steps: Processor) -> Processor:
    """Steps one after another; null ends a chain, as every step keeps it."""

    def run(c: Column) -> Column:
        for step in steps:
            c = step(c)
        return c

    return run


def discard(*values: str) -> Processor:
    return lambda c: F.when(~c.isin(*values), c)


def left_add(text: str) -> Processor:
    return lambda c: F.concat(F.lit(text), c)


def right_add(text: str) -> Processor:
    return lambda c: F.concat(c, F.lit(text))


def left_strip(*parts: str) -> Processor:
    """Without each of the parts at the begin, in the given order."""
    return chain(*(lambda c, p=p: F.when(c.startswith(p), F.substring(c, len(p) + 1, 2**31 - 1)).otherwise(c) for p in parts))


def right_strip(*parts: str) -> Processor:
    return chain(*(lambda c, p=p: F.when(c.endswith(p), F.substring(c, F.lit(1), F.length(c) - len(p))).otherwise(c) for p in parts))


def substitute(*rules: tuple[str, str]) -> Processor:
    """Regular expressions, case-insensitive, replaced in the given order."""
    return chain(*(lambda c, a=a, b=b: F.regexp_replace(c, f"(?iU){a}", b) for a, b in rules))


# --- features of words ---------------------------------------------------------------------------------------


def lexeme(c: Column) -> Column:
    """STRUCT of the features by which taggers know a word."""
    count = lambda pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return F.struct(
        c.alias("text"),
        F.lower(c).alias("lower"),
        F.substring(c, 1, 1).alias("first"),
        F.substring(c, -3, 3).alias("suffix"),
        word_shape(c).alias("shape"),
        F.length(c).alias("length"),
        count(r"\p{Lu}").alias("upper_count"),
        count(r"\p{Ll}").alias("lower_count"),
        count(r"\p{Nd}").alias("digit_count"),
        c.rlike(r"^\p{L}+$").alias("is_alpha"),
        is_ascii(c).alias("is_ascii"),
        c.rlike(r"^\p{Nd}+$").alias("is_digit"),
        (c.rlike(r"\p{L}") & (F.lower(c) == c)).alias("is_lower"),
        (c.rlike(r"\p{L}") & (F.upper(c) == c)).alias("is_upper"),
        c.rlike(r"^\p{Lu}[^\p{Lu}]*$").alias("is_title"),
        is_punct(c).alias("is_punct"),
        c.contains("-").alias("is_hyphenated"),
        like_url(c).alias("like_url"),
        like_number(c).alias("like_number"),
    )


#: Accents of LaTeX as combining characters, and named symbols.
_ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331"}
_SYMBOLS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "degree": "°", "pm": "±", "times": "×", "cdot": "·", "rightarrow": "→", "leq": "≤", "geq": "≥", "approx": "≈", "sim": "∼", "infty": "∞", "partial": "∂", "circ": "∘", "textendash": "–", "textemdash": "—", "ldots": "…"}


#: Greek letters whose commands differ from their names, and other commands by their Unicode names.
_GREEK_FORMS = {"varepsilon": "ε", "epsilon": "ϵ", "vartheta": "ϑ", "varpi": "ϖ", "varrho": "ϱ", "varsigma": "ς", "varphi": "ϕ", "lambda": "λ", "Lambda": "Λ"}
_BY_NAME = """
leftarrow LEFTWARDS ARROW; to RIGHTWARDS ARROW; uparrow UPWARDS ARROW; downarrow DOWNWARDS ARROW; leftrightarrow LEFT RIGHT ARROW; updownarrow UP DOWN ARROW; Leftarrow LEFTWARDS DOUBLE ARROW;
Rightarrow RIGHTWARDS DOUBLE ARROW; Leftrightarrow LEFT RIGHT DOUBLE ARROW; mapsto RIGHTWARDS ARROW FROM BAR; longrightarrow LONG RIGHTWARDS ARROW; longleftarrow LONG LEFTWARDS ARROW; rightleftharpoons RIGHTWARDS HARPOON OVER LEFTWARDS HARPOON;
nearrow NORTH EAST ARROW; searrow SOUTH EAST ARROW; mp MINUS-OR-PLUS SIGN; div DIVISION SIGN; ast ASTERISK OPERATOR; star STAR OPERATOR; bullet BULLET OPERATOR; oplus CIRCLED PLUS; otimes CIRCLED TIMES; ominus CIRCLED MINUS;
neq NOT EQUAL TO; ne NOT EQUAL TO; equiv IDENTICAL TO; simeq ASYMPTOTICALLY EQUAL TO; cong APPROXIMATELY EQUAL TO; propto PROPORTIONAL TO; ll MUCH LESS-THAN; gg MUCH GREATER-THAN; le LESS-THAN OR EQUAL TO; ge GREATER-THAN OR EQUAL TO;
in ELEMENT OF; notin NOT AN ELEMENT OF; ni CONTAINS AS MEMBER; subset SUBSET OF; supset SUPERSET OF; subseteq SUBSET OF OR EQUAL TO; supseteq SUPERSET OF OR EQUAL TO; cup UNION; cap INTERSECTION; setminus SET MINUS; emptyset EMPTY SET;
forall FOR ALL; exists THERE EXISTS; neg NOT SIGN; wedge LOGICAL AND; vee LOGICAL OR; nabla NABLA; int INTEGRAL; oint CONTOUR INTEGRAL; sum N-ARY SUMMATION; prod N-ARY PRODUCT; sqrt SQUARE ROOT; angle ANGLE; perp UP TACK; parallel PARALLEL TO;
prime PRIME; dagger DAGGER; ddagger DOUBLE DAGGER; S SECTION SIGN; P PILCROW SIGN; copyright COPYRIGHT SIGN; pounds POUND SIGN; hbar PLANCK CONSTANT OVER TWO PI; ell SCRIPT SMALL L; Re BLACK-LETTER CAPITAL R; Im BLACK-LETTER CAPITAL I; aleph ALEF SYMBOL;
AA LATIN CAPITAL LETTER A WITH RING ABOVE; textregistered REGISTERED SIGN; texttrademark TRADE MARK SIGN; textmu MICRO SIGN; textdegree DEGREE SIGN; guillemotleft LEFT-POINTING DOUBLE ANGLE QUOTATION MARK; guillemotright RIGHT-POINTING DOUBLE ANGLE QUOTATION MARK;
textquoteleft LEFT SINGLE QUOTATION MARK; textquoteright RIGHT SINGLE QUOTATION MARK; textquotedblleft LEFT DOUBLE QUOTATION MARK; textquotedblright RIGHT DOUBLE QUOTATION MARK; vdots VERTICAL ELLIPSIS; cdots MIDLINE HORIZONTAL ELLIPSIS; langle MATHEMATICAL LEFT ANGLE BRACKET; rangle MATHEMATICAL RIGHT ANGLE BRACKET
"""
#: Commands of alphabets and the words with which Unicode names their letters.
_ALPHABETS = {"mathbf": "MATHEMATICAL BOLD", "mathit": "MATHEMATICAL ITALIC", "mathsf": "MATHEMATICAL SANS-SERIF", "mathtt": "MATHEMATICAL MONOSPACE", "mathbb": "MATHEMATICAL DOUBLE-STRUCK", "mathcal": "MATHEMATICAL SCRIPT", "mathscr": "MATHEMATICAL SCRIPT", "mathfrak": "MATHEMATICAL FRAKTUR"}


@lru_cache(maxsize=1)
def latex_commands() -> dict[str, str]:
    """The characters that LaTeX commands stand for, made from the names of Unicode: about 700 with all alphabets."""
    out = {unicodedata.name(c).split()[-1].lower(): c for c in "αβγδεζηθικλμνξοπρστυφχψω"} | {unicodedata.name(c).split()[-1].capitalize(): c for c in "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
    for line in _BY_NAME.replace("\n", " ").split(";"):
        command, name = line.split(maxsplit=1)
        out[command] = unicodedata.lookup(name.strip())
    return out | _GREEK_FORMS | _SYMBOLS


@lru_cache(maxsize=1024)
def _styled(alphabet: str, letter: str) -> str:
    """A letter in a mathematical alphabet; letters that older blocks of Unicode hold go by their names there."""
    kind = _ALPHABETS[alphabet]
    size = "CAPITAL" if letter.isupper() else "SMALL"
    older = {"MATHEMATICAL SCRIPT": "SCRIPT", "MATHEMATICAL FRAKTUR": "BLACK-LETTER", "MATHEMATICAL DOUBLE-STRUCK": "DOUBLE-STRUCK"}.get(kind, "")
    for name in (f"{kind} {size} {letter.upper()}", f"{older} {size} {letter.upper()}", f"{kind} DIGIT {unicodedata.name(letter).split()[-1]}"):
        try:
            return unicodedata.lookup(name)
        except KeyError:
            continue
    return letter


_RAISED = dict(zip("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"))
_LOWERED = dict(zip("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"))


def _moved(math: str) -> str:
    """Raised and lowered digits and signs of a formula, where every character has such a form."""
    for mark, table in (("^", _RAISED), ("_", _LOWERED)):
        math = re.sub(rf"(?<!\\)\{mark}(?:\{{([^{{}}]+)\}}|(\S))", lambda m, t=table: "".join(map(t.get, m[1] or m[2])) if set(m[1] or m[2]) <= set(t) else m[0], math)
    return math


def _latex(text: str, capitalize: str | None = None) -> str:
    names = latex_commands()
    s = re.sub(r"\\([`'^~=.\"]|[uvHcdbkr](?![A-Za-z]))\s*\{?\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]]), text)
    s = re.sub(r"\\(" + "|".join(_ALPHABETS) + r")\s*(?:\{([^{}]*)\}|([A-Za-z0-9]))", lambda m: "".join(_styled(m[1], c) if c.isascii() and c.isalnum() else c for c in m[2] or m[3]), s)
    s = re.sub(r"\{?\\([A-Za-z]+)(?:\{\}|(?![A-Za-z]) ?)\}?", lambda m: names.get(m[1], m[0]), s)
    s = re.sub(r"(?<!\\)\$([^$]*)\$", lambda m: _moved(m[1]), s)
    s = re.sub(r"\\([&%$#_{}])", r"\1", s).replace("---", "—").replace("--", "–").replace("~", " ")
    s = re.sub(r"[{}$]", "", s)
    if capitalize == "name":  # parts of names, but the short ones in lower case between them
        s = re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0] in ("van", "von", "der", "den", "de", "du", "la", "le", "di", "da") else m[0][:1].upper() + m[0][1:], s)
    elif capitalize == "title":
        small = {"a", "an", "the", "of", "and", "or", "in", "on", "for", "to", "by", "with", "at", "from", "as"}
        s = re.sub(r"[^\W\d_]+(?:['’][^\W\d_]+)?", lambda m: m[0] if m[0] in small and m.start() else m[0][:1].upper() + m[0][1:], s)
    return s


def latex_to_unicode(c: Column, capitalize: str | None = None) -> Column:
    """LaTeX accents, letters, symbols, alphabets, raised and lowered digits as characters; braces and math signs go
    (Arrow-batched Python). capitalize: 'name' or 'title' for what is written in lower case."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _latex(x, capitalize))

    return run(c)


def with_clusters(words: DataFrame, word: str, clusters: DataFrame, prefixes: tuple[int, ...] = (4, 6, 10, 20)) -> DataFrame:
    """Adds ``cluster``, the path of bits that a clustering of words (word, cluster) gives to the normalised word, and its begins of
    some lengths; null for words in no cluster. Joined by Spark, which broadcasts the clusters if they are small."""
    known = clusters.select(F.col("word").alias("_word"), "cluster").dropDuplicates(["_word"])
    out = words.join(known, F.lower(F.col(word)) == F.col("_word"), "left").drop("_word")
    return out.withColumns({f"cluster_{n}": F.substring("cluster", 1, n) for n in prefixes})
