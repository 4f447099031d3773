"""Tags of words: taggers as functions of token lists, mentions of chemicals, abbreviations.

The built-in tagger of chemicals is rule-based (dictionary, formulas, endings); neural taggers have their place
behind ``Tagger``. Sentences are tagged in Arrow batches; dictionaries that users supply are joined.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spagyric.functions.text import ELEMENT_SYMBOLS

#: From the words of a sentence to one tag for each.
Tagger = Callable[[Sequence[str]], list[str]]


# --- pattern and dictionary taggers ------------------------------------------------------------------------------

#: Word forms and the part of speech they suggest, tried in order.
WORD_FORMS = [
    (r"^-?\d+(?:[.,]\d+)*$", "CD"), (r"^(?:The|the|A|a|An|an)$", "DT"), (r".*able$", "JJ"), (r".*ness$", "NN"), (r".*ly$", "RB"),
    (r".*s$", "NNS"), (r".*ing$", "VBG"), (r".*ed$", "VBD"), (r"^[^\w\s]+$", "."), (r".*", "NN"),
]


def regex_tagger(patterns: list[tuple[str, str]] = WORD_FORMS) -> Tagger:
    rules = [(re.compile(p), t) for p, t in patterns]
    return lambda ws: [next((t for r, t in rules if r.search(w)), "") for w in ws]


def regex_tag(word: Column, patterns: list[tuple[str, str]] = WORD_FORMS) -> Column:
    """The same as a Catalyst expression on one word."""
    out = F.lit("")
    for p, t in reversed(patterns):
        out = F.when(word.rlike(p), t).otherwise(out)
    return out


def dictionary_tagger(phrases: Iterable[Sequence[str]], entity: str = "CM", case_sensitive: bool = False) -> Tagger:
    """Longest phrases of a dictionary at each word, as B- and I- tags."""
    fold = (lambda w: w) if case_sensitive else str.lower
    trie: dict = {}
    for p in phrases:
        at = trie
        for w in p:
            at = at.setdefault(fold(w), {})
        at[None] = True

    def tag(ws: Sequence[str]) -> list[str]:
        out, i = ["O"] * len(ws), 0
        while i < len(ws):
            at, j, end = trie, i, 0
            while j < len(ws) and fold(ws[j]) in at:
                at, j = at[fold(ws[j])], j + 1
                end = j if None in at else end
            for k in range(i, end):
                out[k] = ("B-" if k == i else "I-") + entity
            i = max(end, i + 1)
        return out

    return tag


def dictionary_matches(tokens: DataFrame, phrases: DataFrame, sentence: list[str], longest: int = 5) -> DataFrame:
    """(sentence, start_idx, n) of dictionary phrases of up to ``longest`` words, for dictionaries of any size:
    n-grams of words meet the phrases in an equi-join. tokens: (sentence, tok_idx, text); phrases: (phrase), words
    in lower case with single blanks. Overlapping matches are all returned."""
    from pyspark.sql import Window

    w = Window.partitionBy(*sentence).orderBy("tok_idx")
    ahead = [F.lead(F.lower("text"), i).over(w) for i in range(longest)]
    grams = tokens.select(*sentence, "tok_idx", F.array_compact(F.array(*ahead)).alias("ws"))
    grams = grams.select(*sentence, F.col("tok_idx").alias("start_idx"), F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("n"), "ws")
    grams = grams.withColumn("phrase", F.array_join(F.slice("ws", F.lit(1), F.col("n")), " "))
    return grams.join(phrases.select("phrase").distinct(), "phrase").select(*sentence, "start_idx", "n", "phrase")


def name_dictionary(names: DataFrame, name: str, stop: Iterable[str] = ("solution", "compound", "acid", "water soluble")) -> DataFrame:
    """(phrase) of a dictionary out of raw names: lower case, without brackets around the whole, sources in brackets
    behind it and doubtful entries (short, numbers only, stop words), with the variants in which hyphens are
    blanks. Catalyst only; distinct over the whole list."""
    c = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    c = F.regexp_replace(c, r"^[(\[](.*)[)\]]$", "$1")
    c = F.trim(F.regexp_replace(c, r"\s*[(\[][a-z0-9.\s-]*(?:usp|inn|jan|ban|iso|usan|nf)[^)\]]*[)\]]$", ""))
    rows = names.select(F.explode(F.array_distinct(F.array(c, F.regexp_replace(c, "-", " ")))).alias("phrase"))
    fine = (F.length("phrase") > 2) & ~F.col("phrase").rlike(r"^[\d\W]+$") & ~F.col("phrase").isin(*stop)
    return rows.where(F.col("phrase").isNotNull() & fine).distinct()


def ensemble(*taggers: Tagger) -> Tagger:
    """For each word the tag of the last tagger that has one."""

    def tag(ws):
        out = ["O"] * len(ws)
        for t in taggers:
            out = [b if b not in ("", "O") else a for a, b in zip(out, t(ws))]
        return out

    return tag


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: the share of rows with equal tags."""
    return df.agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


# --- averaged perceptron -----------------------------------------------------------------------------------------


class Perceptron:
    """Greedy averaged perceptron for tags; words with nearly always one tag are looked up."""

    def __init__(self, weights: dict | None = None, sure: dict | None = None, classes: Iterable[str] = ()):
        self.weights, self.sure, self.classes = weights or {}, sure or {}, set(classes)

    @staticmethod
    def features(ws: Sequence[str], i: int, before: str, before2: str) -> list[str]:
        w = ws[i]
        near = lambda k: ws[k].lower() if 0 <= k < len(ws) else "-edge-"
        shape = re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"\d", "d", w))))
        return ["bias", "w " + w.lower(), "s3 " + w[-3:], "p1 " + w[:1], "sh " + shape, "t-1 " + before, "t-2 " + before2 + " " + before, "w-1 " + near(i - 1), "w+1 " + near(i + 1), "s-1 " + near(i - 1)[-3:], "s+1 " + near(i + 1)[-3:], "t-1 w " + before + " " + w.lower()]

    def predict(self, features: list[str]) -> str:
        scores: dict[str, float] = defaultdict(float)
        for f in features:
            for tag, weight in self.weights.get(f, {}).items():
                scores[tag] += weight
        return max(sorted(self.classes), key=lambda t: (scores[t], t)) if self.classes else ""

    def __call__(self, ws: Sequence[str]) -> list[str]:
        out: list[str] = []
        for i, w in enumerate(ws):
            tag = self.sure.get(w) or self.predict(self.features(ws, i, out[-1] if out else "-start-", out[-2] if len(out) > 1 else "-start-"))
            out.append(tag)
        return out

    def train(self, data: list[tuple[list[str], list[str]]], rounds: int = 5, seed: int = 1, least: int = 20, share: float = 0.97) -> "Perceptron":
        """data: a bounded sample of tagged sentences; see ``tag_dictionary`` for counts over whole corpora."""
        counts: dict[str, Counter] = defaultdict(Counter)
        for ws, ts in data:
            self.classes.update(ts)
            for w, t in zip(ws, ts):
                counts[w][t] += 1
        self.sure = {w: c.most_common(1)[0][0] for w, c in counts.items() if sum(c.values()) >= least and c.most_common(1)[0][1] >= share * sum(c.values())}
        order = random.Random(seed)
        current: dict[tuple[str, str], float] = defaultdict(float)
        delayed: dict[tuple[str, str], float] = defaultdict(float)  # changes weighted by the number of decisions before them
        step = 0
        for _ in range(rounds):
            order.shuffle(data := list(data))
            for ws, ts in data:
                said: list[str] = []
                for i, (w, gold) in enumerate(zip(ws, ts)):
                    known = self.sure.get(w)
                    if not known:
                        features = self.features(ws, i, said[-1] if said else "-start-", said[-2] if len(said) > 1 else "-start-")
                        known = self.predict(features)
                        for tag, by in ((gold, 1.0), (known, -1.0)) if known != gold else ():
                            for f in features:
                                current[f, tag] += by
                                delayed[f, tag] += by * step
                                self.weights.setdefault(f, {})[tag] = current[f, tag]
                        step += 1
                    said.append(known)
        # the mean over all decisions of a weight is what it is in the end, less what was missing before each change
        for (f, tag), end in current.items():
            self.weights[f][tag] = round(end - delayed[f, tag] / max(step, 1), 4)
        return self

    def dumps(self) -> str:
        return json.dumps({"weights": self.weights, "sure": self.sure, "classes": sorted(self.classes)})

    @classmethod
    def loads(cls, text: str) -> "Perceptron":
        return cls(**json.loads(text))


class Chain:
    """A linear chain of tags with conditional probabilities: the probability of all tags of a sentence together, given features
    of its words. Trained by the gradient of the log-likelihood (forward and backward sums), decoded by the best path; tags
    that can't follow each other (I- behind O) never do."""

    def __init__(self, tags: Sequence[str] = (), weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.tags, self.weights, self.moves = list(tags), weights or {}, moves

    @staticmethod
    def features(ws: Sequence[str], i: int) -> list[str]:
        w = ws[i]
        near = lambda k: ws[k].lower() if 0 <= k < len(ws) else "-edge-"
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"\d", "d", w))))
        return ["bias", "w " + w.lower(), "p3 " + w[:3].lower(), "s3 " + w[-3:].lower(), "s4 " + w[-4:].lower(), "sh " + shape, "w-1 " + near(i - 1), "w+1 " + near(i + 1)]

    def allowed(self):
        import numpy as np

        return np.array([[not b.startswith("I-") or a[2:] == b[2:] and a[:2] in ("B-", "I-") for b in self.tags] for a in self.tags])

    def _scores(self, ws: Sequence[str]):
        import numpy as np

        zero = np.zeros(len(self.tags))
        out = np.array([sum((self.weights.get(f, zero) for f in self.features(ws, i)), zero) for i in range(len(ws))])
        out[0] = np.where([t.startswith("I-") for t in self.tags], -1e9, out[0])
        return out

    def train(self, data: list[tuple[list[str], list[str]]], rounds: int = 10, rate: float = 0.2, decay: float = 1e-4, seed: int = 1) -> "Chain":
        """data: a bounded sample of tagged sentences."""
        import numpy as np

        self.tags = sorted({t for _, ts in data for t in ts})
        n, at = len(self.tags), {t: i for i, t in enumerate(self.tags)}
        weights: dict = defaultdict(lambda: np.zeros(n))
        moves, off = np.zeros((n, n)), np.where(self.allowed(), 0.0, -1e9)
        log_sum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        self.weights, order = weights, random.Random(seed)
        for k in range(rounds):
            step = rate / (1 + k)
            order.shuffle(data := list(data))
            for ws, ts in data:
                if not ws:
                    continue
                e, t = self._scores(ws), moves + off
                ahead, back = [e[0]], [np.zeros(n)]
                for row in e[1:]:
                    ahead.append(log_sum(ahead[-1][:, None] + t, 0) + row)
                for row in e[:0:-1]:
                    back.append(log_sum(t + (row + back[-1])[None, :], 1))
                back.reverse()
                whole = log_sum(ahead[-1], 0)
                gold = [at[x] for x in ts]
                for i in range(len(ws)):
                    change = -np.exp(ahead[i] + back[i] - whole)
                    change[gold[i]] += 1
                    for f in self.features(ws, i):
                        weights[f] = weights[f] * (1 - decay * step) + step * change
                    if i:
                        both = -np.exp(ahead[i - 1][:, None] + t + (e[i] + back[i])[None, :] - whole)
                        both[gold[i - 1], gold[i]] += 1
                        moves += step * both
        self.weights, self.moves = {f: w.round(4).tolist() for f, w in weights.items()}, moves.round(4).tolist()
        return self._ready()

    def _ready(self) -> "Chain":
        import numpy as np

        self.weights = {f: np.asarray(w) for f, w in self.weights.items()}
        return self

    def __call__(self, ws: Sequence[str]) -> list[str]:
        if not len(ws):
            return []
        path, _ = viterbi(self._scores(ws), self.moves, self.allowed())
        return [self.tags[i] for i in path]

    def dumps(self) -> str:
        return json.dumps({"tags": self.tags, "weights": {f: list(map(float, w)) for f, w in self.weights.items()}, "moves": self.moves})

    @classmethod
    def loads(cls, text: str) -> "Chain":
        return cls(**json.loads(text))._ready()


def tag_dictionary(tagged: DataFrame, word: str, tag: str, least: int = 20, share: float = 0.97) -> DataFrame:
    """(word, tag) of words with nearly always one tag, counted over the whole corpus."""
    counts = tagged.groupBy(word, tag).agg(F.count("*").alias("n"))
    return counts.groupBy(word).agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by(tag, F.struct("n", tag)).alias("t")).where((F.col("all") >= least) & (F.col("top") >= share * F.col("all"))).select(word, F.col("t").alias(tag))


def viterbi(emissions, transitions, allowed=None):
    """Best path through (length, tags) scores with (tags, tags) transition scores; numpy arrays. allowed masks
    transitions, as from O to I-."""
    import numpy as np

    e, t = np.asarray(emissions, float), np.asarray(transitions, float)
    t = t if allowed is None else np.where(allowed, t, -1e9)
    score, back = e[0], []
    for row in e[1:]:
        every = score[:, None] + t
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


# --- mentions of chemicals -----------------------------------------------------------------------------------------

_SYMBOL = "(?:" + "|".join(sorted(ELEMENT_SYMBOLS, key=len, reverse=True)) + ")"
_FORMULA = re.compile(rf"^(?:\(?{_SYMBOL}\d*(?:\.\d+)?\)?\d*){{2,}}[+-]?$")
#: Endings and parts of systematic names, and common names that have none of them.
_ENDING = re.compile(r"(?:ane|ene|yne|anol|enol|one|oic|ate|ide|ine|yl|ole|ose|oxide|amine|amide|nitrile|benzene|toluene|ether|hydrazide|azole|idine|urea|acid|thiol|phenol|ol|al|in|ium)s?$")
_PART = re.compile(r"(?:meth|eth|prop|but|pent|hex|benz|phen|chlor|brom|fluor|iod|nitr|amin|hydrox|carb|sulf|sulph|oxo|acet|form|thi|phosph|tert|cyclo|cyan|alk|vinyl|allyl|tolu|naphth|anthr|pyr|peryl|ferroc|porphyr|quinol|indol|imid|fur|carbaz|coumar|rhodam|glyc|styr)", re.I)
#: Names of the elements.
ELEMENT_NAMES = set("""
hydrogen helium lithium beryllium boron carbon nitrogen oxygen fluorine neon sodium magnesium aluminium aluminum silicon phosphorus sulfur sulphur chlorine
argon potassium calcium scandium titanium vanadium chromium manganese iron cobalt nickel copper zinc gallium germanium arsenic selenium bromine krypton
rubidium strontium yttrium zirconium niobium molybdenum technetium ruthenium rhodium palladium silver cadmium indium tin antimony tellurium iodine xenon
caesium cesium barium lanthanum cerium praseodymium neodymium promethium samarium europium gadolinium terbium dysprosium holmium erbium thulium ytterbium
lutetium hafnium tantalum tungsten rhenium osmium iridium platinum gold mercury thallium bismuth polonium astatine radon francium radium actinium thorium
protactinium uranium neptunium plutonium americium
""".split())
#: Anions by the endings of systematic names, behind an element or another cation.
_ANION = re.compile(r"(?:[a-z]+(?:ide|ate|ite)|oxide)s?$")
COMMON_NAMES = set("water ethanol methanol acetone toluene benzene chloroform dichloromethane hexane pyridine ammonia aniline phenol urea glucose cholesterol caffeine aspirin dmso dmf thf dcm meoh etoh etoac tfa silica alumina brine".split())
_NOT = set("the one none alone some same phone zone time line state rate plate separate moderate appropriate approximate indicate temperature range outline medicine machine engine combine determine define examine final normal crystal general several total all solution method type value point material signal oil al in was obtained metal optical chemical thermal natural typical residual initial original pale yellow white solid colourless".split())


_SURE_ELEMENTS = ELEMENT_NAMES - {"lead", "gold", "silver"}
_STATE = re.compile(r"\([ivx]+\)$")


def _element(w: str) -> str:
    """A word in lower case without an oxidation state behind it."""
    return _STATE.sub("", w) if w.endswith(")") else w


def is_chemical(word: str) -> bool:
    w = word.lower()
    if w in COMMON_NAMES or _element(w) in _SURE_ELEMENTS:
        return True
    if w.startswith("poly") and re.fullmatch(r"poly\(?[a-z-]{4,}\)?", w) and _ENDING.search(w.rstrip(")")):
        return True
    if w in _NOT or not re.search(r"[A-Za-z]", word):
        return False
    if _FORMULA.match(word) and (re.search(r"\d", word) or len(re.findall("[A-Z]", word)) > 1) and not word.isalpha():
        return True
    if _FORMULA.match(word) and re.fullmatch(r"(?:[A-Z][a-z]?){2,}", word) and re.search("[a-z]", word):
        return True
    systematic = re.search(r"^\d+(?:[,′']\d*)*-|^\(?[EZRS]\)?-|^[αβγδω]-|-\d", word) and len(_PART.findall(word)) >= 1
    return bool(systematic or (len(w) > 5 and _ENDING.search(w) and len(_PART.findall(w)) >= 1))


#: What a chemical's name isn't allowed to begin or end with.
_TRIM = set("of and the a an in with for to or from as by - – , . ; : ( )".split())


def chemical_tags(ws: Sequence[str]) -> list[str]:
    """B-CM and I-CM for chemicals by rules: known words and formulas, joined where a second word continues a name,
    without brackets that don't close."""
    hit = [is_chemical(w) for w in ws]
    for i in range(1, len(ws)):  # 'acetic acid', 'sodium chloride', 'barium titanate'
        cation = not hit[i] and (_element(ws[i - 1].lower()) in ELEMENT_NAMES or ws[i - 1].lower() in ("ammonium", "lead"))
        if cation and ws[i].lower() not in _NOT and _ANION.fullmatch(ws[i].lower()):
            hit[i] = hit[i - 1] = True
        if hit[i] and not hit[i - 1] and re.fullmatch(r"[a-z]+(?:ic|ium|ous)|sodium|lithium|potassium|silver|zinc|copper(?:\([IV]+\))?|nickel(?:\([IV]+\))?|cobalt(?:\([IV]+\))?|iron(?:\([IV]+\))?", ws[i - 1].lower()):
            hit[i - 1] = True
        if not hit[i] and hit[i - 1] and ws[i].lower() in ("acid", "anhydride", "ether", "oxide", "chloride", "bromide", "hydrochloride"):
            hit[i] = True
    out, i = ["O"] * len(ws), 0
    while i < len(ws):
        if not hit[i]:
            i += 1
            continue
        j = i
        while j < len(ws) and hit[j]:
            j += 1
        a, b = i, j
        while a < b and ws[a].lower() in _TRIM:
            a += 1
        while b > a and ws[b - 1].lower() in _TRIM:
            b -= 1
        level = sum(w.count("(") - w.count(")") for w in ws[a:b])
        if level == 0:
            for k in range(a, b):
                out[k] = "B-CM" if k == a else "I-CM"
        i = j
    return out


def spans_of(ws: Sequence[str], tags: Sequence[str]) -> list[tuple[int, int]]:
    """(start, end) of the runs of B- and I- tags."""
    out: list[tuple[int, int]] = []
    for i, t in enumerate(tags):
        if t.startswith("B-"):
            out.append((i, i + 1))
        elif t.startswith("I-") and out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
    return out


# --- abbreviations ---------------------------------------------------------------------------------------------------


def abbreviations(ws: Sequence[str], least: int = 3, most: int = 14) -> list[tuple[list[str], list[str]]]:
    """(short, long) pairs defined in a sentence: 'long (SHORT)', 'SHORT (long)', 'SHORT = long'. The letters of the
    short form must be found from right to left in the words before, its first at the begin of a word."""

    def fits(words: Sequence[str]) -> bool:
        text = "".join(words)
        return least <= len(text) <= most and any(c.isupper() for c in text) and not text.isdigit() and text[0].isalnum() and len(words) <= 2

    def long_form(short: str, before: Sequence[str]) -> list[str] | None:
        letters = [c.lower() for c in short if c.isalnum()]
        k = len(letters) - 1
        for i in range(len(before) - 1, max(-1, len(before) - 1 - min(len(letters) + 5, 2 * len(letters))), -1):
            w = before[i].lower()
            p = len(w) - 1
            while p >= 0 and k >= 0:
                if w[p] == letters[k] and (k > 0 or p == 0 or not w[p - 1].isalnum()):
                    k -= 1
                    if k < 0 and p > 0 and w[p - 1].isalnum():
                        return None
                p -= 1
            if k < 0:
                found = list(before[i:])
                return found if "".join(found).lower() != short.lower() else None
        return None

    out = []
    for i, w in enumerate(ws):
        if w == "(":
            close = next((j for j in range(i + 1, len(ws)) if ws[j] == ")"), None)
            if close is None or close == i + 1:
                continue
            inside = list(ws[i + 1 : close])
            inside = inside[: next((k for k, x in enumerate(inside) if x in ",;"), len(inside))]
            if inside and fits(inside) and (found := long_form("".join(inside), ws[:i])):
                out.append((inside, found))
            elif i and fits([ws[i - 1]]) and len(inside) > 1 and (found := long_form(ws[i - 1], inside)) and len(found) == len(inside):
                out.append(([ws[i - 1]], inside))
        elif w == "=" and 0 < i < len(ws) - 1 and fits([ws[i - 1]]):
            end = next((j for j in range(i + 1, len(ws)) if ws[j] in ",;.)"), len(ws))
            if (found := long_form(ws[i - 1], ws[i + 1 : end])) and len(found) == end - i - 1:
                out.append(([ws[i - 1]], list(ws[i + 1 : end])))
    return out


def clauses(ws: Sequence[str], most: int = 12) -> list[list[int]]:
    """Clauses of a sentence as token indexes: members of a coordination ('A and B') each stand for the whole, and
    with 'respectively' the members of two coordinations of one length go in pairs. One clause, the sentence, where
    there is nothing to part or there would be more than ``most``."""
    full = [list(range(len(ws)))]
    low = [w.lower() for w in ws]
    groups, i = [], 0
    while i < len(ws):
        if low[i] in ("and", "or") and 0 < i < len(ws) - 1:
            members, k = [i - 1], i - 1
            if k >= 1 and ws[k] == ",":
                members, k = [k - 1], k - 1
            while k >= 2 and ws[k - 1] == ",":
                members.insert(0, k - 2)
                k -= 2
            groups.append((k, members + [i + 1], i + 2))
        i += 1
    if not groups:
        return full
    if any(a[2] > b[0] for a, b in zip(groups, groups[1:])):
        return full
    paired = "respectively" in low and len({len(m) for _, m, _ in groups}) == 1
    picks = [[m[j] for _, m, _ in groups] for j in range(len(groups[0][1]))] if paired else [[]]
    if not paired:
        for _, members, _ in groups:
            picks = [p + [m] for p in picks for m in members]
    if len(picks) > most:
        return full
    inside = {k for a, _, b in groups for k in range(a, b)}
    return [sorted({k for k in range(len(ws)) if k not in inside and low[k] != "respectively"} | set(p)) for p in picks]


TAGGED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pos", T.StringType()), T.StructField("ner", T.StringType())]))


def tagged(text: Column, pos: Tagger | None = None, ner: Tagger = chemical_tags, kind: str = "chem") -> Column:
    """ARRAY<STRUCT<text, start, end, pos, ner>> of a sentence's words."""
    pos = pos or regex_tagger()

    @F.pandas_udf(TAGGED)
    def run(s: pd.Series) -> pd.Series:
        from spagyric.operators.tokens import word_spans

        def one(x):
            if x is None:
                return None
            spans = word_spans(x, kind)
            ws = [w for w, _, _ in spans]
            return [(*span, p, n) for span, p, n in zip(spans, pos(ws), ner(ws))]

        return s.map(one)

    return run(text)


def mentions(sentences: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, text, start_pos, end_pos): chemicals (CM) and abbreviations with their long forms (ABBR)."""
    schema = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("long", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        from spagyric.operators.tokens import word_spans

        def one(x):
            if x is None:
                return None
            spans = word_spans(x)
            ws = [w for w, _, _ in spans]
            out = [("CM", x[spans[a][1] : spans[b - 1][2]], None, spans[a][1], spans[b - 1][2]) for a, b in spans_of(ws, chemical_tags(ws))]
            fine = [w for w, _, _ in word_spans(x, "plain")]
            return out + [("ABBR", " ".join(s), " ".join(long), None, None) for s, long in abbreviations(fine)]

        return s.map(one)

    return sentences.select(*keys, F.explode(run(text)).alias("m")).select(*keys, "m.*")


def defined_abbreviations(sentences: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, short, long) of the abbreviations that sentences define; only those with a bracket or '=' are looked at."""

    def run(batches):
        from spagyric.operators.tokens import word_spans

        for b in batches:
            out = []
            for *key, x in zip(*(b[c] for c in [*keys, text])):
                spans = word_spans(x, "plain")
                for short, long in abbreviations([w for w, _, _ in spans]):
                    out.append((*key, *(_as_written(x, spans, ws) for ws in (short, long))))
            yield pd.DataFrame(out, columns=[*keys, "short", "long"])

    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)
    # a short form has a capital letter; bracketed or before '='
    able = F.col(text).rlike(r"[(=]") & F.col(text).rlike(r"\p{Lu}")
    return sentences.where(able).select(*keys, text).mapInPandas(run, f"{schema}, short string, long string")


def _as_written(text: str, spans: list[tuple[str, int, int]], ws: Sequence[str]) -> str:
    """Words that follow each other as they stand in the text, so that they equal names found in it."""
    i = next(i for i in range(len(spans)) if [w for w, _, _ in spans[i : i + len(ws)]] == list(ws))
    return text[spans[i][1] : spans[i + len(ws) - 1][2]]
