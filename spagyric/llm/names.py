"""Spellings of the names of people and organisations, linked to the entities they name.

Each distinct string is parsed: family name without accents and particles, given name or initials; or the proper
word of an organisation and the initials of what it is. Which words describe organisations, and which of two words
is the given name, is learned from where each word stands elsewhere in the corpus; there are no lists of either.

Two noisy channels attribute spellings. The first takes family names (of one initial), proper words (of one
description) and given names: a spelling is either what a more frequent one becomes by one slip, or a name of its own.
Expected slips are the writings of the candidate times the rate of that kind of slip, estimated from the corpus, over
the ways in which it can happen; expected own names follow from the number of names and the entropy of their letters,
so that a slip explains a long rare word and never a short or frequent one. The second channel works within a family
name and initial: initials abbreviate any given name that begins with them, and go to the likeliest; a short form goes
to the full name with which it shares families more often than two people by chance do. Given names that no channel
connects are different people. Every spelling is attached to its maximum only.

Candidates come from a join on hashed deletion variants.

Defined cases: null, blank and 'et al.' elements name nobody; strings of which no key can be made are linked
with none; ties go to the more frequent, then to the smaller key; repeated strings count as frequency; one letter alone
is never a slip of another.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spagyric.session import joinable, shared_checkpoints

#: Parts of names that aren't compared, and words that describe nothing.
PARTICLES = "van von der den de di da del della dos du la le ter ten zu zur vom af av bin ibn al el st".split()
TITLES = "dr prof professor doctor mr mrs ms miss sir dame dipl ing phd md msc bsc mba dphil jr sr ii iii iv frsc esq".split()
_STOP = {"the", "of", "on", "for", "and", "in", "at", "a"}

#: Longer words meet by their first or last letters, half as many, of which a slip leaves one part as it is.
LONGEST = 64
#: Prior of a rare spelling being a name of its own, and how its logarithm rises with log frequency.
OWN, OWN_RISE = 0.5, 0.5
#: Log-likelihood of each further writing with one slip, which may be taken from the first, and how many times the
#: expected slips are no surprise.
AGAIN, SPREAD = -1.5, 10.0
#: How fast it becomes unlikely that a share of a name has one slip, of all copies or all writings: an exponent of the
#: rest, for each unit of the logarithm of the copies.
RIGHT = 2.5
#: Times that each letter counts as met before the corpus is read.
LETTER = 200
#: A pair of spellings counts for the rates of slips if one has this many times the writings of the other.
CLEAR = 4
#: A word describes organisations if it stands in this many strings of three or more words, and in at most half as
#: many of two; the proper word has at most half the strings of each word beside it.
DESCRIBES = 2
#: What a common begin of two letters counts for a short form, in families that have both it and the full name.
BEGIN = 0.5


_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "a", "œ": "o", "đ": "d", "ı": "i"})


def unaccented(text: str) -> str:
    if text.isascii():
        return text
    text = text.translate(_PLAIN)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def folded(word: str) -> str:
    """Lower case, no accents."""
    return unaccented(word).lower()


def loose(word: str) -> str:
    """A folded word with ae, oe and ue like the umlauts they may stand for."""
    return re.sub(r"(?<=[aou])e(?=[^aeiou]|$)", "", word)


_TITLE_FIRST = re.compile(rf"^(?:{'|'.join(TITLES)})\b\.?\s+", re.I)
_TITLE_LAST = re.compile(rf",?\s+(?:{'|'.join(TITLES)})\.?$", re.I)
_MARKS = re.compile(r"\s*[\(\[]\d+[\)\]]$|[*†‡§¶#\d]+$|(?<=[^\W\d_])[a-z](?:,[a-z])+$")
_TIGHT_COMMA = re.compile(r"(?<=[a-z]),(?=[A-Z])")


def cleaned(name: str) -> str:
    """Without footnote marks, titles and degrees."""
    s = _MARKS.sub("", " ".join(unicodedata.normalize("NFC", name).split())).strip(" ,;")
    s = _TIGHT_COMMA.sub(", ", s)
    while True:
        t = _TITLE_FIRST.sub("", s)
        t = _TITLE_LAST.sub("", t) if any(len(w) > 2 for w in t.split()[:-1]) else t
        if t == s:
            return s
        s = t.strip(" ,;")


def _initials(word: str) -> bool:
    """Whether a word consists of initials."""
    bare = word.replace(".", "").replace("-", "")
    return bool(bare) and bare.isalpha() and (len(bare) == 1 or bare.isupper() and (len(bare) <= 2 or "." in word))


def full_words(name: str) -> list[str]:
    """The folded words of a cleaned name that are more than initials, particles and words that describe nothing."""
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|['’.-](?=[^\W\d_]))*", name.replace(".", ". "))
    return [folded(w) for w in words if len(w) > 1 and not _initials(w) and w.lower() not in _STOP and w.lower() not in PARTICLES]


def described(name: str) -> bool:
    inside = [w for w in name.split()[1:-1] if w.lower() in _STOP]
    return bool(inside) or len(re.findall(r"[^\W\d_]{3,}\.", name)) > 1


def acronym(name: str) -> str | None:
    """The letters behind a word that may abbreviate what an organisation is: 'Halden LCC'."""
    m = re.fullmatch(r"[^\W\d_]*[^\W\d_A-Z][^\W\d_]*\s+([A-Z]{2,6})", name)
    return m and m[1].lower()


def parse(name: str) -> tuple[str, str, str, str] | None:
    """(kind, family, given, initial) of a string read as a person's name; given is empty if only initials are written.
    Kind is 'person', or 'either' if the order of family and given isn't known. None if the string names nobody."""
    return read_person(cleaned(name))


def read_person(s: str) -> tuple[str, str, str, str] | None:
    """``parse`` of a cleaned name."""
    if not s or re.fullmatch(r"(?:and )?(?:et\.? al\.?|others|anonymous|anon\.?)", s, re.I):
        return None
    words = s.replace(",", " , ").split()
    if "," in words:
        at = words.index(",")
        family, given = words[:at], [w for w in words[at + 1 :] if w != ","]
    else:
        text = re.sub(r"\.(?=[^\W\d_])", ". ", s)
        plain = text.split()
        family, given = plain, []
        lead = next((i for i, w in enumerate(plain) if not _initials(w)), len(plain))
        tail = next((i for i, w in enumerate(reversed(plain)) if not _initials(w)), len(plain))
        if lead:
            given, family = plain[:lead], plain[lead:]
        elif tail:
            family, given = plain[:-tail], plain[-tail:]
    parts = [w for w in family if w.lower().strip(".") not in PARTICLES or len(family) == 1]
    has_particle = len(parts) < len(family)
    if not given:
        middle = [w for w in parts if _initials(w)]
        whole = [w for w in parts if not _initials(w)]
        if len(whole) == 2 and middle:  # Given M. Family
            given, parts = [whole[0]], [whole[1]]
        elif len(whole) == 2:
            if has_particle:  # the word behind the particles is the family name
                at = next(i for i, w in enumerate(family) if w.lower().strip(".") in PARTICLES)
                after = next((w for w in family[at + 1 :] if w.lower().strip(".") not in PARTICLES), whole[-1])
                other = whole[0] if after == whole[1] else whole[1]
                given, parts = [other], [after]
            else:
                return "either", folded(whole[0]), folded(whole[1]), ""
        elif len(whole) > 2:
            given, parts = whole[:1], whole[1:]
    parts = [w for w in parts if not _initials(w)] or parts
    if not parts or not given:
        return None
    first = re.sub(r"[^a-z]", "", folded(given[0]))
    own = folded("".join(re.findall(r"[^\W\d_]+", "".join(parts))))
    return ("person", own, "" if _initials(given[0]) else first, first[0]) if first and own else None


def _deletions(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _variants(word: str) -> set[str]:
    """What words one slip apart have in common, one of it at least."""
    out = _deletions(word) if len(word) <= LONGEST else {word}
    return out | {"^" + word[: LONGEST // 2], "$" + word[-LONGEST // 2 :]} if len(word) >= LONGEST else out


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes one of the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


#: Kinds of slips, and in how many ways each can happen to a word of some length.
SLIPS = {"written out": lambda n: 1, "doubled": lambda n: n, "left out": lambda n: n, "swapped": lambda n: n, "added": lambda n: 25 * n, "replaced": lambda n: 25 * n}


def slip(a: str, b: str) -> str | None:
    """The kind of the one slip that makes word a of word b; None if there isn't just one."""
    if loose(a) == loose(b):
        return "written out"
    for x, y in ((a, b), (loose(a), loose(b))):
        if one_slip(x, y):
            if len(x) == len(y):
                return "swapped" if sorted(x) == sorted(y) else "replaced"
            once = lambda w: re.sub(r"(.)\1+", r"\1", w)
            return "doubled" if once(x) == once(y) else "left out" if len(x) < len(y) else "added"
    return None


# --- from strings to keys ----------------------------------------------------------------------------------------------


def readings(names: DataFrame) -> DataFrame:
    """(name, n, kind, family, given, initial, words, told, acronym) of the distinct names that name somebody; told is
    whether the form of a string tells that it is a description: 'of' or 'for' in it, or abbreviated words."""

    def run(batches):
        for b in batches:
            out = []
            for name, n in zip(b["name"], b["n"]):
                text = cleaned(name)
                p = read_person(text)
                words = full_words(text)
                if p or len(words) > 2:
                    out.append((name, n, *(p or ("none", "", "", "")), words if len(words) > 1 else None, described(text), acronym(text)))
            yield pd.DataFrame(out, columns=["name", "n", "kind", "family", "given", "initial", "words", "told", "acronym"])

    return names.mapInPandas(run, "name string, n bigint, kind string, family string, given string, initial string, words array<string>, told boolean, acronym string")


def organisations(read: DataFrame) -> DataFrame:
    """(name, family, initial) of the strings that name organisations: their proper word, and the initials of the
    words that describe them. read: ``readings``."""
    words = read.where("words is not null").select("name", "told", F.size("words").alias("size"), F.posexplode("words").alias("at", "w"))
    long, first, last = F.col("size") > 2, F.col("at") == 0, F.col("at") == F.col("size") - 1
    in_long = joinable(words.where(long).select("w").distinct().checkpoint())  # no other word's places matter
    words = words.join(in_long, "w", "left_semi")
    stands = words.groupBy("w").agg(F.count_if(long).alias("b"), F.count_if(~long).alias("a"), (F.bool_or(long & first) & F.bool_or(long & last)).alias("ends"))
    outer = F.col("ends") & (first | last)
    held = words.where(long).join(stands, "w").groupBy("name", "told").agg(F.array_sort(F.collect_list(F.struct("at", "w", "a", "b", outer.alias("outer")))).alias("ws"))  # the words of one string
    rare = F.array_min(F.transform("ws", lambda x: F.struct(x["b"], -x["at"], x["w"])))
    describes = lambda p: F.forall("ws", lambda x: (x["w"] == p["w"]) | ((x["b"] >= DESCRIBES * p["b"]) & (x["b"] >= 2 * x["a"]) & (x["b"] > DESCRIBES)))
    # in a small corpus the proper word is the one that stands in front of descriptions and behind them
    outer = F.filter("ws", lambda x: x["outer"])
    family = F.when(describes(rare), rare["w"]).when(F.col("told") & (F.size(outer) == 1), F.get(outer, F.lit(0))["w"])
    held = held.select("name", family.alias("family"), "ws").where("family is not null")
    held = held.select("name", "family", F.filter("ws", lambda x: x["w"] != F.col("family")).alias("ws"))
    what = F.array_join(F.transform("ws", lambda x: F.substring(x["w"], 1, 1)), "")
    full = held.where(F.size("ws") > 1).select("name", "family", what.alias("initial")).checkpoint()
    # acronyms of a description that full names have: of three letters or more, or of that very organisation
    short = read.where("acronym is not null").select("name", "family", F.col("acronym").alias("initial"))
    known = full.select("initial").distinct()
    same = full.groupBy("family", "initial").agg(F.lit(True).alias("same"))
    short = short.join(known, "initial").join(same, ["family", "initial"], "left").where("length(initial) > 2 or same")
    return full.unionByName(short.select("name", "family", "initial"))


def keyed(names: DataFrame) -> DataFrame:
    """(name, n, kind, family, given, initial) of distinct names; orders decided by the corpus. Kind is 'person' or
    'org'; given is empty where only initials are written."""
    read = readings(names).checkpoint()
    orgs = organisations(read).checkpoint()
    told = joinable(orgs)
    parsed = read.drop("words", "told", "acronym").join(told.select("name"), "name", "left_anti").where("kind <> 'none'").checkpoint()
    sure = parsed.where("kind = 'person'")
    # counts of distinct strings: a given name goes with many families
    as_given = sure.where("given <> ''").groupBy(F.col("given").alias("w")).agg(F.count("*").alias("g"))
    as_family = sure.groupBy(F.col("family").alias("w")).agg(F.count("*").alias("f"))
    rate = as_given.join(as_family, "w", "full").select("w", (F.log(F.coalesce("g", F.lit(0)) + 0.5) - F.log(F.coalesce("f", F.lit(0)) + 0.5)).alias("rate")).checkpoint()
    either = parsed.where("kind = 'either'")
    # a word met nowhere else counts as given if it is one slip from a word that is mostly given
    words = either.select(F.explode(F.array("family", "given")).alias("w")).distinct()
    frequent = rate.where("rate > 1 and (length(w) > 3 or rate > 3)").select("w", F.lit(True).alias("known"))
    unmet = words.join(rate.where("rate <> 0").select("w"), "w", "left_anti").select("w", F.lit(False).alias("known"))
    near = variants(frequent.unionByName(unmet), "w", ["w", "known"])
    meets = near.groupBy("variant").agg(F.bool_or("known").alias("some"), F.collect_set(F.when(~F.col("known"), F.col("w"))).alias("ws"))
    close = meets.where("some").select(F.explode("ws").alias("w")).distinct().select("w", F.lit(1.0).alias("rate"))
    rate = joinable(rate.join(close.select("w"), "w", "left_anti").unionByName(close).checkpoint())
    either = either.join(rate.select(F.col("w").alias("family"), F.col("rate").alias("r1")), "family", "left").join(rate.select(F.col("w").alias("given"), F.col("rate").alias("r2")), "given", "left")
    given_first = F.coalesce("r1", F.lit(0.0)) >= F.coalesce("r2", F.lit(0.0))
    either = either.select("name", "n", F.lit("person").alias("kind"), F.when(given_first, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(given_first, F.col("family")).otherwise(F.col("given")).alias("given"))
    either = either.withColumn("initial", F.substring("given", 1, 1))
    org = read.select("name", "n").join(told, "name").select("name", "n", F.lit("org").alias("kind"), "family", F.lit("").alias("given"), "initial")
    return sure.unionByName(either).unionByName(org).select("name", "n", "kind", "family", "given", "initial")


def variants(words: DataFrame, word: str, keep: list[str], block: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns ``keep`` with ``variant``, a hash of what the word has in common with words one slip apart and of
    the columns ``block``; one row for each."""
    kinds = dict(words.dtypes)

    def run(batches):
        for b in batches:
            found = [(i, v) for i, w in enumerate(b[word]) if len(w) > 1 for v in _variants(w) | _variants(loose(w))]
            rows = b.iloc[[i for i, _ in found]][[*dict.fromkeys([*keep, *block])]].reset_index(drop=True)
            yield rows.assign(_v=[v for _, v in found])

    schema = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys([*keep, *block])) + ", _v string"
    return words.mapInPandas(run, schema).select(*keep, F.xxhash64(*block, "_v").alias("variant"))


# --- the channel of slips -------------------------------------------------------------------------------------------------


def channel(pairs: DataFrame, keys: DataFrame) -> tuple[dict[str, float], float, float]:
    """(rates of the kinds of slips, log number of names, entropy of a letter), estimated from the whole corpus."""
    total = keys.agg(F.count("*").alias("names"), F.coalesce(F.sum("d"), F.lit(0)).alias("writings")).first()
    clear = pairs.where(F.col("d2") >= CLEAR * F.col("d")).groupBy("key").agg(F.min("slip").alias("slip")).groupBy("slip").count()
    count = {r["slip"]: r["count"] for r in clear.collect()}  # one row for each kind
    rates = {k: (count.get(k, 0) + 1) / (total["writings"] + 20) for k in SLIPS}
    letters = [r["count"] for r in keys.select(F.explode(F.split("family", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()]  # one for each letter
    letters = [n + LETTER for n in letters] + [LETTER] * (26 - len(letters))
    entropy = -sum(n / sum(letters) * math.log(n / sum(letters)) for n in letters)
    return rates, math.log(max(total["names"], 1)), entropy


def attributed(keys: DataFrame, estimated: tuple[dict[str, float], float, float] | None = None) -> DataFrame:
    """(key, root): every key with the key it is attached to in the end, itself if to none.

    keys: (key BIGINT, kind, family, initial, n, d), n mentions in d different writings. Candidates share kind and
    initial, are one slip away, and come before by n * d, so that no two wait for each other. estimated: what
    ``channel`` gives, to be used instead of this corpus's own.
    """
    wide = variants(keys, "family", ["key"], ["kind", "initial"])  # of one key all different
    meets = wide.groupBy("variant").agg(F.collect_list("key").alias("ks")).where("size(ks) > 1")  # words one slip apart from one word
    every = F.flatten(F.transform("ks", lambda a: F.transform(F.filter("ks", lambda b: b != a), lambda b: F.struct(a.alias("key"), b.alias("key2")))))
    pairs = meets.select(F.explode(every).alias("p")).select("p.key", "p.key2").distinct()
    side = keys.select("key", "family", "n", "d")
    side = joinable(side)
    pairs = pairs.join(side, "key").join(side.select(*(F.col(c).alias(c + "2") for c in ("key", "family", "n", "d"))), "key2")
    before = F.struct(F.col("n2") * F.col("d2"), "n2", -F.col("key2")) > F.struct(F.col("n") * F.col("d"), "n", -F.col("key"))

    def verify(batches):
        for b in batches:
            out = b.assign(slip=[slip(x, y) for x, y in zip(b["family"], b["family2"])], length=b["family"].map(len))
            yield out[out["slip"].notna()][["key", "key2", "n", "d", "n2", "d2", "slip", "length"]]

    near = pairs.where(before).mapInPandas(verify, "key bigint, key2 bigint, n bigint, d bigint, n2 bigint, d2 bigint, slip string, length int").checkpoint()
    rates, names, entropy = estimated or channel(near, keys)
    expected = F.lit(0.0)
    for kind, rate in rates.items():
        ways = F.greatest(F.lit(1.0), F.lit(1.0) * SLIPS[kind](F.col("length")))
        expected = F.when(F.col("slip") == kind, F.col("d2") * rate / ways).otherwise(expected)
    right = F.greatest(F.col("n2") / (F.col("n") + F.col("n2")), F.col("d2") / (F.col("d") + F.col("d2")))
    likelihood = F.least(F.lit(0.0), F.log(expected)) + RIGHT * F.log(right) * F.log1p("n") + AGAIN * F.greatest(F.lit(0.0), F.col("d") - 1 - SPREAD * expected)
    own = F.least(F.lit(0.0), math.log(OWN) + names - entropy * F.col("length")) + OWN_RISE * F.log("n")
    won = near.withColumn("l", likelihood).where(F.col("l") >= own)
    best = won.groupBy("key").agg(F.max_by("key2", F.struct("l", F.col("n2"), -F.col("key2"))).alias("to"))
    return rooted(keys.select("key"), best)


def rooted(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root) by following links (key, to), one at most from each key and none in a circle: every round doubles the
    way that is followed."""
    links = links.checkpoint()
    while not links.isEmpty():
        on = links.select(F.col("key").alias("to"), F.col("to").alias("next"))
        far = links.join(on, "to", "left")
        moved = far.select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("_m")).checkpoint()
        links = moved.drop("_m")
        if moved.where("_m").isEmpty():
            break
    return keys.join(links, "key", "left").select("key", F.coalesce("to", "key").alias("root"))


# --- the channel of given names ---------------------------------------------------------------------------------------------


def short_forms(held: DataFrame) -> DataFrame:
    """(given, to): the full name that a given name is a short form of.

    held: (family, initial, given) distinct, of families as they are attributed. Families with two given names of one
    initial tell: two people meet by chance as often as names meet that don't even begin alike.
    """
    of = held.groupBy("family", "initial").agg(F.count("*").alias("k"), F.min("given").alias("g1"), F.max("given").alias("g2"))
    alike = F.substring("g1", 1, 2) == F.substring("g2", 1, 2)
    total = of.agg(F.count("*").alias("families"), F.count_if((F.col("k") == 2) & ~alike).alias("chance")).first()
    if not total["families"]:
        return held.select("given", F.col("given").alias("to")).limit(0)
    meet = (total["chance"] + 1) / (total["families"] + 20)  # of a family having a second person of the initial
    pairs = of.where("k = 2").groupBy("initial", "g1", "g2").agg(F.count("*").alias("both"), F.first(alike).alias("alike"))
    having = held.groupBy("given").agg(F.count("*").alias("f"))
    share = held.groupBy("initial").agg(F.count("*").alias("all"))
    rows = pairs.join(having.select(F.col("given").alias("g1"), F.col("f").alias("f1")), "g1").join(having.select(F.col("given").alias("g2"), F.col("f").alias("f2")), "g2").join(share, "initial")
    first = (F.col("f1") > F.col("f2")) | ((F.col("f1") == F.col("f2")) & (F.length("g1") >= F.length("g2")))  # g1 is the full name
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rows = rows.select(pick("g2", "g1").alias("given"), pick("g1", "g2").alias("to"), "both", "alike", "all", pick("f2", "f1").alias("f"), pick("f1", "f2").alias("f_to"))
    shortens = (F.col("both") - 1 + F.when(F.col("alike"), 1 + BEGIN).otherwise(0.0)) / (F.col("f_to") + 1)
    chance = meet * F.col("f") / F.col("all")
    return rows.where(shortens > chance).groupBy("given").agg(F.max_by("to", F.struct(F.col("both"), F.col("f_to"), "to")).alias("to"))


def people(persons: DataFrame) -> DataFrame:
    """(name, entity) of persons, (name, n, family, initial, given) with attributed family and given names."""
    every = persons.groupBy("family", "initial", "given").agg(F.sum("n").alias("n"))
    held = every.where("given <> ''").select("family", "initial", "given", "n", F.xxhash64("family", "initial", "given").alias("key")).checkpoint()
    forms = short_forms(held.select("family", "initial", "given"))
    targets = held.select("family", "initial", F.col("given").alias("to"), F.col("key").alias("to_key"))
    links = held.join(forms, "given").join(targets, ["family", "initial", "to"]).select("key", F.col("to_key").alias("to"))
    roots = held.join(rooted(held.select("key"), links), "key")
    clusters = roots.groupBy("family", "initial", "root").agg(F.sum("n").alias("n"))
    likeliest = joinable(clusters.groupBy("family", "initial").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("most")).checkpoint())
    of = joinable(roots.select("family", "initial", "given", "root").checkpoint())
    out = persons.join(of, ["family", "initial", "given"], "left").join(likeliest, ["family", "initial"], "left")
    return out.select("name", F.coalesce("root", "most", F.xxhash64("family", "initial")).alias("entity"))


def entities(names: DataFrame) -> DataFrame:
    """(name, entity) of every distinct string in the column ``name`` that names somebody; entity is a number."""
    shared_checkpoints(names.sparkSession)
    counts = names.select("name").where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    of = keyed(counts).checkpoint()
    number = lambda *c: F.xxhash64(*c)
    families = of.groupBy("kind", "initial", "family").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    given = of.where("given <> ''").groupBy(F.lit("given").alias("kind"), "initial", F.col("given").alias("family")).agg(F.sum("n").alias("n"), F.count_distinct("family").alias("d"))
    keys = families.unionByName(given).select(number("kind", "initial", "family").alias("key"), "kind", "initial", "family", "n", "d").checkpoint()
    root = attributed(keys)
    as_family = joinable(root.select(F.col("key").alias("k1"), F.col("root").alias("r1")).checkpoint())
    as_given = joinable(root.join(keys.where("kind = 'given'").select(F.col("key").alias("root"), F.col("family").alias("g")), "root").select(F.col("key").alias("k2"), "g").checkpoint())
    rows = of.select("name", "n", "kind", "initial", "given", number("kind", "initial", "family").alias("k1"), F.when(F.col("given") != "", number(F.lit("given"), "initial", "given")).alias("k2"))
    rows = rows.join(as_family, "k1").join(as_given, "k2", "left").select("name", "n", "kind", "initial", F.col("r1").alias("family"), F.coalesce("g", F.lit("")).alias("given")).checkpoint()
    orgs = rows.where("kind = 'org'").select("name", F.col("family").alias("entity"))
    return people(rows.where("kind = 'person'").drop("kind")).unionByName(orgs)


def linked_pairs(entity: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points, of the strings of each entity."""
    a = entity.select("entity", F.col("name").alias("name_a"))
    b = entity.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
