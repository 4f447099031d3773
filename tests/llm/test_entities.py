"""Components, survivors, canonical values, names and mixtures."""

import random
from collections import Counter
from datetime import datetime
from itertools import product

import pytest

from spagyric.llm import canonical as C
from spagyric.llm import mixture as X
from spagyric.llm import names as N
from spagyric.llm import survivors as V
from spagyric.llm.graph import components
from spagyric.session import shared_checkpoints, table


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (5, 5)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_branch_and_bound_against_all_choices():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 6)
        cs = [{"key": (random.randint(1, 3), random.randint(1, 3), i), "fills": {b for b in "abc" if random.random() < 0.6}} for i in range(n)]
        together = (("a", "b"),) if random.random() < 0.5 else ()
        rank = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: cs[i]["key"]))}
        open_ = [b for b in "abc" if any(b in c["fills"] for c in cs)]

        def cost(choice, cs=cs, rank=rank, together=together):
            taken = {b: i for b, i in choice.items() if i is not None}
            if any(b not in cs[i]["fills"] for b, i in taken.items()) or any(x in taken and y in taken and taken[x] != taken[y] for x, y in together):
                return None
            return len(choice) - len(taken), sum(rank[i] for i in taken.values())

        best = min(c for combo in product([None, *range(n)], repeat=len(open_)) if (c := cost(dict(zip(open_, combo)))) is not None)
        taken = V.choose(cs, tuple("abc"), together)
        assert cost({b: taken.get(b) for b in open_}) == best


MP = "rec_id bigint, doc_id bigint, el_idx int, sent_idx int, method string, raw_value string, raw_units string, specifier string, compound struct<names: array<string>, labels: array<string>, roles: array<string>>, solvent string, apparatus string, extracted_at timestamp, trust string, low string"


def test_survivors(spark):
    t = datetime(2024, 1, 1)
    late = datetime(2024, 1, 2)
    c = lambda n=None, lab=None: (n, lab, None)
    mp = spark.createDataFrame(
        [
            (1, 1, 0, 0, "b", "150", "°C", "mp", c(["X​"]), "n/a", None, t, "t", "l"),
            (2, 1, 0, 0, "a", "423.15", "K", "mp", c(["x"], ["1"]), "unknown", " ", t, None, None),
            (3, 1, 0, 0, None, "150–151", "°C", "mp", c(["-"], ["1"]), "DMF", "A", late, None, None),
            (4, 1, 0, 0, "a", "160", "°C", "mp", c(["x"]), "THF", None, t, None, None),
            (5, 2, 0, 0, "a", "150", "°C", "mp", c(["x"]), None, None, t, None, None),
            (6, 1, 0, 0, "a", "150", None, "mp", c(["x"]), None, None, t, None, None),
            (7, 1, 0, 0, "a", "150", "°C", "mp", None, None, None, None, None, None),
            (8, None, 0, 0, "a", "150", "°C", "mp", c(["x"]), None, None, t, None, None),
            (9, None, None, None, None, None, None, None, None, None, None, None, None, None),
        ],
        MP,
    )
    mp = mp.unionByName(mp)
    sent = spark.createDataFrame([], "doc_id bigint, el_idx int, sent_idx int, text string")
    trust = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "method string, trust int")
    got = {tuple(r) for r in V.survivors(mp, sent, trust).collect()}
    assert got == {(1, "quantity", 2), (1, "names", 2), (1, "labels", 2), (1, "solvent", 3), (1, "apparatus", 3)}
    assert V.survivors(mp.limit(0), sent, trust).count() == 0


def test_dependency_changes_the_choice(spark):
    """The most trusted record has a value without a unit: value and unit come from the one that has both."""
    bit = {f: 1 << i for i, f in enumerate(V.FIELDS)}
    rows = [(1, [{"fills": bit["raw_value"] | bit["names"], "key": (1, 0, 1)}, {"fills": bit["raw_value"] | bit["raw_units"], "key": (2, 0, 2)}, {"fills": bit["raw_units"], "key": (3, 0, 3)}])]
    few = spark.createDataFrame(rows, "first_rec_id bigint, candidates array<struct<fills: int, key: struct<t: int, e: bigint, r: bigint>>>")
    fields = lambda together: {r.field: r.rec_id for r in V.chosen(few, together).collect()}
    assert fields(V.DEPENDENT) == {"quantity": 2, "names": 1}
    assert fields(()) == {"quantity": 1, "names": 1}  # without the dependency the value has no unit


def test_large_documents_are_grouped_alike(spark):
    """Below and above the size up to which a document is grouped in one row."""
    random.seed(11)
    rows = [(d, 1000 * d + i, low := round(random.uniform(300, 330), 1), round(low + random.choice([0, 0, 0, 0.4, 3]), 1), random.sample(range(6), random.randint(1, 2))) for d in (1, 2) for i in range(90)]
    points = spark.createDataFrame([*rows, *rows[:20]], "doc_id bigint, rec_id bigint, low double, high double, tokens array<bigint>")
    shared_checkpoints(spark)
    local, spread = ({(r.rec_id, r.first_rec_id) for r in V.duplicate_groups(points, most).collect()} for most in (10_000, 5))
    assert local == spread and len(local) > 50


def test_statements_against_all_pairs(spark):
    random.seed(7)
    pts = [(1, random.choice("ab"), i, low := round(random.uniform(300, 306), 1), round(low + random.choice([0, 0, 0.5, 2]), 1)) for i in range(120)]
    shared_checkpoints(spark)
    edges = V.same_statement(spark.createDataFrame(pts, "doc_id bigint, token string, rec_id bigint, low double, high double"))
    got = {r.node: r.component for r in components(edges).collect()}
    parent = {p[2]: p[2] for p in pts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in pts:
        for b in pts:
            if a[1] == b[1] and abs(a[3] - b[3]) <= 1 + 1e-6 and abs(a[4] - b[4]) <= 1 + 1e-6:
                x, y = sorted((root(a[2]), root(b[2])))
                parent[y] = x
    assert {x: root(x) for x in parent} == {p[2]: got.get(p[2], p[2]) for p in pts}


CASES = {
    "CDCl3": 1, "CDCl₃": 1, "cdcl3": 1, "CDCl 3": 1, "deuterochlo.": 1, "deuterated chl.": 1, "anhydrous DMSO-d6": 2, "DMSO d6": 2, "dimethyl slfoxide": 20, "(methylene chloride)": 15,
    "((CD3)2SO)": 2, "mthanol": 17, "isiopnopanol": 31, "1,4-diioxaie": 28, "hetvy wter": 4, "methyl a.": 17, "C4H8O2": 0, "THF/water": 0, "CDCl3 and D2O (1:1)": 0, "THF-d8 : THF 9:1": 0,
    "nepholamide-d9": 0, "neat": 0, "": 0, "  ": 0, "??": 0, "x" * 20_000: 0, "chloro.": 0, "in water": 29, "acetone-d6, 298 K": 5, "abs. ethanol": 18, "freshly distilled THF": 22,
}


def test_canonical_values(spark, sf):
    recs = [(i, v, "x") for i, v in enumerate([*CASES, None, "chloroform-d"])]
    df = spark.createDataFrame(recs + recs, "rec_id bigint, solvent string, value string")
    got = {r.rec_id: r.solvent_id for r in C.solvent_mapping(df, table(spark, sf, "solvents")).collect()}
    assert got == {i: n for i, n in enumerate(CASES.values())}
    assert C.solvent_mapping(df.limit(0), table(spark, sf, "solvents")).count() == 0


def test_canonical_values_are_ranked(spark):
    """Entries are ranked by their corrected tokens; a reordered value is no further off, and one that two
    entries cover as well denotes neither."""
    forms = spark.createDataFrame([(1, ["dimethyl sulfoxide-d6"]), (2, ["dimethyl sulfoxide"]), (3, ["diethyl ether", "ether"]), (4, ["ethanol"]), (5, ["methanol"]), (6, ["heavy water"]), (7, [None, " "])], "number int, forms array<string>")
    cases = {"d6-dimethyl sulfoxide": 1, "dimetyl sulfoxyde": 2, "dimethylsulfoxide": 2, "ether": 3, "ethano": 4, "heay watr": 6, "methanol ethanol": 0, "ethanol / ether": 0, "dimethyl": 0, "dimeth.": 0, "dimethyl sulfoxide-": 2, "Xthanol": 4}
    got = {r.value: r.entry for r in C.map_values(spark.createDataFrame([(v,) for v in cases], "value string"), forms, "number", "forms").collect()}
    assert got == cases


@pytest.mark.parametrize(
    "name,key",
    [
        ("Gororáduban, Leonhard K.", ("person", "gororaduban", "leonhard", "l")), ("ME Konilubufic", ("person", "konilubufic", "", "m")), ("Mutoefiholen, Gregory", ("person", "mutoefiholen", "gregory", "g")),
        ("van der Rifusimuman EA", ("person", "rifusimuman", "", "e")), ("Margarethe De Bogírililica,b", ("person", "bogirililic", "margarethe", "m")), ("Dr. Nathaniel Disamoliler", ("either", "nathaniel", "disamoliler", "")),
        ("et al.", None), ("", None), ("  ", None), ("J. F. Gohohefiter", ("person", "gohohefiter", "", "j")), ("L.K.Gororaduban (1)", ("person", "gororaduban", "", "l")),
    ],
)
def test_parsed_names(name, key):
    assert N.parse(name) == key


def test_organisations_are_learned(spark):
    """No word is known to describe organisations; those do that stand in many long strings and beside many words."""
    what = ["Spectroscopy Consortium", "Institute of Materials Research", "Collaboration on Solid Solutions"]
    names = [f"{p} {what[i % 3]}" for i, p in enumerate("Dobudohanen Sekugogokos Belofetiros Kutilefiben Turehusufos Gukimutafos Feremenibic Vasadotefan Gomaburiner Nohuhimidic Mekokomeser Rududenasen".split())] + ["The Sekugogokos Institute of Materials Research", "Belofetiros CSS", "Dobudohanen SC", "Rana SC"]
    names += [f"{a} {b} {c}" for a in ("Mary", "Ann") for b in ("Jane", "Lou") for c in ("Smith", "Jones")] + ["Mary Smith", "Jane Jones", "Ann Smith", "Lou Jones", "Smith, Mary", "Jones, Ann"] * 3
    got = {r.name: (r.family, r.initial) for r in N.organisations(N.readings(spark.createDataFrame([(n, 1) for n in set(names)], "name string, n bigint"))).collect()}
    assert got["Dobudohanen Spectroscopy Consortium"] == got["Dobudohanen SC"] == ("dobudohanen", "sc")
    assert got["The Sekugogokos Institute of Materials Research"] == ("sekugogokos", "imr") and got["Belofetiros CSS"] == ("belofetiros", "css")
    assert not any(n.startswith(("Mary", "Ann", "Rana")) for n in got)


def test_given_names_tell_people_apart(spark):
    """Different given names are different people; initials go to the likelier one; short forms are learned from the
    families that have both forms; with other parameters the channel decides otherwise."""
    rows = ["Smith, Jane"] * 5 + ["Jane Smith"] * 3 + ["Smith, John"] * 2 + ["Smith, J."] + ["Jonh Smith"]
    rows += [f"{f}, {g}" for f in ("Brown", "Cooper", "Taylor", "Walker", "Miller") for g in ("Margaret", "Peggy", "Maggie")]
    rows += [f"Porter{i}, {g}" for i in range(30) for g in (("Mary",) if i % 2 else ("Jane",))]
    got = {r.name: r.entity for r in N.entities(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert got["Smith, Jane"] == got["Jane Smith"] == got["Smith, J."] != got["Smith, John"] == got["Jonh Smith"]
    assert all(got[f"{f}, Margaret"] == got[f"{f}, Maggie"] != got[f"{f}, Peggy"] for f in ("Brown", "Walker"))


def test_channel_decides(spark):
    keys = spark.createDataFrame([(1, "person", "marunefehen", "a", 50, 20), (2, "person", "marunfehen", "a", 2, 1), (3, "person", "marunefehan", "a", 40, 18)], "key bigint, kind string, family string, initial string, n bigint, d bigint")
    root = lambda *e: {r.key: r.root for r in N.attributed(keys, e).collect()}
    rates = dict.fromkeys(N.SLIPS, 0.05)
    assert root(rates, 1.0, 2.5) == {1: 1, 2: 1, 3: 3}
    assert root(dict.fromkeys(N.SLIPS, 1e-14), 1.0, 2.5) == {1: 1, 2: 2, 3: 3}
    assert root(rates, 20.0, 0.1) == {1: 1, 2: 2, 3: 3}


def test_linked_names(spark):
    person = ["Gororáduban, Leonhard K.", "Gororáduban L", "Leonhard Gororáduban", "Gororaduban, L.", "GORNRÁDUBAN, Leonhard", "L. K. Gororaduban", "Gororaaduban, L.", "Gororáduban Leonhard†", "Leo Gororáduban, PhD"]
    other = ["Gororáduban, Isidore", "I. Gororáduban"]
    given = ["Disamoliler, Leonhard", "Bovanifaken, Leonhard", "Sakabamefan, Isidore"]
    org = ["Kihatos Laboratory for Crystal Chemistry", "Lab. Cryst. Chem. Kihatos", "KIHATOS LABORATORY FOR CRYSTAL CHEMISTRY", "Kihatos LCC"]
    rows = [(n, 1) for n in [*person * 3, *other, *given * 2, *org, None, "", "et al.", "x" * 5000]]
    pairs = {tuple(r) for r in N.linked_pairs(N.entities(spark.createDataFrame(rows, "name string, entity int"))).collect()}
    want = {(a, b) for group in (person, other, org) for a in group for b in group if a < b}
    assert pairs == want
    assert N.entities(spark.createDataFrame([], "name string")).count() == 0


def test_flow_against_shares():
    flows = X.route({("a",): 100.0, ("a", "b"): 300.0, ("b", "c"): 50.0, ("c",): 10.0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 2, "b": 3, "c": 4, "d": 1})
    by = {s: sum(n for (p, x), n in flows.items() if x == s) for s in "abc"}
    total = sum(by.values())
    assert {s: round(n / total, 6) for s, n in by.items()} == {"a": 0.5, "b": 0.3, "c": 0.2}
    assert X.route({}, {"a": 1.0}, {"a": 1}) == {}


def test_mixture(spark):
    random.seed(3)
    docs = [(i, random.choice(["a", "a", "a", "b", "c", None, "z"]), random.randint(0, 40)) for i in range(4000)]
    counts = spark.createDataFrame([d for d in docs if d[1]], "doc_id bigint, source string, n_tokens bigint")
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("d", 0.0, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = X.mixture(counts, weights, per_bucket=50).cache()
    got = {r.source: r for r in X.shares(mixed, weights.where("source is not null")).collect()}
    assert {s: round(got[s].actual_share, 2) for s in "abcd"} == {"a": 0.3, "b": 0.5, "c": 0.2, "d": 0.0}
    assert got["a"].most_copies <= 1 and got["b"].most_copies <= 3 and got["c"].most_copies <= 2
    size = {d[0]: d for d in docs}
    assert all(size[r.doc_id][1] == r.source and size[r.doc_id][2] == r.n_tokens > 0 for r in mixed.collect())
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    again = X.mixture(counts.repartition(7), weights, per_bucket=50)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mixed.collect()}
    assert X.mixture(counts.limit(0), weights).count() == 0


def test_frequent_names_stay_themselves(spark):
    forms = lambda f: [f"{f}, Jan", f"{f} J", f"J. {f}", f"{f}, J."]
    rows = [x for f, n in (("Hansen", 125), ("Jansen", 100), ("Janser", 90), ("Mayer", 125), ("Meyer", 100)) for x in forms(f) * n]
    rows += ["Hannsen, J."] * 3 + ["Mayre, Jan"] + ["Sandor, K."] * 500 + ["Sander, K."] * 400
    got = {r.name: r.entity for r in N.entities(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    groups = [[*forms("Hansen"), "Hannsen, J."], forms("Jansen"), forms("Janser"), [*forms("Mayer"), "Mayre, Jan"], forms("Meyer"), ["Sandor, K."], ["Sander, K."]]
    assert sorted(map(sorted, groups)) == sorted(sorted(n for n in got if got[n] == e) for e in set(got.values()))


def test_short_and_long_families(spark):
    long = "ab" * 40
    groups = [["Wang, L.", "Wan, L."], ["Kim, S.", "Kin, S."], ["Lee, S."], [f"{long}c, T.", f"{long[:9]}x{long[9:]}c, T.", f"{long[:70]}{long[71:]}c, T."], ["Li, X."], ["Bo, X."]]
    rows = [(n,) for g in groups for i, n in enumerate(g) for _ in range(1 if i else 30)]
    got = {r.name: r.entity for r in N.entities(spark.createDataFrame(rows, "name string")).collect()}
    assert sorted(map(sorted, groups)) == sorted(sorted(n for n in got if got[n] == e) for e in set(got.values()))


def test_flow_whatever_the_order_of_patterns():
    capacity = {("a",): 60.0, ("a", "b"): 90.0, ("b",): 50.0, ("b", "c"): 70.0, ("c",): 40.0}
    args = {"a": 0.25, "b": 0.25, "c": 0.5}, {"a": 2, "b": 2, "c": 2}
    want = X.route(capacity, *args)
    for seed in range(20):
        order = random.Random(seed).sample(sorted(capacity), len(capacity))
        assert X.route({p: capacity[p] for p in order}, *args) == want


def test_fill_within_repeats():
    sizes, patterns, used = [900, 30, 20, 10], [("a", "b")] * 3 + [("b",)], [[0, 0], [0, 0], [0, 0], [0]]
    assert X.fill(sizes, patterns, used, {"a": 50, "b": 95}, {"a": 1, "b": 2}) == {"a": 0, "b": 25}
    assert used == [[0, 0], [1, 1], [1, 1], [2]]
    assert X.fill([900], [("a",)], [[0]], {"a": 100}, {"a": 1}, 200) == {"a": 100}
    assert X.fill([900], [("a",)], [[0]], {"a": 100}, {"a": 1}, 50) == {"a": -800}


def test_large_documents_and_shared_ones_in_mixture(spark):
    """A document larger than its source's quota neither takes the place of others nor leaves a gap."""
    rng = random.Random(5)
    of = {"a": ["a"], "b": ["b"], "c": ["c"], "ab": ["a", "b"], "bc": ["b", "c"]}
    docs = [(i, of[rng.choice(sorted(of))], rng.randint(5, 60)) for i in range(600)] + [(1000 + i, [s], 6000) for i, s in enumerate("abc")]
    counts = spark.createDataFrame(docs, "doc_id bigint, sources array<string>, n_tokens bigint").cache()
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    size = {d[0]: d for d in docs}
    for seed, per_bucket in ((0, 20), (1, 20), (2, 5000)):
        mixed = X.mixture(counts, weights, seed, per_bucket).collect()
        total = sum(r.n_tokens * r.copies for r in mixed)
        off = {s: abs(sum(r.n_tokens * r.copies for r in mixed if r.source == s) - w * total) for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))}
        assert max(off.values()) <= 60 and total > 20_000, (seed, per_bucket, off, total)
        assert len({(r.doc_id, r.source) for r in mixed}) == len(mixed)
        assert all(r.source in size[r.doc_id][1] and r.n_tokens == size[r.doc_id][2] and r.copies <= {"a": 2, "b": 2, "c": 1}[r.source] for r in mixed)
        copies = Counter()
        for r in mixed:
            copies[r.doc_id] += r.copies
        assert all(n <= max({"a": 2, "b": 2, "c": 1}[s] for s in size[i][1]) for i, n in copies.items())
    even = spark.createDataFrame([(i, ["ab"[i % 2]], 10) for i in range(40)], "doc_id bigint, sources array<string>, n_tokens bigint")
    got = X.mixture(even, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], weights.schema)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == [(i, 1) for i in range(40)]
