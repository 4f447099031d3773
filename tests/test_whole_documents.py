"""Documents are resolved as a whole, however long they are."""

import copy
import json
import random

from spagyric.operators import resolve as R
from spagyric.spec import models as M


def brute(rows):
    """All pairs, step by step."""
    rows = sorted(rows, key=lambda r: r.at)
    names = [r for r in rows if r.model.name == "Compound"]
    by_key, parent = {}, list(range(len(names)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, r in enumerate(names):
        for key in [*("n" + x for x in r.data.get("names", ())), *("l" + x for x in r.data.get("labels", ()))]:
            j = root(by_key.setdefault(key, i))
            if j != root(i) and not R.clashing(names[j].data, names[root(i)].data):
                a, b = sorted((j, root(i)))
                names[a].data = R.united(names[a].data, names[b].data)
                parent[b] = a
    gone = {id(names[i]) for i in range(len(names)) if root(i) != i}
    rows = [r for r in rows if id(r) not in gone]
    for r in rows:
        if r.model.contextual_fulfilled(r.data):
            continue
        for o in sorted((o for o in rows if o is not r), key=lambda o: (R.distance(r, o).counts(), abs(o.at[2] - r.at[2]) / (o.sureness() + 0.01) if o.at[:2] == r.at[:2] else 0.0, o.at > r.at, [-x for x in o.at] if o.at < r.at else list(o.at))):
            R.merge_contextual(r, o, R.distance(r, o))
            if r.model.contextual_fulfilled(r.data):
                break
    out = []
    for r in rows:
        if r.model.is_empty(r.data) or not r.model.required_fulfilled(r.data):
            continue
        twin = next((i for i, o in enumerate(out) if o.model is r.model and (o.model.is_superset(o.data, r.data) or o.model.is_superset(r.data, o.data))), None)
        if twin is None:
            out.append(r)
        elif not out[twin].model.is_superset(out[twin].data, r.data):
            out[twin].data = r.data
    return out


NEAR = M.MELTING_POINT.extend("Near", M.Field("solvent", contextual=True, contextual_range=2 * M.PARAGRAPH), M.Field("compound", M.COMPOUND, contextual=True, contextual_range=M.SECTION), no_merge_range=1 * M.SENTENCE)


def some(rng, n, wild):
    pick = lambda *x: rng.choice(x)
    compound = lambda: {k: v for k, v in {"names": sorted({pick(*"abcdefgh") for _ in range(rng.randint(0, 2))}), "labels": [pick(*"123")] if rng.random() < 0.4 else [], "roles": ["r"] if rng.random() < 0.1 else []}.items() if v}
    rows = []
    for _ in range(n):
        el = rng.randint(0, 12)
        at, section = (el, rng.randint(-1, 3), rng.randint(0, 2)), rng.randint(0, 3) if wild else el // 4
        model = pick(M.COMPOUND, M.COMPOUND, M.APPARATUS, M.MELTING_POINT, NEAR, M.NMR_SPECTRUM)
        if model is M.COMPOUND:
            data = compound()
        elif model is M.APPARATUS:
            data = {"name": pick("A", "B", "")}
        else:
            data = {"solvent": pick("s", "t", None, None), "temperature": pick("1", None), "compound": pick(compound(), None), "concentration": pick("5", None, None)}
            data |= {"nucleus": pick("1H", "13C"), "frequency": pick("400", None), "peaks": pick([], [{"shift": pick("1", "2")}])} if model is M.NMR_SPECTRUM else {"raw_value": pick("1", "2", "3", None), "raw_units": pick("K", "C", None), "specifier": pick("mp", "mp", None), "value": pick([1.0], [1.0, 2.0], None)}
            data = {k: v for k, v in data.items() if v is not None and k in {f.name for f in model.fields}}
        rows.append(R.Record(model, data, at, "x", {"record": pick(0.2, 0.7, 1.0)}, section))
    return rows


def test_indexes_give_what_all_pairs_give():
    rng = random.Random(5)
    for k in range(300):
        rows = some(rng, rng.choice([3, 12, 60]), k % 3 == 0)
        show = lambda out: [(r.model.name, r.at, json.dumps(r.data, sort_keys=True)) for r in out]
        assert show(R.resolve_document(copy.deepcopy(rows, {id(m): m for m in (NEAR, *M.BUILT_IN.values())}))) == show(brute(rows))


def test_a_long_document_is_one(spark):
    found = [(1, e, 0, 0, "Compound", "x", json.dumps({"names": [f"n{e}"]}), {}) for e in range(7000)]
    ends = {0: {"names": ["n0"], "labels": ["1"]}, 6999: {"names": ["n0"]}, 6998: {"names": ["n6998"], "labels": ["1"]}}
    found = [(*r[:6], json.dumps(ends.get(r[1], json.loads(r[6]))), r[7]) for r in found]
    found += [(1, 7000 + e, 0, 0, "MeltingPoint", "x", json.dumps({"raw_value": "1", "raw_units": "K", "specifier": "mp", "compound": {"names": ["n5"]}}), {}) for e in (0, 9)]
    found += [(1, 2, 1, 0, "MeltingPoint", "x", json.dumps({"raw_value": "1", "raw_units": "K", "specifier": "mp", "solvent": "w", "compound": {"names": ["n5"]}}), {})]
    df = spark.createDataFrame(found, "doc_id bigint, el_idx int, sent_idx int, rec_idx int, model string, method string, payload string, confidence map<string,double>").repartition(3)
    out = [(r.model, r.el_idx, json.loads(r.payload)) for r in R.resolve(df, [M.MELTING_POINT, M.COMPOUND]).collect()]
    assert len([x for x in out if x[0] == "Compound"]) == 6998
    assert ("Compound", 0, {"names": ["n0", "n6998"], "labels": ["1"]}) in out
    assert [(e, d["solvent"]) for m, e, d in out if m == "MeltingPoint"] == [(2, "w")]
