"""Records of one document merged, completed and cleaned.

The order in which records take fields from each other matters, so documents are resolved one by one, from sorted
partitions, always whole: what is held at once are the records of one document, whose text was one value when it was
read. Indexes keep the steps from comparing all pairs. Records without a document are left out. Single steps that don't depend on order (headings carried forward, subsets removed, compounds united)
are Catalyst plans of their own.

Order: (el_idx, sent_idx, rec_idx). A record takes a missing contextual field from the nearest compatible record
within the field's range, back before forward.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spagyric.spec.models import PARAGRAPH, SECTION, SENTENCE, Model, Range, beyond, within


class Record:
    __slots__ = ("model", "data", "at", "method", "confidence", "section", "element")

    def __init__(self, model: Model, data: dict, at: tuple[int, int, int], method: str, confidence: dict, section: int, element: str | None = None):
        self.model, self.data, self.at, self.method, self.confidence, self.section, self.element = model, data, at, method, confidence, section, element

    def sureness(self) -> float:
        return min((x for x in (self.confidence or {}).values() if x is not None), default=1.0)

    def lower(self, other: "Record") -> None:
        """Keeps the lower confidence of each kind: a record is as sure as the least sure one it was made from."""
        own, new = self.confidence or {}, other.confidence or {}
        self.confidence = {k: min(x for x in (own.get(k), new.get(k)) if x is not None) for k in {**own, **new} if own.get(k) is not None or new.get(k) is not None}


def distance(a: Record, b: Record) -> Range:
    """0 in one sentence, else sentences in one element, paragraphs in one section, and sections."""
    if a.at[0] == b.at[0]:
        return abs(a.at[1] - b.at[1]) * SENTENCE
    return abs(a.section - b.section) * SECTION + abs(a.at[0] - b.at[0]) * PARAGRAPH


def same_compound(a: dict | None, b: dict | None) -> bool:
    return bool(a and b and (set(a.get("names", ())) & set(b.get("names", ())) or set(a.get("labels", ())) & set(b.get("labels", ()))))


def united(a: dict, b: dict) -> dict:
    """The union of two compounds."""
    return {k: sorted({*a.get(k, ()), *b.get(k, ())}) for k in ("names", "labels", "roles") if a.get(k) or b.get(k)}


def clashing(a: dict, b: dict) -> bool:
    """Different labels: not one compound, whatever the names."""
    x, y = set(a.get("labels", ())), set(b.get("labels", ()))
    return bool(x and y and not x & y)


def compatible(model: Model, a: dict, b: dict) -> bool:
    for f in model.fields:
        x, y = a.get(f.name), b.get(f.name)
        if f.is_empty(x) or f.is_empty(y) or f.ignore_when_merging:
            continue
        if f.name == "compound":
            if not same_compound(x, y):
                return False
        elif f.binding:
            if not bound(f, x, y):
                return False
        elif x != y:
            return False
    return True


def bound(f, x, y) -> bool:
    """Whether two values of a binding field agree: one says all that the other says."""
    if isinstance(f.kind, Model):
        return f.kind.is_superset(x, y) or f.kind.is_superset(y, x)
    if isinstance(f.kind, tuple) and not isinstance(f.kind[1], Model):
        return set(x) <= set(y) or set(y) <= set(x)
    return x == y


def consolidated(model: Model, data: dict) -> None:
    """A binding field holds for all below a record: nested records of the same field take its fuller value."""
    for f in model.fields:
        value = data.get(f.name)
        if not f.binding or f.is_empty(value):
            continue
        for g in model.fields:
            inner = data.get(g.name)
            if g is not f and isinstance(g.kind, Model) and isinstance(inner, dict):
                same = next((h for h in g.kind.fields if h.name == f.name), None)
                if same is not None and (same.is_empty(inner.get(f.name)) or bound(f, value, inner[f.name])):
                    inner[f.name] = value


def merge_all(into: Record, other: Record) -> bool:
    """Fills every field of a record that is missing and that another, compatible record of its model has, contextual or
    not, whatever the distance; whether any was."""
    if other.model.name != into.model.name or not compatible(into.model, into.data, other.data):
        return False
    changed = False
    for f in into.model.fields:
        if not f.never_merge and f.is_empty(into.data.get(f.name)) and not f.is_empty(other.data.get(f.name)):
            into.data[f.name] = other.data[f.name]
            changed = True
        elif f.name == "compound" and same_compound(into.data.get(f.name), other.data.get(f.name)):
            new = united(into.data[f.name], other.data[f.name])
            changed |= new != into.data[f.name]
            into.data[f.name] = new
    if changed:
        into.lower(other)
        consolidated(into.model, into.data)
    return changed


def merge_contextual(into: Record, other: Record, d: Range) -> bool:
    """Fills the contextual fields of a record that are missing and near enough in another; whether any was."""
    changed = _merge_contextual(into, other, d)
    if changed:
        into.lower(other)
        consolidated(into.model, into.data)
    return changed


def _merge_contextual(into: Record, other: Record, d: Range) -> bool:
    if not beyond(d, into.model.no_merge_range) and d.counts() != (0, 0, 0, 0):
        return False
    changed = False
    if other.model.name == into.model.name:
        if not compatible(into.model, into.data, other.data):
            return False
        for f in into.model.fields:
            if f.contextual and not f.never_merge and f.is_empty(into.data.get(f.name)) and not f.is_empty(other.data.get(f.name)) and within(d, f.contextual_range):
                into.data[f.name] = other.data[f.name]
                changed = True
        return changed
    for f in into.model.fields:  # a record of a field's own model
        if isinstance(f.kind, Model) and f.kind.name == other.model.name and f.contextual and within(d, f.contextual_range):
            if f.is_empty(into.data.get(f.name)):
                into.data[f.name] = dict(other.data)
                changed = True
            elif f.name == "compound" and same_compound(into.data[f.name], other.data) and not clashing(into.data[f.name], other.data):
                new = united(into.data[f.name], other.data)
                changed |= new != into.data[f.name]
                into.data[f.name] = new
    return changed


def resolve_document(rows: list[Record], definitions: dict[str, list[str]] | list[tuple[str, str]] | None = None) -> list[Record]:
    """Compounds united, abbreviations added, contexts merged from near to far, then clean and distinct."""
    rows = sorted(rows, key=lambda r: r.at)
    names = [r for r in rows if r.model.name == "Compound"]
    forms: dict[str, set[str]] = {}
    for short, long in definitions.items() if isinstance(definitions, dict) else definitions or ():
        long = " ".join(long) if isinstance(long, list) else long
        for a, b in ((short, long), (long, short)):
            forms.setdefault(a, set()).add(b)
    for r in names if forms else ():  # names and their abbreviations
        own = set(r.data.get("names", ()))
        new = own.union(*(forms.get(x, ()) for x in own))
        if new != own:
            r.data["names"] = sorted(new)
    by_key: dict[str, int] = {}
    parent = list(range(len(names)))
    held = [{k: set(r.data.get(k, ())) for k in ("names", "labels", "roles")} for r in names]  # of roots

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, r in enumerate(names):
        for key in _keys(r.data):
            j = root(by_key.setdefault(key, i))
            if j != root(i) and not clashing(held[j], held[root(i)]):
                a, b = sorted((j, root(i)))
                for k, x in held[a].items():  # the smaller set into the larger
                    small, large = sorted((x, held[b][k]), key=len)
                    large |= small
                    held[a][k] = large
                parent[b] = a
    for a in {root(i) for i in range(len(names)) if root(i) != i}:
        names[a].data = {k: sorted(x) for k, x in held[a].items() if x}
    kept = {id(names[i]) for i in range(len(names)) if root(i) == i}
    rows = [r for r in rows if r.model.name != "Compound" or id(r) in kept]
    inherited(rows)
    contexts = _Contexts(rows)
    for i, r in enumerate(rows):
        if not r.model.contextual_fulfilled(r.data):
            contexts.fill(i)
    out: list[Record] = []
    twins = _Twins()
    for r in rows:
        if r.model.is_empty(r.data) or not r.model.required_fulfilled(r.data):
            continue
        twin = next((i for i in twins.near(r.model, r.data) if r.model.is_superset(out[i].data, r.data) or r.model.is_superset(r.data, out[i].data)), None)
        if twin is None:
            twins.add(len(out), r.model, r.data)
            out.append(r)
        elif not out[twin].model.is_superset(out[twin].data, r.data):
            out[twin].data = r.data
            twins.add(twin, r.model, r.data)
    return out


def inherited(rows: list[Record]) -> None:
    """Records without a compound, and without one in their own sentence, take the one their section's heading names, else
    the product that the section names last before them; a document's title stands in for a heading in front of the first.
    Only a heading with one compound tells which it is."""
    named = [r for r in rows if r.model.name == "Compound" and (r.data.get("names") or r.data.get("labels"))]
    if not named or not any(r.element for r in named):
        return
    heads: dict[int, list[Record]] = {}
    product: dict[int, list[Record]] = {}
    spoken = {r.at[:2] for r in named}
    for r in named:
        if r.element in ("Heading", "Title"):
            heads.setdefault(r.section, []).append(r)
        elif "product" in r.data.get("roles", ()):
            product.setdefault(r.section, []).append(r)
    for r in rows:
        f = next((f for f in r.model.fields if f.name == "compound" and f.contextual and isinstance(f.kind, Model)), None)
        if f is None or not f.is_empty(r.data.get("compound")) or r.at[:2] in spoken:
            continue
        over = heads.get(r.section, [])
        made = [p for p in product.get(r.section, []) if p.at < r.at]
        source = over[0] if len(over) == 1 and over[0].at < r.at else made[-1] if made else None
        if source is not None and within(distance(r, source), f.contextual_range):
            r.data["compound"] = dict(source.data)
            r.lower(source)


def _keys(compound: dict | None) -> list[str]:
    """What two records of one compound have in common."""
    return [*("n" + x for x in (compound or {}).get("names", ())), *("l" + x for x in (compound or {}).get("labels", ()))]


def _frozen(x):
    if isinstance(x, dict):
        return frozenset((k, _frozen(v)) for k, v in x.items())
    return tuple(map(_frozen, x)) if isinstance(x, list) else x


def _leaves(model: Model, data: dict | None, at: str = "") -> Iterator[tuple[str, list]]:
    """(path, values) of all fields, values empty for an empty one."""
    for f in model.fields:
        x = None if data is None or f.is_empty(data.get(f.name)) else data[f.name]
        if isinstance(f.kind, Model):
            yield from _leaves(f.kind, x, f"{at}{f.name}.")
        elif isinstance(f.kind, tuple) and not isinstance(f.kind[1], Model):
            yield at + f.name, list({_frozen(v) for v in x or ()})
        else:
            yield at + f.name, [] if x is None else [_frozen(x)]


class _Twins:
    """Records by the values of their leaves. Of two records one of which says all that the other says, each leaf
    that both have has a value in common, so those that share one with a record, or lack that leaf, are all to ask."""

    def __init__(self):
        self.having: dict[tuple, list[int]] = {}

    def add(self, i: int, model: Model, data: dict) -> None:
        for path, values in _leaves(model, data):
            for v in values or [None]:
                self.having.setdefault((id(model), path, v), []).append(i)

    def near(self, model: Model, data: dict) -> list[int]:
        best: list[list[int]] | None = None
        for path, values in _leaves(model, data):
            if values:
                lists = [x for v in {*values, None} if (x := self.having.get((id(model), path, v)))]
                if best is None or sum(map(len, lists)) < sum(map(len, best)):
                    best = lists
        return sorted({i for x in best or () for i in x})


class _Contexts:
    """The records of a document from which others may take what they lack, from near to far.

    A record is only shown those that could change it: of its own model those that have a field it lacks, and agree
    with it in the field that has most values, or lack that one; of a field's model any, until the field is filled;
    and compounds that have a name or label of its own. All lists are in the order of the document.
    """

    def __init__(self, rows: list[Record]):
        self.rows = rows
        self.monotone = all(a.section <= b.section for a, b in zip(rows, rows[1:]))
        self.first, self.end = list(range(len(rows))), list(range(1, len(rows) + 1))  # of the records at one place
        for i in range(1, len(rows)):
            if rows[i].at[:2] == rows[i - 1].at[:2]:
                self.first[i] = self.first[i - 1]
        for i in range(len(rows) - 2, -1, -1):
            if rows[i].at[:2] == rows[i + 1].at[:2]:
                self.end[i] = self.end[i + 1]
        self.of: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            self.of.setdefault(r.model.name, []).append(i)
        self.telling: dict[str, list] = {}
        self.same: dict[tuple, dict] = {}
        self.named: dict[str, dict[str, list[int]]] = {}

    def _selective(self, r: Record):
        """The field of a record by which those that contradict it are best left out."""
        name = r.model.name
        if name not in self.telling:
            plain = [f for f in r.model.fields if f.name != "compound" and not f.ignore_when_merging]
            count = {f.name: len({_frozen(x) for i in self.of[name] if not f.is_empty(x := self.rows[i].data.get(f.name))}) for f in plain}
            self.telling[name] = sorted(plain, key=lambda f: -count[f.name])
        return next((f for f in self.telling[name] if not f.is_empty(r.data.get(f.name))), None)

    def _place(self, index: dict, g, i: int) -> None:
        x = None if g is None else self.rows[i].data.get(g.name)
        insort(index.setdefault(None if g is None or g.is_empty(x) else (_frozen(x),), []), i)

    def _alike(self, r: Record, f, g) -> list[list[int]]:
        """Records of the model that have f and don't differ in g."""
        key = (r.model.name, f.name, g and g.name)
        if key not in self.same:
            self.same[key] = {}
            for i in self.of[r.model.name]:
                if not f.is_empty(self.rows[i].data.get(f.name)):
                    self._place(self.same[key], g, i)
        index = self.same[key]
        return [x for k in ({None} if g is None else {None, (_frozen(r.data[g.name]),)}) if (x := index.get(k))]

    def _with_key(self, model: str, key: str) -> list[int]:
        if model not in self.named:
            index = self.named[model] = {}
            for i in self.of.get(model, ()):
                for k in set(_keys(self.rows[i].data)):
                    index.setdefault(k, []).append(i)
        return self.named[model].get(key, [])

    def _order(self, r: Record, j: int) -> tuple:
        at, o = r.at, self.rows[j]
        d = (0, 0, 0, abs(at[1] - o.at[1])) if at[0] == o.at[0] else (0, abs(r.section - o.section), abs(at[0] - o.at[0]), 0)
        within_ = abs(at[2] - o.at[2]) / (o.sureness() + 0.01) if at[:2] == o.at[:2] else 0.0
        return d, within_, o.at > at, [-x for x in o.at] if o.at < at else list(o.at), j

    def _walks(self, i: int, found: list[int]) -> list[Iterator[int]]:
        """The list from near to far, as runs that are each in order: back, at the same place, ahead."""
        if not self.monotone:
            return [iter(sorted((j for j in found if j != i), key=lambda j: self._order(self.rows[i], j)))]
        low, high = bisect_left(found, self.first[i]), bisect_left(found, self.end[i])

        def back() -> Iterator[int]:
            k = low
            while k:
                begin = bisect_left(found, self.first[found[k - 1]])
                yield from sorted(found[begin:k], key=lambda j: self._order(self.rows[i], j))
                k = begin

        own = sorted((j for j in found[low:high] if j != i), key=lambda j: self._order(self.rows[i], j))
        return [back(), iter(own), (found[k] for k in range(high, len(found)))]

    def fill(self, i: int) -> None:
        r = self.rows[i]
        missing = [f for f in r.model.fields if f.contextual and f.is_empty(r.data.get(f.name))]
        g = self._selective(r)
        heap: list[tuple] = []
        keys: set[str] = set()

        def step(walk: Iterator[int], f, until_filled: bool) -> None:
            if not (until_filled and not f.is_empty(r.data.get(f.name))) and (j := next(walk, None)) is not None:
                order = self._order(r, j)
                if within(Range(*order[0], bare=False), f.contextual_range):
                    heappush(heap, (order, len(steps), walk, f, until_filled))
                    steps.append(None)

        def show(found: list[int], f, until_filled: bool) -> None:
            for walk in self._walks(i, found):
                step(walk, f, until_filled)

        def show_named() -> None:
            for f in r.model.fields:
                if f.name == "compound" and f.contextual and isinstance(f.kind, Model):
                    for k in _keys(r.data.get(f.name)):
                        if k not in keys:
                            keys.add(k)
                            show(self._with_key(f.kind.name, k), f, False)

        steps: list[None] = []  # so that nothing but the order is compared
        for f in missing:
            for found in () if f.never_merge else self._alike(r, f, g):
                show(found, f, True)
            if isinstance(f.kind, Model):
                show(self.of.get(f.kind.name, []), f, True)
        show_named()
        passed = None
        while heap:
            order, _, walk, f, until_filled = heappop(heap)
            if passed is None or order > passed:
                passed = order
                o = self.rows[order[-1]]
                if merge_contextual(r, o, distance(r, o)):
                    if r.model.contextual_fulfilled(r.data):
                        break
                    show_named()
            step(walk, f, until_filled)
        for f in missing:  # what it has got, others may take
            if not f.is_empty(r.data.get(f.name)):
                for (name, field, by), index in self.same.items():
                    if (name, field) == (r.model.name, f.name):
                        self._place(index, next((x for x in r.model.fields if x.name == by), None), i)
        if r.model.name in self.named and missing:
            for k in set(_keys(r.data)):
                found = self.named[r.model.name].setdefault(k, [])
                if i not in found:
                    insort(found, i)


def resolve(records: DataFrame, models: list[Model], doc: str = "doc_id", sections: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """(doc, el_idx, sent_idx, rec_idx, model, method, payload, confidence) after merging within each document.

    sections: (doc, el_idx, section, el_type) of elements; without it a document is one section of no known elements. A document is resolved as a whole,
    whatever its length. definitions: (doc, short, long) of abbreviations, which hold in the whole document.
    """
    by = {m.name: m for top in models for m in top.flatten()}
    rows = records.join(sections, [doc, "el_idx"], "left") if sections is not None else records.withColumn("section", F.lit(0))
    rows = rows if "el_type" in rows.columns else rows.withColumn("el_type", F.lit(None).cast("string"))
    if definitions is not None:  # rows without a place, so they come first
        said = {doc: F.col(doc), "payload": F.to_json(F.array("short", "long"))}
        rows = rows.unionByName(definitions.select(*(said.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in rows.schema)))
    kind = records.schema[doc].dataType.simpleString()
    schema = f"`{doc}` {kind}, el_idx int, sent_idx int, rec_idx int, model string, method string, payload string, confidence map<string,double>"

    columns = [doc, "el_idx", "sent_idx", "rec_idx", "model", "method", "payload", "confidence", "section", "el_type"]
    names = [doc, "el_idx", "sent_idx", "rec_idx", "model", "method", "payload", "confidence"]

    def done(key, group: list[Record], told: list) -> list[tuple]:
        return [(key, *r.at, r.model.name, r.method, json.dumps(r.data, ensure_ascii=False, sort_keys=True), r.confidence) for r in resolve_document(group, told)]

    def run(batches):
        # partitions are sorted, so a document's records follow each other, also from batch to batch
        at, group, told = None, [], []
        for b in batches:
            out = []
            for key, e, s, r, m, method, p, c, sec, element in b[columns].itertuples(index=False, name=None):
                if at != key:
                    out += done(at, group, told) if group else []
                    group, told = [], []
                at = key
                if m is None and pd.isna(e):
                    told.append(tuple(json.loads(p)))
                elif m in by:
                    group.append(Record(by[m], json.loads(p), (int(e), int(s), int(r)), method, c, 0 if pd.isna(sec) else int(sec), element))
            yield pd.DataFrame(out, columns=names)
        if group:
            yield pd.DataFrame(done(at, group, told), columns=names)

    placed = rows.select(*columns).where(F.col(doc).isNotNull()).repartition(doc).sortWithinPartitions(doc, "el_idx", "sent_idx", "rec_idx")
    return placed.mapInPandas(run, schema)


# --- steps that don't depend on order, as plans -----------------------------------------------------------------------


def nearest_fill(df: DataFrame, group: list[str], position: str, field: str, limit: float | None = None) -> DataFrame:
    """Fills nulls of a field from the nearest row of the group that has it, back before forward at a tie, within
    ``limit`` (exclusive) positions: an as-of join in both directions by two windows."""
    w = Window.partitionBy(*group).orderBy(position)
    known = F.when(F.col(field).isNotNull(), F.struct(F.col(position).alias("p"), F.col(field).alias("v")))
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_b": back, "_a": ahead})
    near = lambda c, d: F.when((d < limit) if limit is not None else d.isNotNull(), c)
    db, da = F.col(position) - F.col("_b.p"), F.col("_a.p") - F.col(position)
    pick = F.when(F.col("_a").isNull() | (db <= da), near(F.col("_b.v"), db)).otherwise(near(F.col("_a.v"), da))
    return df.withColumn(field, F.coalesce(field, pick)).drop("_b", "_a")


def carried_forward(df: DataFrame, group: list[str], position: str, field: str) -> DataFrame:
    """Fills nulls of a field from the last row before that has it."""
    w = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(field, F.last(field, ignorenulls=True).over(w))


def without_subsets(df: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Distinct rows of which no other row of the group says more: all it says, and another field besides.

    Rows are joined to rows of their group only over the hash of a projection that a larger row has in common, so
    no pairs of a group are made: every row is spread over the patterns of filled fields that occur in its group.
    """
    rows = df.select(*group, *fields).distinct()
    filled = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), F.lit(str(i))) for i, f in enumerate(fields)))
    rows = rows.withColumn("_p", filled)
    patterns = rows.groupBy(*group).agg(F.collect_set("_p").alias("_ps"))  # at most 2 ** fields
    larger = rows.join(patterns, group).withColumn("_q", F.explode("_ps")).where("_q <> _p and size(array_except(filter(split(_q, ','), x -> x <> ''), split(_p, ','))) = 0")
    shown = lambda p: F.concat_ws("\x1f", *(F.when(F.array_contains(F.split(p, ","), str(i)), F.concat(F.lit(f"{i}="), F.col(f).cast("string"))) for i, f in enumerate(fields)))
    covered = larger.select(*group, F.col("_q").alias("_p"), shown(F.col("_q")).alias("_k")).distinct()
    return rows.withColumn("_k", shown(F.col("_p"))).join(covered, [*group, "_p", "_k"], "left_anti").select(*group, *fields)


def union_of(df: DataFrame, group: list[str], arrays: list[str]) -> DataFrame:
    """One row for each group, each array the sorted distinct union; built from distinct elements, so that copies
    are gone before anything is collected."""
    out = df.select(*group).distinct()
    for a in arrays:
        part = df.select(*group, F.explode(a).alias("_x")).where("_x is not null").distinct().groupBy(*group).agg(F.array_sort(F.collect_list("_x")).alias(a))
        out = out.join(part, group, "left").withColumn(a, F.coalesce(a, F.array().cast(df.schema[a].dataType)))
    return out


#: Ways to make one confidence of several.
POOLS: dict[str, Callable[[Column], Column]] = {
    "least": F.array_min,
    "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a),
    "product": lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y),
}


def pooled_confidence(c: Column, pool: str | Callable[[Column], Column] = "least") -> Column:
    """One confidence of a map of them, by one of ``POOLS`` or a function of an array; null for none."""
    known = F.filter(F.map_values(c), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, (POOLS[pool] if isinstance(pool, str) else pool)(known))


def required_confidence(model: Model, record: Column, confidence: Column) -> Column:
    """A confidence less what the empty required fields of a record take from it."""
    out = confidence
    for f in model.fields:
        if f.required:
            out = out * F.when(record[f.name].isNull(), 1 - f.requiredness).otherwise(1.0)
    return out


def merged_confidence(a: Column, b: Column) -> Column:
    """Per field the lower one; a field that only one has keeps its own."""
    return F.map_zip_with(a, b, lambda k, x, y: F.least(x, y))
