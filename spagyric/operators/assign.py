"""Values of a sentence assigned to the properties and compounds they belong to, over all models at once.

First all mentions are found: specifiers of every model, values with units that any of the models takes, compounds. Lists
('A, B and C') are told from single mentions. A sentence then has one of these shapes, tried in order:

* each value right in front of its compound ('100 K in MnO to 120 K in FeO'),
* as many specifiers as values in a list: they go in pairs, for one compound or for as many,
* as many compounds as values in a list, in front of it or behind it, for one specifier,
* several values for one specifier and one compound,
* specifiers and values in turn: each goes with its neighbour,
* else a specifier takes the value from which it is least far, and what is left belongs to none.

A value belongs to the model of its specifier and to no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

#: Characters between two parts of one statement, at most.
NEAR = 60
#: What a specifier behind its value counts for more than one in front of it.
BEHIND = 6.0
_LINK = re.compile(r"\s*(?:,|;)?\s*(?:and|or|to|,)?\s*(?:from\s+)?")
_BREAK = re.compile(r";|\.\s|\b(?:whereas|while|but)\b")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    text: str
    models: tuple[str, ...] = ()
    unit: str = ""
    compound: dict | None = None


def without_inner(mentions: Sequence[Mention]) -> list[Mention]:
    """Without those that stand within longer ones; equal places are one mention for all their models."""
    out: dict[tuple[int, int], Mention] = {}
    for m in sorted(mentions, key=lambda m: (m.start, -m.end)):
        same = out.get((m.start, m.end))
        if same is not None:
            out[m.start, m.end] = Mention(m.start, m.end, m.text, tuple(dict.fromkeys(same.models + m.models)), same.unit or m.unit, m.compound)
        elif not any(a <= m.start and m.end <= b for a, b in out):
            out[m.start, m.end] = m
    return sorted(out.values(), key=lambda m: m.start)


def lists(text: str, mentions: Sequence[Mention]) -> list[list[Mention]]:
    """Runs of mentions between which there are only commas and conjunctions."""
    out: list[list[Mention]] = []
    for m in mentions:
        if out and re.fullmatch(_LINK, text[out[-1][-1].end : m.start]) and text[out[-1][-1].end : m.start].strip():
            out[-1].append(m)
        else:
            out.append([m])
    return out


_HEAD = re.compile(r"\s(?:and|or)\s+\w+\s+(\w+?)(s?)(?!\w)")
_LAST_WORD = re.compile(r"(\w+)\s*,?\s*\Z")


def shared_heads(text: str, specifier: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, phrase) of members of a list that share their last word: 'Curie' in 'Curie and Neel temperatures'."""
    for m in _HEAD.finditer(text):
        end = m.start() + 1
        while True:
            cut = text.rfind(" ", 0, max(0, len(text[:end].rstrip(" ,")))) + 1
            w = _LAST_WORD.search(text[cut:end])
            if w is None or not any(specifier.fullmatch(f"{w[1]} {head}") for head in (m[1], m[1] + m[2])):
                break
            yield cut + w.start(1), cut + w.end(1), f"{w[1]} {m[1]}"
            end = cut + w.start(1)
            if not text[:end].rstrip().endswith(","):
                break


def gap(text: str, a: Mention, b: Mention) -> float:
    """How far a specifier is from a value; infinite if a new statement begins between."""
    lo, hi = (a.end, b.start) if a.end <= b.start else (b.end, a.start)
    if _BREAK.search(text[lo:hi]):
        return float("inf")
    return (hi - lo) * (1.0 if a.end <= b.start else BEHIND)


def template(text: str, spec: Mention, value: Mention, compound: Mention | None) -> bool:
    """Whether specifier, value and compound follow each other closely, in any order of the three."""
    parts = sorted((m for m in (spec, value, compound) if m is not None), key=lambda m: m.start)
    return all(b.start - a.end <= NEAR and not _BREAK.search(text[a.end : b.start]) for a, b in zip(parts, parts[1:]))


def nearest(compounds: Sequence[Mention], a: int, b: int, text: str = "") -> Mention | None:
    """The mention least far from a stretch of text, at a tie the first; none in another statement of the text."""
    inside = lambda c: a <= c.start <= b
    able = [c for c in compounds if inside(c) or not _BREAK.search(text[c.end : a] if c.end <= a else text[b : c.start])]
    return min(able, key=lambda c: (0 if inside(c) else min(abs(a - c.end), abs(c.start - b)), c.start), default=None)


def assigned(text: str, specs: Sequence[Mention], values: Sequence[Mention], compounds: Sequence[Mention]) -> list[tuple[str, str, Mention | None, Mention, Mention | None]]:
    """(method, model, specifier, value, compound) of every value; specifier None for models that have none."""
    specs, values = without_inner(specs), without_inner(values)
    compounds = [c for c in compounds if not any(m.start <= c.start < m.end or c.start <= m.start < c.end for m in [*specs, *values])]
    fits = lambda s, v: [m for m in s.models if m in v.models]
    out: dict[int, tuple] = {}  # by value

    def give(v: Mention, s: Mention | None, c: Mention | None, method: str | None = None) -> None:
        k = values.index(v)
        if k not in out and (models := fits(s, v) if s else []):
            out[k] = (method or ("template" if template(text, s, v, c) else "auto_sentence"), models, s, v, c)

    # a value and its compound side by side
    beside = {}
    for v in values:
        c = next((c for c in compounds if re.fullmatch(r"\s*(?:in|for|of)\s+(?:the\s+)?", text[v.end : c.start])), None) if len(values) > 1 else None
        if c is not None:
            beside[v] = c
    if len(beside) < 2:
        beside = {}

    spec_lists, compound_lists = lists(text, specs), lists(text, compounds)
    respectively = "respectively" in text
    for vs in lists(text, values):
        n = len(vs)
        if n < 2 and not beside:
            continue
        lo, hi = vs[0].start, vs[-1].end
        ss = [x for x in spec_lists if len(x) == n and all(fits(s, v) for s, v in zip(x, vs))]
        cs = [x for x in compound_lists if len(x) == n]
        near_ss = min(ss, key=lambda x: abs(x[0].start - lo), default=None)
        near_cs = min(cs, key=lambda x: abs(x[0].start - lo), default=None)
        if n > 1 and near_ss:
            for i, (s, v) in enumerate(zip(near_ss, vs)):
                c = near_cs[i] if near_cs and respectively else nearest(compounds, min(lo, near_ss[0].start), max(hi, near_ss[-1].end), text)
                give(v, s, c, "template")
            continue
        one = min((s for s in specs if fits(s, vs[0])), key=lambda s: gap(text, s, Mention(lo, hi, "")), default=None)
        if one is None:
            continue
        if n > 1 and near_cs and (respectively or len(compounds) == n):
            for c, v in zip(near_cs, vs):
                give(v, one, c, "template")
        elif n > 1 and len(specs) == 1:
            c = nearest(compounds, min(lo, one.start), max(hi, one.end), text)
            for v in vs:
                give(v, one, beside.get(v, c), "template")
    if beside and len(specs) == 1:
        for v, c in beside.items():
            give(v, specs[0], c, "template")
    left = [v for k, v in enumerate(values) if k not in out]
    free = [s for s in specs if not any(x[2] is s for x in out.values())]
    turns = sorted([*left, *free], key=lambda m: m.start)
    first, second = turns[::2], turns[1::2]
    pairs: list[tuple[Mention, Mention]] = []
    if len(first) == len(second) > 1 and (set(map(id, first)) == set(map(id, free)) or set(map(id, second)) == set(map(id, free))):
        pairs = [(s, v) if any(s is x for x in free) else (v, s) for s, v in zip(first, second)]
        pairs = [(s, v) for s, v in pairs if fits(s, v) and gap(text, s, v) < float("inf")]
    if len(pairs) < 2:
        cost = sorted(((gap(text, s, v), s.start, v.start, s, v) for s in free for v in left if fits(s, v)), key=lambda x: x[:3])
        pairs = []
        for d, _, _, s, v in cost:
            if d < float("inf") and not any(s is x or v is y for x, y in pairs):
                pairs.append((s, v))
    for s, v in pairs:
        give(v, s, beside.get(v) or nearest(compounds, min(s.start, v.start), max(s.end, v.end), text))
    return [(method, m, s, v, c) for k, (method, models, s, v, c) in sorted(out.items()) for m in models]
