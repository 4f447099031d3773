"""Relations learned from few labelled sentences.

Candidates of a sentence are combinations of its entities. Labelled candidates become phrases (words before,
between and behind the entities), phrases clusters by single pass, and a cluster has a pattern and a confidence. A
new candidate is scored by noisy-or over the clusters it matches. The model is frozen while it predicts; learning
from predictions is a second pass that is asked for. Models are JSON.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "<Blank>"
Entity = tuple[str, str, int, int]  # text, tag, start, end (words)


def find(text: Sequence, pattern: Sequence) -> list[int]:
    """Starts of a sequence in another, overlapping ones too (Knuth, Morris and Pratt)."""
    if not pattern:
        return []
    fail, k = [0] * len(pattern), 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = fail[k - 1]
        k += pattern[i] == pattern[k]
        fail[i] = k
    out, k = [], 0
    for i, x in enumerate(text):
        while k and x != pattern[k]:
            k = fail[k - 1]
        k += x == pattern[k]
        if k == len(pattern):
            out.append(i - k + 1)
            k = fail[k - 1]
    return out


def candidates(entities: Sequence[Entity], tags: Sequence[str], most: int = 400) -> list[tuple[Entity, ...]]:
    """Combinations with one entity of every tag, in sentence order; of entities with one start the longest stays.
    None if there would be more than ``most``, which is the feature that keeps long lists out."""
    longest: dict[tuple[str, int], Entity] = {}
    for e in entities:
        if e[3] > longest.get((e[1], e[2]), ("", "", 0, 0))[3]:
            longest[e[1], e[2]] = e
    by_tag = {t: [e for e in longest.values() if e[1] == t] for t in tags}
    if math.prod(map(len, by_tag.values())) > most:
        return []
    every = (tuple(sorted(c, key=lambda e: e[2])) for c in product(*by_tag.values()))
    return [c for c in every if all(a[3] <= b[2] for a, b in zip(c, c[1:]))]


@dataclass
class Phrase:
    order: tuple[str, ...]
    elements: list[list[str]]  # prefix, middles, suffix

    @classmethod
    def of(cls, words: Sequence[str], entities: Sequence[Entity], prefix: int = 1, suffix: int = 1) -> "Phrase":
        es = sorted(entities, key=lambda e: e[2])
        parts = [list(words[max(0, es[0][2] - prefix) : es[0][2]])] + [list(words[a[3] : b[2]]) for a, b in zip(es, es[1:])] + [list(words[es[-1][3] : es[-1][3] + suffix])]
        return cls(tuple(e[1] for e in es), [p or [BLANK] for p in parts])


def cosine(a: Sequence[str], b: Sequence[str]) -> float:
    """Of the 0/1 vectors of two lists of words."""
    x, y = set(a), set(b)
    return len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0


def cosine_column(a: Column, b: Column) -> Column:
    """The same as a Catalyst expression on two arrays."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)


def similarity(a: list[list[str]], b: list[list[str]], weights: tuple[float, float, float] = (0.1, 0.8, 0.1)) -> float:
    """Weighted cosine of prefix, middles and suffix; the middles share their weight."""
    if len(a) != len(b):
        return 0.0
    middle = len(a) - 2
    each = [weights[0], *[weights[1] / middle] * middle, weights[2]] if middle else [weights[0], weights[2]]
    return sum(w * cosine(x, y) for w, x, y in zip(each, a, b)) / sum(each)


@dataclass
class Cluster:
    order: tuple[str, ...]
    phrases: list[list[list[str]]] = field(default_factory=list)
    pattern: list[list[str]] = field(default_factory=list)
    confidence: float = 0.0

    def add(self, phrase: Phrase, weights, rate: float = 0.5) -> None:
        """A phrase more: its pattern is the medoid of each element, its confidence moves at the learning rate."""
        self.phrases.append(phrase.elements)
        fresh = []
        for k in range(len(phrase.elements)):
            counts = Counter(tuple(p[k]) for p in self.phrases)
            distinct = sorted(counts)
            fresh.append(list(max(distinct, key=lambda d: (sum(n * cosine(d, e) for e, n in counts.items()), counts[d], d))))
        self.pattern = fresh
        new = sum(similarity(p, self.pattern, weights) for p in self.phrases) / len(self.phrases)
        self.confidence = new if len(self.phrases) == 1 else rate * new + (1 - rate) * self.confidence


@dataclass
class Snowball:
    tags: tuple[str, ...]
    tc: float = 0.95
    tsim: float = 0.95
    weights: tuple[float, float, float] = (0.1, 0.8, 0.1)
    prefix: int = 1
    suffix: int = 1
    rate: float = 0.5
    most: int = 400
    clusters: list[Cluster] = field(default_factory=list)

    def learn(self, words: Sequence[str], relation: Sequence[Entity]) -> None:
        phrase = Phrase.of(words, relation, self.prefix, self.suffix)
        near = [c for c in self.clusters if c.order == phrase.order and similarity(phrase.elements, c.pattern, self.weights) >= self.tsim]
        if not near:
            self.clusters.append(Cluster(phrase.order))
            near = [self.clusters[-1]]
        for c in near:
            c.add(phrase, self.weights, self.rate)

    def score(self, words: Sequence[str], relation: Sequence[Entity]) -> float:
        """1 - prod(1 - match * confidence) over the clusters of the same order."""
        phrase = Phrase.of(words, relation, self.prefix, self.suffix)
        miss = 1.0
        for c in self.clusters:
            if c.order == phrase.order:
                match = similarity(phrase.elements, c.pattern, self.weights)
                if match >= self.tsim:
                    miss *= 1 - match * c.confidence
        return 1 - miss

    def predict(self, words: Sequence[str], entities: Sequence[Entity]) -> list[tuple[tuple[Entity, ...], float]]:
        """Relations at or above the threshold, best first; an entity is used once where tags allow."""
        scored = [(c, self.score(words, c)) for c in candidates(entities, self.tags, self.most)]
        return sorted([x for x in scored if x[1] >= self.tc], key=lambda x: (-x[1], [e[2] for e in x[0]]))

    def dumps(self) -> str:
        state = self.__dict__ | {"clusters": [c.__dict__ for c in self.clusters]}
        return json.dumps(state)

    @classmethod
    def loads(cls, text: str) -> "Snowball":
        state = json.loads(text)
        clusters = [Cluster(tuple(c["order"]), c["phrases"], c["pattern"], c["confidence"]) for c in state.pop("clusters")]
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in state.items()}, clusters=clusters)


RELATION = "rel_idx int, score double, entities array<struct<text:string,tag:string,start_idx:int,end_idx:int>>"


def relations(sentences: DataFrame, keys: list[str], words: str, entities: str, model: Snowball) -> DataFrame:
    """(keys, rel_idx, score, entities) found by a frozen model. words: ARRAY<STRING>; entities: ARRAY<STRUCT<text,
    tag, start, end>> in word indexes."""
    frozen = model.dumps()  # a few clusters
    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        m = Snowball.loads(frozen)
        for b in batches:
            out = []
            for *key, ws, es in zip(*(b[c] for c in [*keys, words, entities])):
                found = [] if ws is None or es is None else m.predict(list(ws), [(e["text"], e["tag"], int(e["start"]), int(e["end"])) for e in es])
                out += [(*key, i, s, [dict(zip(("text", "tag", "start_idx", "end_idx"), e)) for e in c]) for i, (c, s) in enumerate(found)]
            yield pd.DataFrame(out, columns=[*keys, "rel_idx", "score", "entities"])

    return sentences.select(*keys, words, entities).mapInPandas(run, f"{schema}, {RELATION}")


def associate(parents: list[tuple[int, int]], children: list[tuple[int, int]], heads: Sequence[int]) -> list[tuple[int, int, float]]:
    """(child, parent, confidence): each child with its nearest parent in a dependency tree (``heads``: each word's
    head, -1 at the root). Near are spans whose paths meet deep and are short; a path through another parent counts
    twice. Confidence is 1 / (1 + best / second best), 1 with one parent."""

    def path(i: int) -> list[int]:
        out = [i]
        while heads[out[-1]] >= 0 and heads[out[-1]] not in out:
            out.append(heads[out[-1]])
        return out

    top = lambda span: min((path(i) for i in range(*span)), key=len)
    out = []
    for c, child in enumerate(children):
        scored = []
        for p, parent in enumerate(parents):
            a, b = top(child), top(parent)
            meet = next((x for x in a if x in b), None)
            if meet is None:
                continue
            d = 1 / (len(path(meet))) + 0.01 * (a.index(meet) + b.index(meet))
            between = a[1 : a.index(meet)] + b[1 : b.index(meet)]
            if any(s <= x < e for x in between for k, (s, e) in enumerate(parents) if k != p):
                d *= 2
            scored.append((d, abs(parent[0] - child[0]), p))
        if scored:
            scored.sort()
            out.append((c, scored[0][2], 1.0 if len(scored) == 1 else 1 / (1 + scored[0][0] / scored[1][0])))
    return out


def associated(sentences: DataFrame, keys: list[str], parents: str, children: str, heads: str) -> DataFrame:
    """(keys, child_idx, parent_idx, confidence): ``associate`` for every sentence. parents and children: columns of
    ARRAY<STRUCT<start, end>> in words; heads: ARRAY<INT> from any dependency parser, -1 at the root. Null and empty ones
    give no rows."""
    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)
    spans = lambda x: [(int(e["start"]), int(e["end"])) for e in x]

    def run(batches):
        for b in batches:
            out = []
            for *key, ps, cs, hs in zip(*(b[c] for c in [*keys, parents, children, heads])):
                if ps is not None and cs is not None and hs is not None and len(hs):
                    out += [(*key, *x) for x in associate(spans(ps), spans(cs), [int(h) for h in hs])]
            yield pd.DataFrame(out, columns=[*keys, "child_idx", "parent_idx", "confidence"])

    return sentences.select(*keys, parents, children, heads).mapInPandas(run, f"{schema}, child_idx int, parent_idx int, confidence double")
