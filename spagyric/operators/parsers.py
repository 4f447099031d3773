"""Parsers: what turns a sentence into records of a model.

A parser is any object with a ``model``, an optional ``trigger`` (words, one of which a sentence must have) and
``parse(sentence)``, which yields (method, record, confidence). ``PatternParser`` runs a pattern over the tagged words and
reads fields off the named nodes of each match; ``FieldParser`` needs no pattern but those of the model's fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from spagyric.operators.assign import BEHIND, Mention
from spagyric.operators.grammar import Node, Pattern, Token, tidy
from spagyric.operators.tagging import Tagger, chemical_tags, regex_tagger
from spagyric.operators.tokens import word_spans
from spagyric.spec.models import Field, Model

Found = tuple[str, dict, float]  # method, record, confidence
Tokenizer = Callable[[str], list[tuple[str, int, int]]]

#: Constants of the patterns that most parsers share.
BRACKETS = {"open": "([{", "close": ")]}"}
HYPHENS = "-‐‑⁃‒–—―−"
DELIMITERS = (",", ";", ":", "/")
NOUNS, VERBS, ADJECTIVES = ("NN", "NNS", "NNP", "NNPS"), ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), ("JJ", "JJR", "JJS")


#: What a compound behind 'in', which may be a solvent, counts as farther away.
SOLVENT = 30


_POS = regex_tagger()


@dataclass
class Sentence:
    """A sentence as parsers see it; words and tags are made once, when they are first asked for."""

    text: str
    tokenizer: Tokenizer = word_spans
    ner: Tagger = chemical_tags
    pos: Tagger = _POS
    abbreviations: dict[str, str] = field(default_factory=dict)  # short forms that name chemicals in this document
    compounds: list[dict] = field(default_factory=list)

    @cached_property
    def spans(self) -> list[tuple[str, int, int]]:
        return self.tokenizer(self.text)

    @cached_property
    def chemical(self) -> list[str]:
        """B-, I- and O; short forms that the document has defined for chemicals are chemicals."""
        ws = [w for w, _, _ in self.spans]
        tags = list(self.ner(ws))
        for i, w in enumerate(ws):
            if w in self.abbreviations and tags[i] == "O":
                tags[i] = "B-CM"
        return tags

    @cached_property
    def tokens(self) -> list[Token]:
        ws = [w for w, _, _ in self.spans]
        return [(w, {"ner": n, "pos": p}) for w, n, p in zip(ws, self.chemical, self.pos(ws))]


def fields_of(model: Model, nodes: Sequence[Node]) -> dict:
    """The fields of a model from named nodes: nested models from the node of their name or their field's, lists from all
    nodes, others from the first."""
    out: dict = {}
    for f in model.fields:
        found = [n for node in nodes for n in node.find(f.name)]
        many, kind = isinstance(f.kind, tuple), f.kind[1] if isinstance(f.kind, tuple) else f.kind
        if isinstance(kind, Model):
            found = found or [n for node in nodes for n in node.find(kind.name.lower())]
            values = [v for n in found if (v := fields_of(kind, n.parts))]
        else:
            values = [tidy(" ".join(n.words())) for n in found]
        values = [v for v in values if v]
        if values:
            out[f.name] = list(values) if many else values[0]
    return out


@dataclass(frozen=True)
class PatternParser:
    """``root`` is tried at every word of a sentence. interpret: records from the nodes of a match, by default one with the
    fields that nodes are named after."""

    model: Model
    root: Pattern
    trigger: tuple[str, ...] = ()
    interpret: Callable[[Model, list[Node]], Iterator[dict]] | None = None
    method: str = "pattern"
    confidence: float = 1.0
    most: int | None = None  # matches taken from one sentence

    def parse(self, sentence: Sentence) -> Iterator[Found]:
        for nodes, _, _ in self.root.scan(sentence.tokens, self.most):
            for record in self.interpret(self.model, nodes) if self.interpret else [fields_of(self.model, nodes)]:
                if record:
                    yield self.method, record, self.confidence


def patterned(model: Model) -> list[Field]:
    return [f for f in model.fields if f.pattern]


@dataclass(frozen=True)
class FieldParser:
    """Records of any model whose fields have patterns. The first required field that isn't contextual, else the first with a
    pattern, makes the records: one for each place where it is found; every other field, nested models too, takes the
    nearest match that is nearer to no other record, and lists take all of them."""

    model: Model
    trigger: tuple[str, ...] = ()

    def parse(self, sentence: Sentence) -> Iterator[Found]:
        yield from (("auto_sentence", r, c) for r, c, _ in self._records(self.model, sentence))

    def _found(self, f: Field, sentence: Sentence) -> list[tuple[int, int, object]]:
        kind = f.kind[1] if isinstance(f.kind, tuple) else f.kind
        if isinstance(kind, Model):
            if kind.name == "Compound":
                return [(c["start"], c["end"], {k: sorted(set(c[k])) for k in ("names", "labels", "roles") if c[k]}) for c in sentence.compounds]
            return [(a, b, r) for r, _, (a, b) in FieldParser(kind)._records(kind, sentence)] if patterned(kind) else []
        return [(m.start("v") if "v" in m.re.groupindex else m.start(), m.end(), (m["v"] if "v" in m.re.groupindex else m[0]).strip()) for m in re.finditer(rf"(?<!\w)(?:{f.pattern})(?!\w)", sentence.text)] if f.pattern else []

    def _records(self, model: Model, sentence: Sentence) -> Iterator[tuple[dict, float, tuple[int, int]]]:
        own = patterned(model)
        if not own:
            return
        head = next((f for f in own if f.required and not f.contextual), own[0])
        heads = self._found(head, sentence)
        places = [Mention(a, b, str(i)) for i, (a, b, _) in enumerate(heads)]
        records: list[dict] = [{head.name: [v] if isinstance(head.kind, tuple) else v} for _, _, v in heads]
        ends = [(a, b) for a, b, _ in heads]
        far = [0.0] * len(heads)
        for f in model.fields:
            if f is head:
                continue
            found = [x for x in self._found(f, sentence) if not any(a <= x[0] < b for a, b, _ in heads)]
            best: dict[int, tuple] = {}
            for a, b, v in found:
                to = min(places, key=lambda p: (max(a - p.end, 0) if a >= p.start else BEHIND * (p.start - b), p.start), default=None)
                if to is None:
                    continue
                i, d = int(to.text), max(a - to.end, to.start - b, 0)
                d += SOLVENT * (isinstance(f.kind, Model) and sentence.text[:a].endswith("in "))
                if isinstance(f.kind, tuple):
                    records[i].setdefault(f.name, []).append(v)
                elif i not in best or d < best[i][0]:
                    best[i] = (d, v)
                ends[i] = min(ends[i][0], a), max(ends[i][1], b)
            for i, (d, v) in best.items():
                records[i][f.name] = v
                far[i] = max(far[i], d)
            if isinstance(f.kind, Model) and f.kind.name == "Compound":  # one compound may belong to several records
                for i, p in enumerate(places):
                    if f.name not in records[i] and found:
                        records[i][f.name] = min(found, key=lambda x: max(x[0] - p.end, p.start - x[1], 0))[2]
        for r, d, e in zip(records, far, ends):
            yield r, round(1 / (1 + d / 50), 3), e


@dataclass(frozen=True)
class Question:
    """A question about a field of a model. What stands in braces is filled with answers to earlier questions, so that it is only
    asked where they are known: 'What is the melting point of {compound}?'"""

    field: str
    text: str


@dataclass(frozen=True)
class QuestionParser:
    """Records by asking a reader of texts again and again: ``answer`` gives (text, score) pairs for a question about a
    sentence. Every answer to a question makes a record of its own, which the next questions complete, for ``rounds`` at
    most; answers below ``threshold`` count as none. Which reader is used is up to the caller, as none is in this package."""

    model: Model
    questions: tuple[Question, ...]
    answer: Callable[[str, str], list[tuple[str, float]]]
    threshold: float = 0.1
    rounds: int = 5
    trigger: tuple[str, ...] = ()

    def parse(self, sentence: Sentence) -> Iterator[Found]:
        partial: list[tuple[dict, float]] = [({}, 1.0)]
        for _ in range(self.rounds):
            new: list[tuple[dict, float]] = []
            for known, sure in partial:
                ask = next((q for q in self.questions if q.field not in known and set(re.findall(r"\{(\w+)\}", q.text)) <= {k for k, v in known.items() if v}), None)
                if ask is None:
                    new.append((known, sure))
                    continue
                found = [(t, c) for t, c in self.answer(ask.text.format(**known), sentence.text) if c >= self.threshold and t.strip()]
                new += [({**known, ask.field: t.strip()}, sure * c) for t, c in found] or [({**known, ask.field: None}, sure)]
            if new == partial:
                break
            partial = new
        for record, sure in partial:
            filled = {k: v for k, v in record.items() if v}
            if filled:
                nested = {k: {"names": [v]} if isinstance(self.model[k].kind, Model) and self.model[k].kind.name == "Compound" else v for k, v in filled.items()}
                yield "questions", nested, round(sure, 3)
