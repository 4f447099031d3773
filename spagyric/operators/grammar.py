"""Patterns over tagged tokens: the predicate language of models.

A pattern is tried at a token and gives nodes and the next position, or None. Repetitions are greedy and don't
give back. ``scan`` goes through a sentence from the left. Single-token predicates also compile to columns.

>>> cem = many(Tag("CM")).named("names"); value = Regex(r"^\\d").named("value")
>>> (Word("of") + cem + Word("is").hidden() + value).named("record")
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: its text and its tags by kind; 'ner' (if not 'O') goes before 'pos'.
Token = tuple[str, dict[str, str]]


def token(text: str, **tags: str) -> Token:
    return text, tags


def tag_of(t: Token, kind: str | None = None) -> str | None:
    tags = t[1]
    if kind:
        return tags.get(kind)
    ner = tags.get("ner")
    return ner if ner and ner != "O" else tags.get("pos")


@dataclass(frozen=True)
class Node:
    """A named part of a match, with its text or its parts."""

    name: str
    text: str | None = None
    parts: tuple["Node", ...] = ()

    def words(self) -> list[str]:
        return [self.text] if self.text is not None else [w for p in self.parts for w in p.words()]

    def find(self, name: str) -> list["Node"]:
        """All parts of a name, at any depth, from the left."""
        own = [self] if self.name == name else []
        return own + [n for p in self.parts for n in p.find(name)]

    def first(self, name: str) -> str | None:
        found = self.find(name)
        return " ".join(found[0].words()) if found else None


Match = tuple[list[Node], int]
Action = Callable[[Sequence[Token], int, list[Node]], list[Node]]


@dataclass(frozen=True, eq=False)
class Pattern:
    name: str | None = field(default=None, kw_only=True)
    hide: bool = field(default=False, kw_only=True)
    actions: tuple[Action, ...] = field(default=(), kw_only=True)
    condition: Callable[[list[Node]], bool] | None = field(default=None, kw_only=True)

    def _match(self, tokens: Sequence[Token], i: int) -> Match | None:
        raise NotImplementedError

    def parse(self, tokens: Sequence[Token], i: int = 0) -> Match | None:
        found = self._match(tokens, i)
        if found is None:
            return None
        nodes, end = found
        for action in self.actions:
            nodes = action(tokens, i, nodes)
        if self.condition is not None and not self.condition(nodes):
            return None
        if self.hide:
            return [], end
        if self.name is not None:
            leaf = len(nodes) == 1 and nodes[0].name == "" and nodes[0].text is not None
            nodes = [Node(self.name, nodes[0].text)] if leaf else [Node(self.name, None, tuple(nodes))]
        return nodes, end

    def scan(self, tokens: Sequence[Token], most: int | None = None, overlap: bool = False) -> Iterator[tuple[list[Node], int, int]]:
        """(nodes, start, end) of matches from the left; one that takes no token moves on by one."""
        i, n = 0, 0
        while i <= len(tokens) and (most is None or n < most):
            found = self.parse(tokens, i)
            if found is None:
                i += 1
                continue
            n += 1
            yield found[0], i, found[1]
            i = i + 1 if overlap or found[1] <= i else found[1]

    def named(self, name: str) -> "Pattern":
        return replace(self, name=name)

    def hidden(self) -> "Pattern":
        return replace(self, hide=True)

    def then(self, action: Action) -> "Pattern":
        return replace(self, actions=(*self.actions, action))

    def where(self, condition: Callable[[list[Node]], bool]) -> "Pattern":
        return replace(self, condition=condition)

    def __add__(self, other):
        return And(_flat(And, self) + _flat(And, other))

    def __or__(self, other):
        return First(_flat(First, self) + _flat(First, other))

    def __xor__(self, other):
        return Longest(_flat(Longest, self) + _flat(Longest, other))

    def __and__(self, other):
        return Every(_flat(Every, self) + _flat(Every, other))

    def __invert__(self):
        return Not(self)

    def column(self, text: Column, tags: Column | None = None) -> Column:
        """The same predicate on one token held in columns; only for patterns of single tokens."""
        raise TypeError(f"{type(self).__name__} is no pattern of a single token")


def _flat(kind: type, p: Pattern) -> tuple[Pattern, ...]:
    """The parts of a nested sequence or choice, unless it is named or changed."""
    plain = type(p) is kind and p.name is None and not p.hide and not p.actions and p.condition is None
    return p.parts if plain else (p,)


@dataclass(frozen=True, eq=False)
class Anything(Pattern):
    def test(self, t: Token) -> bool:
        return True

    def _match(self, tokens, i):
        return ([Node("", self.shown(tokens[i]))], i + 1) if i < len(tokens) and self.test(tokens[i]) else None

    def shown(self, t: Token) -> str:
        return t[0]

    def column(self, text, tags=None):
        return F.lit(True)


@dataclass(frozen=True, eq=False)
class Nothing(Anything):
    def test(self, t):
        return False

    def column(self, text, tags=None):
        return F.lit(False)


@dataclass(frozen=True, eq=False)
class Word(Anything):
    word: str = ""

    def test(self, t):
        return t[0] == self.word

    def column(self, text, tags=None):
        return text == self.word


@dataclass(frozen=True, eq=False)
class IWord(Word):
    def test(self, t):
        return t[0].lower() == self.word.lower()

    def column(self, text, tags=None):
        return F.lower(text) == self.word.lower()


@dataclass(frozen=True, eq=False)
class Tag(Anything):
    tag: str = ""
    kind: str | None = None

    def test(self, t):
        return tag_of(t, self.kind) == self.tag

    def column(self, text, tags=None):
        if self.kind:
            return F.coalesce(tags[self.kind] == self.tag, F.lit(False))
        return F.coalesce(F.coalesce(F.nullif(tags["ner"], F.lit("O")), tags["pos"]) == self.tag, F.lit(False))


@dataclass(frozen=True, eq=False)
class Regex(Anything):
    pattern: str = ""
    flags: int = 0
    group: int | str | None = None

    def test(self, t):
        return re.search(self.pattern, t[0], self.flags) is not None

    def shown(self, t):
        return t[0] if self.group is None else re.search(self.pattern, t[0], self.flags)[self.group]

    def column(self, text, tags=None):
        return text.rlike(("(?iU)" if self.flags & re.I else "(?U)") + self.pattern)


@dataclass(frozen=True, eq=False)
class Start(Pattern):
    def _match(self, tokens, i):
        return ([], i) if i == 0 else None


@dataclass(frozen=True, eq=False)
class End(Pattern):
    def _match(self, tokens, i):
        return ([], i) if i == len(tokens) else None


@dataclass(frozen=True, eq=False)
class _Parts(Pattern):
    parts: tuple[Pattern, ...] = ()


class And(_Parts):
    """All, one after another."""

    def _match(self, tokens, i):
        out: list[Node] = []
        for p in self.parts:
            found = p.parse(tokens, i)
            if found is None:
                return None
            out += found[0]
            i = found[1]
        return out, i


class First(_Parts):
    """The first that matches."""

    def _match(self, tokens, i):
        return next((m for p in self.parts if (m := p.parse(tokens, i)) is not None), None)

    def column(self, text, tags=None):
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column(text, tags)
        return out


class Longest(First):
    """The one that takes most tokens, of equals the first."""

    def _match(self, tokens, i):
        found = [m for p in self.parts if (m := p.parse(tokens, i)) is not None]
        return max(found, key=lambda m: m[1]) if found else None


class Every(_Parts):
    """All at one place; the longest match counts."""

    def _match(self, tokens, i):
        found = [p.parse(tokens, i) for p in self.parts]
        return None if any(m is None for m in found) else max(found, key=lambda m: m[1])

    def column(self, text, tags=None):
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(text, tags)
        return out


@dataclass(frozen=True, eq=False)
class _One(Pattern):
    inner: Pattern = field(default_factory=Nothing)


class FollowedBy(_One):
    """Whether it matches here; takes nothing."""

    def _match(self, tokens, i):
        return ([], i) if self.inner.parse(tokens, i) is not None else None


class Not(_One):
    """Whether it doesn't match here; takes nothing."""

    def _match(self, tokens, i):
        return ([], i) if self.inner.parse(tokens, i) is None else None

    def column(self, text, tags=None):
        return ~self.inner.column(text, tags)


@dataclass(frozen=True, eq=False)
class Many(_One):
    """As many as there are, at least ``least``, at most ``most``."""

    least: int = 0
    most: int | None = None

    def _match(self, tokens, i):
        out: list[Node] = []
        n = 0
        while self.most is None or n < self.most:
            found = self.inner.parse(tokens, i)
            if found is None or (found[1] == i and n >= self.least):
                break
            out += found[0]
            i, n = found[1], n + 1
        return (out, i) if n >= self.least else None


class Group(_One):
    """The match as one node."""

    def _match(self, tokens, i):
        found = self.inner.parse(tokens, i)
        return None if found is None else ([Node("group", None, tuple(found[0]))], found[1])


@dataclass(frozen=True, eq=False)
class SkipTo(_One):
    """The tokens up to the next match, and if asked for the match too."""

    include: bool = False

    def _match(self, tokens, i):
        for j in range(i, len(tokens) + 1):
            found = self.inner.parse(tokens, j)
            if found is not None:
                passed = [Node("", t[0]) for t in tokens[i:j]]
                return (passed + found[0], found[1]) if self.include else (passed, j)
        return None


def some(p: Pattern) -> Pattern:
    return Many(p)


def many(p: Pattern) -> Pattern:
    return Many(p, least=1)


def maybe(p: Pattern) -> Pattern:
    return Many(p, most=1)


# --- actions -----------------------------------------------------------------------------------------------------


def join(tokens, start, nodes: list[Node]) -> list[Node]:
    """One text of all words, with blanks between."""
    return [Node(nodes[0].name if len(nodes) == 1 else "", " ".join(w for n in nodes for w in n.words()))]


def merge(tokens, start, nodes: list[Node]) -> list[Node]:
    """One text of all words, without blanks between."""
    return [Node(nodes[0].name if len(nodes) == 1 else "", "".join(w for n in nodes for w in n.words()))]


def flatten(tokens, start, nodes: list[Node]) -> list[Node]:
    """The parts of the nodes instead of the nodes."""
    return [p for n in nodes for p in (n.parts or (n,))]


def strip_stop(tokens, start, nodes: list[Node]) -> list[Node]:
    return [replace(n, text=n.text.removesuffix(".")) if n.text else n for n in nodes]


def tidy(text: str) -> str:
    """A text joined from tokens, without the blanks that tokens brought."""
    text = re.sub(r"\s+([,.;:)\]}%])", r"\1", text)
    text = re.sub(r"([(\[{])\s+", r"\1", text)
    text = re.sub(r"\s*([-‐‑–/′])\s*", lambda m: m[1] if m[1] in "-‐‑/′" else m[0], text)
    return text.strip()


def fix_whitespace(tokens, start, nodes: list[Node]) -> list[Node]:
    return [replace(n, text=tidy(n.text)) if n.text else n for n in nodes]


def trigger_column(text: Column, words: Sequence[str]) -> Column:
    """A cheap filter before any pattern: whether a sentence has one of the words. It lets through every sentence
    in which a pattern built on the words can match, so it may go before the Python stage."""
    return text.rlike("(?iU)" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words))
