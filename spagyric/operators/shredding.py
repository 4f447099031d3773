"""Nested JSON records as related flat tables.

Each leaf path of a payload is a column of (value, repetition level, definition level), as in columnar files: levels are
kept for every entry, whether it holds a value or not. The leaves of a batch are found first, then each record is walked
once and writes all of them. A table for a repeated ancestor is rebuilt from the level sequences of the leaves below it, by
array operations: repetition levels tell which position moves on, definition levels which entries hold a value, and so
whether a member is there at all.

Defined cases: a null or cut-off payload and one that is no object give no row; a single value instead of an
array has position 0; null and empty members keep their position and give no row; a name of a class around an
object (capitalised, the only key) is no level; a value under a path that expects objects is a leaf of its
parent; of equal keys the last counts; repeated records stay repeated.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repeated ancestors of the records of the built-in models: those of objects, and those of plain values.
OBJECTS = ("peaks", "peaks/coupling", "compound")
VALUES = ("compound/names", "compound/labels", "compound/roles")


def unwrapped(x):
    """The object itself, without class names around it."""
    while isinstance(x, dict) and len(x) == 1:
        (name, inner), = x.items()
        if not name[:1].isupper() or not (inner is None or isinstance(inner, dict)):
            break
        x = inner
    return x


Column = tuple[list, list[int], list[int]]  # values, repetition levels, definition levels


class Node:
    """A path of the batch's schema: an object, an object in a repeated ancestor, repeated values, or a value."""

    __slots__ = ("name", "path", "repeated", "children", "leaf", "plain", "below")

    def __init__(self, name: str, path: str, repeated: bool):
        self.name, self.path, self.repeated = name, path, repeated
        self.children: dict[str, Node] = {}
        self.leaf = False  # a value, or repeated values
        self.plain = False  # also met as a value where objects are expected
        self.below: list[Column] = []


class Shredder:
    """The leaf columns of a batch of records."""

    def __init__(self, objects: tuple[str, ...] = OBJECTS, values: tuple[str, ...] = VALUES):
        self.objects, self.scalars = frozenset(objects), frozenset(values)
        self.columns: dict[str, Column] = {}
        self.root = Node("", "", False)
        self.records = 0

    def steps(self, leaf: str) -> list[tuple[str, bool]]:
        """(name, repeated) from the root to the leaf. A leaf under the name of an object path that is itself
        a plain value is written with '=' in front of its last name and isn't repeated."""
        out, path = [], ""
        for name in leaf.split("/"):
            path = f"{path}/{name}" if path else name
            out.append((name.lstrip("="), path in self.objects or path in self.scalars))
        return out

    def deepest(self, leaf: str) -> int:
        """The definition level of a value: one for each step, as every step may be absent."""
        return len(leaf.split("/")) + self.steps(leaf)[-1][1]

    def add(self, records: list) -> None:
        records = [unwrapped(x) for x in records]
        for x in records:
            if isinstance(x, dict):
                self._find(self.root, x)
        self._lay_out(self.root)
        for x in records:
            self._write(self.root, x if isinstance(x, dict) else {}, 0, 0, 0)
            self.records += 1

    def _find(self, node: Node, x: dict) -> None:
        """Paths that a record has and the schema hasn't."""
        known = node.children
        for name, value in x.items():
            child = known.get(name)
            if value.__class__ is str and child is not None and (child.leaf or child.plain):
                continue
            value = unwrapped(value)
            if value is None:
                continue
            if child is None:
                step = name.replace("/", "~1")  # a name may hold what parts the steps of a path
                path = f"{node.path}/{step}" if node.path else step
                child = Node(name, path, path in self.objects or path in self.scalars)
                child.leaf = path in self.scalars
                known[name] = child
            if child.path in self.objects:
                for member in value if isinstance(value, list) else (value,):
                    member = unwrapped(member)
                    if isinstance(member, dict):
                        self._find(child, member)
                child.plain |= not isinstance(value, (dict, list))
            elif child.path not in self.scalars:
                if isinstance(value, dict):
                    self._find(child, value)
                else:
                    child.leaf = True

    def _lay_out(self, node: Node) -> list[Column]:
        """Gives each leaf its column; one not met before is absent from all records so far."""

        def column(path: str) -> Column:
            return self.columns.setdefault(path, ([None] * self.records, [0] * self.records, [0] * self.records))

        node.below = [column(node.path)] if node.leaf else []
        if node.plain:
            at = node.path.rfind("/") + 1
            node.below.append(column(f"{node.path[:at]}={node.path[at:]}"))
        for child in node.children.values():
            node.below += self._lay_out(child)
        return node.below

    def _write(self, node: Node, x: dict, r: int, depth: int, d: int) -> None:
        """All leaves below an object: r is the repetition level of their first entries, depth the number of repeated
        ancestors, d the definition level that is reached."""
        for name, child in node.children.items():
            value = x.get(name)
            if value.__class__ is not str:
                value = unwrapped(value)
            if value is None or value.__class__ is list and not value:
                _absent(child.below, r, d)
            elif not child.repeated:
                self._single(child, value, r, depth, d)
            else:
                first = r
                for k, member in enumerate(value if value.__class__ is list else (value,)):
                    rep = first if k == 0 else depth + 1
                    if child.leaf:
                        full = member is not None and member != "" and member.__class__ not in (dict, list)
                        _put(child.below[0], member if full else None, rep, d + 1 + full)
                        continue
                    below = child.below
                    if child.plain:  # stands beside the members, once
                        if k == 0:
                            full = value.__class__ not in (dict, list) and value != ""
                            _put(below[0], value if full else None, first, d + full)
                        below = below[1:]
                    member = unwrapped(member)
                    if member.__class__ is dict:
                        self._write(child, member, rep, depth + 1, d + 1)
                    else:
                        _absent(below, rep, d + 1)

    def _single(self, child: Node, value, r: int, depth: int, d: int) -> None:
        below = child.below
        if child.leaf:
            full = value != "" and value.__class__ not in (dict, list)
            _put(below[0], value if full else None, r, d + full)
            if len(below) == 1:
                return
            below = below[1:]
        if value.__class__ is dict:
            self._write(child, value, r, depth, d + 1)
        else:
            _absent(below, r, d)

    def entries(self, leaf: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, which, depth) of the entries of a leaf that hold a value, by its levels alone: a row is the record and
        the position at each repeated level, which the index among all entries."""
        _, reps, defs = self.columns[leaf]
        r, d = np.array(reps, np.int32), np.array(defs, np.int32)
        depth = sum(repeated for _, repeated in self.steps(leaf))
        place = np.empty((len(r), depth + 1), np.int64)
        place[:, 0] = np.cumsum(r == 0) - 1
        for level in range(1, depth + 1):
            moved = np.cumsum(r == level)
            place[:, level] = moved - np.maximum.accumulate(np.where(r < level, moved, 0))
        there = np.flatnonzero(d == self.deepest(leaf))
        return place[there], there, depth

    def leaves_of(self, ancestor: str) -> tuple[int, list[str]]:
        """The depth of a repeated ancestor, and the leaves below it ('' is the record itself)."""
        names = ancestor.split("/") if ancestor else []
        depth = sum("/".join(names[: i + 1]) in self.objects | self.scalars for i in range(len(names)))
        return depth, [x for x in self.columns if not ancestor or x == ancestor or x.startswith(ancestor + "/")]

    def members(self, ancestor: str) -> np.ndarray:
        """(record, position at each repeated level), once each and in order, of the members that hold a value."""
        depth, leaves = self.leaves_of(ancestor)
        parts = [self.entries(x)[0][:, : depth + 1] for x in leaves]
        every = np.concatenate(parts) if parts else np.zeros((0, depth + 1), np.int64)
        if not len(every):
            return every
        size = every.max(axis=0) + 1
        if np.prod(size.astype(float)) >= 2**62:
            return np.unique(every, axis=0)
        number = np.unique(np.ravel_multi_index(tuple(every.T), tuple(size)))
        return np.stack(np.unravel_index(number, tuple(size)), axis=1)

    def rows(self, ancestor: str) -> dict[tuple[int, ...], dict[str, str]]:
        """Each of ``members`` with its fields, which are those not in a deeper repeated ancestor."""
        depth, leaves = self.leaves_of(ancestor)
        out: dict[tuple[int, ...], dict[str, str]] = {tuple(x): {} for x in self.members(ancestor).tolist()}
        for leaf in leaves:
            place, there, own = self.entries(leaf)
            if own == depth:
                field = "value" if leaf == ancestor else leaf[len(ancestor) + 1 if ancestor else 0 :].replace("=", "")
                values = self.columns[leaf][0]
                for at, i in zip(place.tolist(), there.tolist()):
                    out[tuple(at)][field] = values[i] if isinstance(values[i], str) else json.dumps(values[i])
        return out


def _put(out: Column, value, r: int, d: int) -> None:
    out[0].append(value)
    out[1].append(r)
    out[2].append(d)


def _absent(columns: list[Column], r: int, d: int) -> None:
    for values, reps, defs in columns:
        values.append(None)
        reps.append(r)
        defs.append(d)


def parsed(payload: str | None):
    """The object that the text is, or None."""
    if payload is None:
        return None
    try:
        x = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def path_of(ancestor: str, tables: frozenset[str], positions) -> tuple[str, str]:
    """(path, path of the parent) of a member of a repeated ancestor."""
    path, parent, so_far, todo = "", "", "", list(positions)
    for level in ancestor.split("/") if ancestor else ():
        so_far = f"{so_far}/{level}" if so_far else level
        path = f"{path}/{level}" if path else level
        if so_far in tables:
            parent, path = parent if len(todo) == 1 else f"{path}/{todo[0]}", f"{path}/{todo.pop(0)}"
    return path, parent


def _shredders(keys: list, payloads: list, objects, values, size: int = 2000) -> Iterator[tuple[list, Shredder]]:
    """(keys of the records, their shredder) by so many records that their levels stay small."""
    sys.setrecursionlimit(max(20_000, sys.getrecursionlimit()))  # payloads may be nested deeply
    for at in range(0, len(keys), size):
        docs = [(k, x) for k, x in zip(keys[at : at + size], map(parsed, payloads[at : at + size])) if x is not None]
        shredder = Shredder(objects, values)
        shredder.add([x for _, x in docs])
        yield [k for k, _ in docs], shredder


def shred(df: DataFrame, key: str, payload: str, objects: tuple[str, ...] = OBJECTS, values: tuple[str, ...] = VALUES) -> DataFrame:
    """(key, name, path, parent, fields) of the records themselves (name and path '') and of every member of a
    repeated ancestor; path has the positions, parent is the path of the row it belongs to, fields a MAP."""
    kind = df.schema[key].dataType.simpleString()
    tables = frozenset({*objects, *values})

    def run(batches):
        for batch in batches:
            for keys, shredder in _shredders(list(batch[key]), list(batch[payload]), objects, values):
                out = []
                for name in ("", *sorted(tables)):
                    for (record, *positions), fields in shredder.rows(name).items():
                        path, parent = path_of(name, tables, positions)
                        out.append((keys[record], name, path, parent if name else None, fields))
                yield pd.DataFrame(out, columns=[key, "name", "path", "parent", "fields"])

    return df.select(key, payload).mapInPandas(run, f"`{key}` {kind}, name string, path string, parent string, fields map<string,string>")


def child_paths(df: DataFrame, key: str, payload: str, names: tuple[str, ...], objects: tuple[str, ...] = OBJECTS, values: tuple[str, ...] = VALUES) -> DataFrame:
    """(key, path) of the members of some repeated ancestors: what ``shred`` gives of them, from the levels alone."""
    kind = df.schema[key].dataType.simpleString()
    tables = frozenset({*objects, *values})
    # '{}' where the positions go, as 'peaks/{}/coupling/{}'
    form = {name: path_of(name, tables, ["{}"] * 9)[0] for name in names}

    def run(batches):
        for batch in batches:
            for keys, shredder in _shredders(batch.column(0).to_pylist(), batch.column(1).to_pylist(), objects, values):
                owner = pa.array(keys, batch.column(0).type)
                for name in names:
                    rows = shredder.members(name)
                    if len(rows):
                        paths = list(map(form[name].format, *rows[:, 1:].T.tolist()))
                        yield pa.RecordBatch.from_arrays([owner.take(pa.array(rows[:, 0])), pa.array(paths, pa.string())], [key, "path"])

    return df.select(key, payload).mapInArrow(run, f"`{key}` {kind}, path string")


def flat_table(shredded: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """One of the tables, its fields as columns of type STRING; ``parent`` refers to the parent's path."""
    return shredded.where(F.col("name") == name).select(key, "path", "parent", *(F.col("fields")[f].alias(f) for f in fields))
