"""Byte-pair encoding of a text column with a public vocabulary.

Words are merged in padded integer matrices, one matrix per bucket of lengths: in every round each row
merges its leftmost pair of minimum rank, the ranks of pairs come from an open-addressing hash table held
in numpy, and rows and columns are compacted after the round. Equal words are merged once per worker.

Text is cut before it is matched against the word pattern: a single blank between two characters that
are no white space always begins a word, so the runs between such blanks are looked up whole and the
pattern runs only over runs not met before.

Defined cases: a null and an empty text give no ids; strings that look like special tokens are ordinary
text; any length is encoded whole; extra columns are never read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
_WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
_PIECE = 1 << 20  # characters of text in work at a time
_KEEP = 400_000  # runs and words remembered by a worker


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; without a path the one of the installed public package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """(left id, right id) -> merged id, by linear probing in two flat arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._hash(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], at[rest]
            at = np.where(self.keys[at] != -1, (at + 1) & (size - 1), at)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.int64) << 20) | right).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        out = np.full(len(keys), _NONE, np.int32)
        open_ = np.flatnonzero(keys >= 0)
        at = self._hash(keys[open_])
        while len(open_):
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Encoder:
    """Ids of texts under one vocabulary; keeps what it has met in bounded tables."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        pairs = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = {word: rank for word, rank in ranks.items() if len(word) > 1}
        self.split = regex.compile(WORD_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.runs: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = self.bytes_[[w[0]]]
            elif (rank := self.whole.get(w)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(w) > _WIDTHS[-1]:
                out[i] = self._merge_long(w)
            else:
                by_width.setdefault(next(x for x in _WIDTHS if x >= len(w)), []).append(i)
        for width, rows in by_width.items():
            for k in range(0, len(rows), 8192):
                self._merge_matrix(words, rows[k : k + 8192], width, out)
        return out

    def _merge_matrix(self, words: list[bytes], rows: list[int], width: int, out: list) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        for k, i in enumerate(rows):
            ids[k, : len(words[i])] = self.bytes_[np.frombuffer(words[i], np.uint8)]
        owner, column = np.array(rows), np.arange(width)
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1)  # the leftmost of the smallest
            low = rank[np.arange(len(at)), at]
            done = low == _NONE
            if done.any():
                for i, row in zip(owner[done].tolist(), ids[done]):
                    out[i] = row[row >= 0]
                ids, rank, owner, at, low = ids[~done], rank[~done], owner[~done], at[~done], low[~done]
            if not len(owner):
                return
            n, rows_ = ids.shape[1], np.arange(len(owner))
            ids[rows_, at] = low
            keep = column[: n - 1] + (column[: n - 1] > at[:, None])  # closes the gap behind the merged pair
            ids = np.take_along_axis(ids, keep, axis=1)
            if n == 2:
                rank = np.full((len(owner), 1), _NONE, np.int32)
                ids = np.concatenate([ids, np.full((len(owner), 1), -1, np.int32)], axis=1)
                continue
            rank = np.take_along_axis(rank, np.minimum(keep[:, : n - 2], n - 2), axis=1)
            right = np.minimum(at, n - 3)
            rank[rows_, right] = self.pairs.ranks(ids[rows_, right], ids[rows_, right + 1])
            left = np.maximum(at - 1, 0)
            rank[rows_, left] = self.pairs.ranks(ids[rows_, left], ids[rows_, left + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One very long word: a round merges every occurrence of the minimum pair, from the left. A pair with
        a part made in a round ranks behind that round's pair, so the result is that of single merges."""
        ids = self.bytes_[np.frombuffer(word, np.uint8)]
        rank = self.pairs.ranks(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != _NONE:
            at = np.flatnonzero(rank == low)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping ones, each second in a run
                first = np.concatenate([[True], np.diff(at) > 1])
                start = np.maximum.accumulate(np.where(first, at, 0))
                at = at[(at - start) % 2 == 0]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids = ids[keep]
            drop = np.ones(len(rank), bool)
            drop[np.minimum(at + 1, len(rank) - 1)] = False
            if at[-1] == len(rank) - 1:
                drop[at[-1]] = False
                drop[at[:-1] + 1] = False
            rank = rank[drop]
            if len(ids) < 2:
                break
            touched = np.unique(np.concatenate([moved, moved - 1]))
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            rank = rank[: len(ids) - 1] if len(rank) >= len(ids) - 1 else np.concatenate([rank, np.full(len(ids) - 1 - len(rank), _NONE, np.int32)])
            rank[touched] = self.pairs.ranks(ids[touched], ids[touched + 1])
        return ids

    def words_of(self, texts: Iterable[list[str]]) -> None:
        """Make the ids of all these words known."""
        new = list({w for ws in texts for w in ws}.difference(self.words))
        self.words.update(zip(new, (x.tolist() for x in self.merge([w.encode() for w in new]))))

    def _learn(self, runs: set[str]) -> None:
        new = list(runs.difference(self.runs))
        if not new:
            return
        split = [self.split(r) for r in new]
        self.words_of(split)
        word = self.words
        ids = list(chain.from_iterable(map(word.__getitem__, chain.from_iterable(split))))
        size = np.fromiter((len(word[ws[0]]) if len(ws) == 1 else sum(len(word[w]) for w in ws) for ws in split), np.int32, len(new))
        start = np.cumsum(size, dtype=np.int64) - size + len(self.pool)
        self.runs.update(zip(new, range(len(self.runs), len(self.runs) + len(new))))
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.array(ids, np.int32)])

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every run, and how many runs each text has."""
        runs, count = [], []
        for t in texts:
            cut = runs_of(t)
            runs += cut
            count.append(len(cut))
        if len(self.runs) > _KEEP or len(self.words) > _KEEP or len(self.pool) > 20 * _KEEP:
            self.forget()
        self._learn(set(runs))
        return np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs)), np.array(count, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        slot, count = self._slots(texts)
        size = self.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.start[slot], size)
        return self.pool[at], _sums(size, count)

    def sizes(self, runs: list[str]) -> np.ndarray:
        """How many ids each of these parts of a text has; parts must not tear words."""
        if len(self.runs) > _KEEP or len(self.words) > _KEEP or len(self.pool) > 20 * _KEEP:
            self.forget()
        self._learn(set(runs))
        return self.size[np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs))].astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        slot, count = self._slots(texts)
        return _sums(self.size[slot].astype(np.int64), count)


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


_odd_blank = re.compile(r"\s | \s").search
_even_blank = re.compile(r"(?<=\S) (?=\S)").split


def runs_of(text: str) -> list[str]:
    """The text cut before each single blank that stands between two other characters."""
    parts = text.split(" ") if not _odd_blank(text) else _even_blank(text)
    return [p for p in [parts[0], *[" " + p for p in parts[1:]]] if p]


def pieces(texts: list[str | None], size: int = _PIECE) -> Iterator[list[str]]:
    """Consecutive texts, null as empty, together about ``size`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(t or "")
        if n > size:
            yield part
            part, n = [], 0
    if part:
        yield part


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The worker's encoder for this vocabulary, made once."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids) of every row, ids as ARRAY<INT>; no shuffle. Repeated rows stay repeated."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # one file of about 1 MB

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            keys, at = batch.column(0), 0
            for part in pieces(batch.column(1).to_pylist(), _PIECE):
                flat, count = enc.encode(part)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), lists], [key, ids])
                at += len(part)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_column(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None, n: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``, which isn't carried on."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    k = len(keep)

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            counts = [enc.count(part) for part in pieces(batch.column(k).to_pylist(), _PIECE)]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(total, pa.int64())], [*keep, n])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, `{n}` bigint")
