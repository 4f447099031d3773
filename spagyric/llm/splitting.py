"""Oversized texts cut at natural boundaries into pieces under a limit of tokens, with overlap.

A text consists of units: words with the blank in front, line ends, and of very long words the runs of letters, digits and
signs. Between units no token can reach, so lengths in tokens add up exactly. A piece ends at the last line end within
the limit, else at the last sentence end, else at the last unit; the next one begins up to ``overlap`` tokens before, at
the earliest boundary between units. A unit above the limit is torn into runs of characters, and pieces of such
runs are counted as they stand.

Texts of up to one range are cut where they are read. Longer ones, and files by byte ranges that no task reads whole, are
handled by ranges: each, with a halo of its neighbours, is searched for its first boundary on its own; the boundaries
of a text are stitched to segments; segments are measured on their own; and one pass over the measures of a text, which
streams them and holds a piece's worth, sets the ends of pieces by prefix sums. Texts take part again only when pieces
are emitted by offset. The result is the same whatever the size of a range.

Defined cases: null and empty texts have no tokens and no pieces; texts within the limit aren't cut and give
no pieces; offsets count characters from 0; repeated rows need distinct keys, rows without a key have no pieces. A run of letters alone that is longer than a
range is one segment, as its tokens can't be told from parts of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.llm.bpe import Encoder, encoder, pieces, runs_of, vocabulary_bytes
from spagyric.session import shared_checkpoints

LIMIT, OVERLAP = 512, 64
#: Characters in a range of a long text, or bytes in one of a file.
RANGE = 1 << 15
#: Words of more characters are parted at changes between letters, digits and signs.
LONG_WORD = 512
#: What ends with a stop within a sentence.
ABBREVIATIONS = {"fig.", "figs.", "dr.", "prof.", "no.", "ca.", "e.g.", "i.e.", "vs.", "al.", "ref.", "refs.", "eq.", "eqs.", "approx.", "vol.", "mr.", "mrs.", "st.", "cf.", "abs.", "m.p.", "b.p.", "bzw.", "z.b.", "env."}

#: Where no token reaches across: before white space, and behind a single line end.
_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=\S\n)(?=\S)")
_LINE = re.compile(r"(?<=\S\n)(?=\S)|(?<=\S)(?=\n\s)")
#: Those of them where a segment may begin: what is in front of it changes no unit in it.
_BEGIN = re.compile(r"(?<=\S)(?=[^\S\n])|(?<=\S)(?=\n\s)|(?<=\S\n)(?=\S)")
#: The same within a word; an apostrophe may belong to the letters behind it.
_FINE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_STOP = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


def units(text: str) -> list[str]:
    """The text in the smallest parts that pieces are made of."""
    out: list[str] = []
    for run in runs_of(text):
        parts = [run] if len(run) < 2 or not _inner_blank(run, 1) else [x for x in _CUT.split(run) if x]
        for x in parts:
            if len(x) > LONG_WORD:
                out += [y for y in _FINE.split(x) if y]
            else:
                out.append(x)
    return out


_inner_blank = re.compile(r"\s").search


def ends_of(parts: list[str], follow: str = "") -> np.ndarray:
    """2 for parts behind which a line ends, 1 for those that end a sentence, else 0. follow: what comes behind them."""
    out = np.zeros(len(parts), np.int8)
    for i, p in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) else follow
        if p.endswith("\n") or after[:2].startswith("\n") and after[1:2].isspace():
            out[i] = 2
        elif _STOP.search(p) and p.strip().lower() not in ABBREVIATIONS and not after[:2].strip()[:1].islower():
            out[i] = 1
    return out


class Measures:
    """Units by their characters, tokens and ends; ``torn`` has the texts of runs that are parts of a torn unit."""

    __slots__ = ("chars", "tokens", "ends", "torn")

    def __init__(self, chars, tokens, ends, torn: dict[int, str]):
        self.chars, self.tokens, self.ends, self.torn = chars, tokens, ends, torn


def measured(enc: Encoder, text: str, follow: str = "", limit: int = LIMIT) -> Measures:
    parts = units(text)
    size, ends = enc.sizes(parts), ends_of(parts, follow)
    torn: dict[int, str] = {}
    if len(size) and size.max() > limit:
        run, cut_, kind = max(1, limit // 4), [], []  # a character has at most 4 tokens
        for p, n, e in zip(parts, size.tolist(), ends.tolist()):
            runs = [p] if n <= limit else [p[i : i + run] for i in range(0, len(p), run)]
            if n > limit:
                torn |= {len(cut_) + i: r for i, r in enumerate(runs)}
            cut_ += runs
            kind += [0] * (len(runs) - 1) + [e]
        parts, size, ends = cut_, enc.sizes(cut_), np.array(kind, np.int8)
    return Measures(np.array([len(p) for p in parts], np.int64), size, ends, torn)


class Cutter:
    """Sets the ends of pieces while the measures of a text come in; keeps those of the piece at hand."""

    def __init__(self, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP):
        self.enc, self.limit, self.overlap = enc, limit, overlap
        self.chars, self.tokens, self.ends = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int8)  # sums
        self.torn: dict[int, str] = {}
        self.done, self.pieces, self.total = 0, 0, 0

    def feed(self, m: Measures, last: bool) -> Iterator[tuple[int, int, int, int]]:
        """(piece, start, end, tokens) of the pieces whose ends are certain; all others if nothing follows. A text of one
        piece gives none."""
        n = len(self.ends)
        self.chars = np.concatenate([self.chars, self.chars[-1] + np.cumsum(m.chars)])
        self.tokens = np.concatenate([self.tokens, self.tokens[-1] + np.cumsum(m.tokens)])
        self.ends = np.concatenate([self.ends, m.ends])
        self.torn |= {n + i: t for i, t in m.torn.items()}
        while self.done < len(self.ends) and (last or self.tokens[-1] - self.tokens[self.done] > self.limit):
            if last and not self.pieces and self.exact(0, len(self.ends)) <= self.limit:
                return
            yield self.next()
        self.forget()

    def exact(self, a: int, b: int) -> int:
        """Tokens of the units from a to b, runs of torn ones counted as they stand."""
        total = int(self.tokens[b] - self.tokens[a])
        i = a
        while self.torn and i < b:
            if i in self.torn:
                j = i
                while j < b and j in self.torn:
                    j += 1
                total += int(self.enc.count(["".join(self.torn[k] for k in range(i, j))])[0] - (self.tokens[j] - self.tokens[i]))
                i = j
            i += 1
        return total

    def next(self) -> tuple[int, int, int, int]:
        tokens, done, limit = self.tokens, self.done, self.limit
        start = int(np.searchsorted(tokens, tokens[done] - self.overlap)) if self.pieces else 0
        if tokens[done + 1] - tokens[start] > limit:
            start = int(np.searchsorted(tokens, tokens[done + 1] - limit))
        last = int(np.searchsorted(tokens, tokens[start] + limit, side="right")) - 1
        if last < len(self.ends):
            for kind in (2, 1):
                at = np.flatnonzero(self.ends[done:last] >= kind)
                if len(at) and tokens[done + at[-1] + 1] - tokens[start] > limit // 4:
                    last = done + int(at[-1]) + 1
                    break
        n = self.exact(start, last)
        while n > limit and last > done + 1:
            last -= 1
            n = self.exact(start, last)
        if n > limit:  # the first new unit doesn't go with all of the overlap
            while n > limit and start < done:
                start += 1
                n = self.exact(start, last)
        out = (self.pieces, int(self.chars[start]), int(self.chars[last]), n)
        self.pieces, self.done = self.pieces + 1, last
        return out

    def forget(self) -> None:
        """Drops what no later piece can reach; sums go on from where they were."""
        if self.pieces and (k := int(np.searchsorted(self.tokens, self.tokens[self.done] - self.overlap))) > 0:
            self.chars, self.tokens, self.ends = self.chars[k:], self.tokens[k:], self.ends[k:]
            self.torn = {i - k: t for i, t in self.torn.items() if i >= k}
            self.done -= k


def cut(enc: Encoder, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(piece, start, end, tokens) of the pieces of a text, as offsets."""
    return list(Cutter(enc, limit, overlap).feed(measured(enc, text, "", limit), True))


# --- long texts and files by ranges ------------------------------------------------------------------------------------------


def boundary(view: str, a: int, b: int) -> tuple[int, str] | None:
    """The first place from a to b in a view of a range and its halo where a segment may begin, a line end if there is
    one, and the two characters behind it."""
    for rule in (_LINE, _BEGIN, _FINE):
        for m in rule.finditer(view, a, min(len(view), b + 2)):
            at = m.start()
            if not a <= at < b:
                continue
            if rule is _FINE:  # only in a word that is long enough in this view
                left = next((i for i in range(at - 1, -1, -1) if view[i].isspace()), -1)
                right = next((i for i in range(at, len(view)) if view[i].isspace()), len(view))
                if right - left - 1 <= LONG_WORD:
                    continue
            return at, view[at : at + 2]
    return None


_RANGES = "k int, base bigint, part string, boundary bigint, follow string"


def text_ranges(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, k, base, part, boundary, follow): the ranges of long texts, each text walked once, with the offset of the first
    boundary in each, null if there is none."""

    def run(batches):
        for b in batches:
            for key_, t in zip(b[key], b[text]):
                out = []
                for k, at in enumerate(range(0, len(t), size)):
                    lead = min(at, 2)
                    found = (0, "") if k == 0 else boundary(t[at - lead : at + size + 2], lead, lead + min(size, len(t) - at))
                    out.append((key_, k, at, t[at : at + size], None if found is None else at if k == 0 else at - lead + found[0], None if found is None else found[1]))
                yield pd.DataFrame(out, columns=[key, "k", "base", "part", "boundary", "follow"]).astype({"boundary": "Int64"})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(text) > size).select(key, text).mapInPandas(run, f"`{key}` {kind}, {_RANGES}")


def file_ranges(spark: SparkSession, paths: DataFrame, size: int = RANGE) -> DataFrame:
    """The ranges of UTF-8 files, (path) as URIs: every task reads the bytes of its range and a halo, nothing else. What
    isn't UTF-8 becomes replacement characters. A character belongs to the range in which it begins."""
    from pyarrow import fs

    def lengths(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                where, name = fs.FileSystem.from_uri(p)
                out.append((p, where.get_file_info(name).size))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    def read(batches):
        for b in batches:
            out = []
            for p, total, k in zip(b["path"], b["bytes"], b["k"]):
                where, name = fs.FileSystem.from_uri(p)
                first, last = k * size, min(total, (k + 1) * size)
                lo, hi = max(0, first - 12), min(total, last + 12)
                with where.open_input_file(name) as f:
                    raw = f.read_at(hi - lo, lo)
                begins = lambda i: i >= len(raw) or raw[i] & 0xC0 != 0x80
                edge = [next((j for j in range(x - lo, min(x - lo + 4, len(raw) + 1)) if begins(j)), x - lo) for x in (first, last)]
                low = next((j for j in range(min(4, edge[0] + 1)) if begins(j)), 0)
                before, part, after = (raw[i:j].decode("utf-8", "replace") for i, j in ((low, edge[0]), (edge[0], edge[1]), (edge[1], len(raw))))
                lead = before[-2:]
                found = (len(lead), "") if k == 0 else boundary(lead + part + after[:2], len(lead), len(lead) + len(part))
                out.append((p, k, len(part), part, None if found is None else found[0] - len(lead), None if found is None else found[1]))
            yield pd.DataFrame(out, columns=["path", "k", "base", "part", "boundary", "follow"]).astype({"boundary": "Int64"})

    sized = paths.select("path").mapInPandas(lengths, "path string, bytes bigint").where("bytes > 0")
    each = sized.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size).cast("int"))).alias("k"))
    shared_checkpoints(spark)
    rows = each.repartition("path", "k").mapInPandas(read, f"path string, {_RANGES}").checkpoint()
    place = rows.selectExpr("path", "k", "sum(base) over (partition by path order by k) - base as _before")  # lengths only
    rows = rows.join(place, ["path", "k"])
    return rows.select("path", "k", F.col("_before").alias("base"), "part", (F.col("_before") + F.col("boundary")).alias("boundary"), "follow")


def segments(ranges: DataFrame, key: str) -> DataFrame:
    """(key, begin, follow, body): segments that tile every text, made of the parts of ranges between two boundaries; follow
    is what comes behind. ranges must be kept, as they are read twice."""
    table = ranges.selectExpr(f"`{key}`", "k", "base", "length(part) as _len", "boundary", "follow")  # no texts in it
    table = table.selectExpr("*", f"max(base + _len) over (partition by `{key}`) as _n").where("boundary is not null")
    over = f"over (partition by `{key}` order by k)"
    table = table.selectExpr(f"`{key}`", "boundary as begin", f"coalesce(lead(boundary) {over}, _n) as stop", f"coalesce(lead(follow) {over}, '') as follow", "k as k1", f"lead(k) {over} as k2")
    most = ranges.groupBy(key).agg(F.max("k").alias("_k"))
    needed = table.where("stop > begin").join(most, key).withColumn("k", F.explode(F.sequence("k1", F.coalesce("k2", "_k"))))
    parts = needed.join(ranges.select(key, "k", "base", "part"), [key, "k"])
    a, b = F.greatest("begin", "base"), F.least(F.col("stop"), F.col("base") + F.length("part"))
    parts = parts.where(b > a).select(key, "begin", "follow", "k", F.substring(F.col("part"), (a - F.col("base") + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")  # between two boundaries
    return parts.groupBy(key, "begin", "follow").agg(whole.alias("body"))


def _lengths(rows: DataFrame, key: str, body: str, vocabulary: bytes) -> DataFrame:
    """(key, n_tokens) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            n = [enc.count(part) for part in pieces(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], [key, "n_tokens"])

    return rows.select(key, body).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, vocabulary: str | None = None, size: int = RANGE) -> DataFrame:
    """(key, n_tokens) of the texts of more than ``limit`` tokens; those of long texts are summed over segments. A text of
    at most ``limit`` bytes can't have more tokens."""
    shared_checkpoints(df.sparkSession)
    known = vocabulary_bytes(vocabulary)
    rows = df.select(key, text).where(F.octet_length(text) > limit)
    short = _lengths(rows.where(F.length(text) <= size), key, text, known).where(F.col("n_tokens") > limit)
    ranges = text_ranges(rows, key, text, size).checkpoint()
    long = _lengths(segments(ranges, key), key, "body", known).groupBy(key).agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(long.where(F.col("n_tokens") > limit))


def split_ranges(ranges: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """(key, piece, start, end, n_tokens, text) of the pieces of texts given by their ranges."""
    spark = ranges.sparkSession
    shared_checkpoints(spark)
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    kind = ranges.schema[key].dataType.simpleString()
    held = segments(ranges, key).checkpoint()

    def measure(batches):
        enc = encoder(shared.value)
        for b in batches:
            out = []
            for k, begin, follow, body in zip(b[key], b["begin"], b["follow"], b["body"]):
                m = measured(enc, body, follow, limit)
                out.append((k, begin, m.chars.astype(np.int32), m.tokens.astype(np.int32), m.ends.tobytes(), list(m.torn), list(m.torn.values())))
            yield pd.DataFrame(out, columns=[key, "begin", "chars", "tokens", "ends", "torn", "runs"])

    def place(batches):
        enc = encoder(shared.value)
        cutter, row, told = None, None, []

        def step(row, last: bool) -> list[tuple]:
            nonlocal told
            told.append((int(row[1]), int(row[1]) + int(sum(row[2]))))
            m = Measures(np.asarray(row[2], np.int64), np.asarray(row[3], np.int64), np.frombuffer(row[4], np.int8), dict(zip(map(int, row[5]), row[6])))
            out = []
            for piece, a, b, n in cutter.feed(m, last):
                out += [(row[0], piece, a, b, n, begin, max(a, begin) - begin, min(b, end) - begin) for begin, end in told if begin < b and end > a]
                told = [x for x in told if x[1] > a]
            return out

        columns = [key, "piece", "start", "end", "n_tokens", "begin", "_a", "_b"]
        for batch in batches:  # sorted by key and begin; a text's segments follow each other, also across batches
            out: list[tuple] = []
            for new in batch[[key, "begin", "chars", "tokens", "ends", "torn", "runs"]].itertuples(index=False, name=None):
                other = row is None or new[0] != row[0]
                if row is not None:
                    out += step(row, other)
                if other:
                    cutter, told = Cutter(enc, limit, overlap), []
                row = new
            yield pd.DataFrame(out, columns=columns)
        if row is not None:
            yield pd.DataFrame(step(row, True), columns=columns)

    measures = held.mapInPandas(measure, f"`{key}` {kind}, begin bigint, chars array<int>, tokens array<int>, ends binary, torn array<int>, runs array<string>")
    ordered = measures.repartition(key).sortWithinPartitions(key, "begin")
    places = ordered.mapInPandas(place, f"`{key}` {kind}, piece int, start bigint, end bigint, n_tokens bigint, begin bigint, _a bigint, _b bigint")
    parts = places.join(held.select(key, "begin", "body"), [key, "begin"])
    parts = parts.withColumn("part", F.substring(F.col("body"), (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"]), "")  # of one piece
    return parts.groupBy(key, "piece", "start", "end", "n_tokens").agg(text.alias("text"))


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, size: int = RANGE) -> DataFrame:
    """(key, piece, start, end, n_tokens, text) of the pieces of all texts of more than ``limit`` tokens."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text).where(F.col(key).isNotNull() & (F.octet_length(text) > limit))

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            out = [(k, piece, a, e, n, t[a:e]) for k, t in zip(b[key], b[text]) for piece, a, e, n in cut(enc, t, limit, overlap)]
            yield pd.DataFrame(out, columns=[key, "piece", "start", "end", "n_tokens", "text"])

    short = rows.where(F.length(text) <= size).mapInPandas(run, f"`{key}` {kind}, piece int, start bigint, end bigint, n_tokens bigint, text string")
    return short.unionByName(split_ranges(text_ranges(rows, key, text, size).checkpoint(), key, limit, overlap, vocabulary))
