"""One surviving record for each group of duplicates, built from bundles of dependent fields.

Records of one document are duplicates if they share a name or a label and state the same melting point.
Fields that depend on each other (a value and its unit) form a bundle that is taken whole from one record.
The choice of a record for every field is a branch and bound over fields that maximises trust, under functional
dependencies: fields of which one gives the other its meaning must come from one record.

Before that search a group is reduced to the best record of each pattern of filled fields, so at most
2 ** fields candidates of a group meet in one place, however many records it has; the result is the same,
as records of one pattern compete in the same fields. All that is needed of a record is made before the one shuffle by
document: its value in kelvin, hashes of its plain names and labels, a bit for each field it fills, and its trust.

Defined cases: records without compound, without known unit or without document are in no group; null, empty
and placeholder values fill nothing; ties go to the smallest rec_id; a group whose records all lack a bundle
gets none. Rows delivered twice count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spagyric.llm.graph import components
from spagyric.llm.plainform import comparable, elements, rewriter
from spagyric.operators.quantities import melting_points, with_interval
from spagyric.session import shared_checkpoints

#: Texts that stand for a missing value.
PLACEHOLDERS = ["", "-", "–", "n/a", "unknown", "not given"]
#: The fields of a record, the bundles that are taken whole, and the dependencies: the first decides what the second
#: means, so both come from one record.
FIELDS = ("raw_value", "raw_units", "names", "labels", "solvent", "apparatus")
BUNDLES = {"quantity": ("raw_value", "raw_units"), "names": ("names",), "labels": ("labels",), "solvent": ("solvent",), "apparatus": ("apparatus",)}
DEPENDENT = (("raw_value", "raw_units"),)
#: Documents of up to this many records are grouped within one row.
LOCAL = 5_000
#: Melting points are the same up to this many kelvin at both ends.
TOLERANCE = 1.0
_SLACK = 1e-6  # for values that come from decimal fractions


def filled(c: Column) -> Column:
    """Whether a text is one, and no placeholder."""
    return F.coalesce(~F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).isin(PLACEHOLDERS), F.lit(False))


def filled_array(c: Column) -> Column:
    return F.coalesce(F.exists(c, filled), F.lit(False))


@F.pandas_udf(T.ArrayType(T.LongType()))
def local_groups(rec: pd.Series, low: pd.Series, high: pd.Series, tokens: pd.Series) -> pd.Series:
    """For each document (parallel arrays of its records) the least record of each record's group."""
    return pd.Series([group_within(*args) for args in zip(rec, low, high, tokens)])


def group_within(rec, low, high, tokens) -> list[int]:
    """The least record that each record is linked with, by chains of records that share a token and state the same value.

    Records of one token are put in cells of the tolerance's width; all in one cell are linked through its first, those
    of neighbouring cells are compared after copies are contracted.
    """
    parent = list(range(len(rec)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    by_token: dict = {}
    for i, ts in enumerate(tokens):
        for t in ts:
            by_token.setdefault(t, []).append(i)
    for rows in by_token.values():
        if len(rows) == 1:
            continue
        cells: dict[tuple[int, int], dict[tuple[float, float], int]] = {}
        for i in rows:
            cell = cells.setdefault((math.floor(low[i] / TOLERANCE), math.floor(high[i] / TOLERANCE)), {})
            unite(cell.setdefault((low[i], high[i]), i), i)
            unite(next(iter(cell.values())), i)
        for (x, y), cell in cells.items():
            for at in ((x, y + 1), (x + 1, y - 1), (x + 1, y), (x + 1, y + 1)):
                other = cells.get(at)
                if other and any(abs(l1 - l2) <= TOLERANCE + _SLACK and abs(h1 - h2) <= TOLERANCE + _SLACK for l1, h1 in cell for l2, h2 in other):
                    unite(next(iter(cell.values())), next(iter(other.values())))
    least: dict[int, int] = {}
    for i, r in enumerate(rec):
        k = root(i)
        least[k] = min(least.get(k, r), r)
    return [int(least[root(i)]) for i in range(len(rec))]


def same_statement(points: DataFrame) -> DataFrame:
    """Edges (u, v) between records that share a key and whose ends differ by at most the tolerance, or
    between such records and a representative that links them alike: for documents of any size.

    points: (doc_id, token, rec_id, low, high). Equal points are contracted to their least record first. The
    others are put in cells of the tolerance's width: all in one cell are linked through its least
    record; points of neighbouring cells are compared with each other after that contraction.
    """
    place = ["doc_id", "token", "low", "high"]
    least = points.groupBy(*place).agg(F.min("rec_id").alias("r"))
    copies = points.join(least, place).where("rec_id <> r").select(F.col("rec_id").alias("u"), F.col("r").alias("v"))
    cell = lambda c: F.floor(F.col(c) / TOLERANCE).cast("bigint")
    cells = least.withColumns({"x": cell("low"), "y": cell("high")})
    first = cells.groupBy("doc_id", "token", "x", "y").agg(F.min("r").alias("v"))
    within = cells.join(first, ["doc_id", "token", "x", "y"]).select(F.col("r").alias("u"), "v")
    ahead = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    left = cells.select("doc_id", "token", F.col("r").alias("u"), F.col("low").alias("l1"), F.col("high").alias("h1"), "x", "y", ahead.alias("o"))
    left = left.select("doc_id", "token", "u", "l1", "h1", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    near = (F.abs(F.col("l1") - F.col("low")) <= TOLERANCE + _SLACK) & (F.abs(F.col("h1") - F.col("high")) <= TOLERANCE + _SLACK)
    across = left.join(cells, ["doc_id", "token", "x", "y"]).where(near).select("u", F.col("r").alias("v"))
    return copies.unionByName(within).unionByName(across).where("u <> v")


def tokens(compound: Column, plain: Callable[[Column], Column]) -> Column:
    """ARRAY<BIGINT> of hashes of the names and labels of a compound, in plain form and apart from case."""
    def of(f: str) -> Column:
        texts = F.filter(F.coalesce(compound[f], F.array().cast("array<string>")), filled)
        return F.transform(texts, lambda x: F.concat(F.lit(f[0] + "\t"), F.translate(x, "\n", "\t")))

    every = F.concat(of("names"), of("labels"))
    joined = F.split(plain(F.array_join(every, "\n")), "\n")  # one call for all texts of a record
    parts = F.transform(joined, lambda x: F.struct(F.substring(x, 1, 1).alias("f"), comparable(F.substring(x, 3, 2**31 - 1)).alias("t")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p["t"] != ""), lambda p: F.xxhash64(p["f"], p["t"])))


def duplicate_groups(points: DataFrame, most: int = LOCAL) -> DataFrame:
    """``points`` with ``first_rec_id``, the least record of each record's group, for records in a group of two or more.

    points: (doc_id, rec_id, low, high, tokens, ...). Documents of up to ``most`` records are grouped in one row each; those
    of any more by joins and components over the whole cluster, with the same result.
    """
    sizes = points.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("doc_id").checkpoint()
    large = sizes.count()
    small = points
    out = []
    if large:
        small = points.join(sizes, "doc_id", "left_anti")
        vast = points.join(sizes, "doc_id").dropDuplicates(["rec_id"]).checkpoint()
        flat = vast.select("doc_id", F.explode("tokens").alias("token"), "rec_id", "low", "high")
        groups = components(same_statement(flat)).select(F.col("node").alias("rec_id"), F.col("component").alias("first_rec_id"))
        out.append(vast.join(groups, "rec_id").select(*points.columns, "first_rec_id"))
    rows = F.array_sort(F.collect_list(F.struct("rec_id", *(c for c in points.columns if c not in ("doc_id", "rec_id")))))  # at most ``most``
    once = F.filter("rows", lambda x, i: (i == 0) | (F.get(F.col("rows"), i - 1)["rec_id"] != x["rec_id"]))  # rows delivered twice
    docs = small.groupBy("doc_id").agg(rows.alias("rows")).withColumn("rows", once).where("size(rows) > 1")
    docs = docs.withColumn("firsts", local_groups(F.col("rows.rec_id"), F.col("rows.low"), F.col("rows.high"), F.col("rows.tokens")))
    each = docs.select("doc_id", F.explode(F.arrays_zip("rows", "firsts")).alias("z")).select("doc_id", "z.rows.*", F.col("z.firsts").alias("first_rec_id"))
    of = Window.partitionBy("doc_id", "first_rec_id")  # below the explosion: no more rows than one document has
    out.append(each.withColumn("_n", F.count("*").over(of)).where("_n > 1").select(*points.columns, "first_rec_id"))
    return reduce(DataFrame.unionByName, out)


def choose(candidates: list[dict], bundles: tuple[str, ...], together: tuple[tuple[str, str], ...] = ()) -> dict[str, int]:
    """bundle -> index of the candidate that supplies it, by branch and bound.

    candidates: dicts with 'key' (smaller is more trusted, compared as a tuple) and the set 'fills'. A choice is
    better if it fills more bundles, then if its bundles' ranks are smaller in sum. together: pairs of bundles
    of which, if both are supplied, one record must supply both.
    """
    rank = {i: n for n, i in enumerate(sorted(range(len(candidates)), key=lambda i: candidates[i]["key"]))}
    open_ = [b for b in bundles if any(b in c["fills"] for c in candidates)]
    options = {b: sorted((i for i, c in enumerate(candidates) if b in c["fills"]), key=rank.__getitem__) for b in open_}
    bound = [0] * (len(open_) + 1)  # the least cost of the bundles from k on
    for k in range(len(open_) - 1, -1, -1):
        bound[k] = bound[k + 1] + rank[options[open_[k]][0]]
    best: tuple[tuple[int, int], dict[str, int]] = ((len(open_) + 1, 0), {})

    def branch(k: int, missing: int, cost: int, taken: dict[str, int]) -> None:
        nonlocal best
        if (missing, cost + bound[k]) >= best[0]:
            return
        if k == len(open_):
            best = ((missing, cost), dict(taken))
            return
        b = open_[k]
        bound_to = {taken[x if y == b else y] for x, y in together if b in (x, y) and (x if y == b else y) in taken}
        for i in options[b]:
            if bound_to <= {i}:
                branch(k + 1, missing, cost + rank[i], {**taken, b: i})
        if together:
            branch(k + 1, missing + 1, cost, taken)

    branch(0, 0, 0, {})
    return best[1]


def candidates(mp: DataFrame, sentences: DataFrame, trust: DataFrame) -> DataFrame:
    """(doc_id, rec_id, low, high, tokens, fills, key) of the records that can be in a group: the value in kelvin, what
    they are compared by, the fields they fill (as a bit for each of ``FIELDS``) and their trust: the method's number in
    ``trust`` (a small dimension; unlisted last), then the latest extracted_at, then the smallest rec_id."""
    late = F.lit(2**31 - 1)
    rows = mp.where("doc_id is not null and rec_id is not null and compound is not null")
    rewrite = rewriter(elements(rows), "text")
    rows = rows.withColumn("_some", F.exists(F.concat(*(F.coalesce(F.col(f"compound.{f}"), F.array().cast("array<string>")) for f in ("names", "labels"))), filled)).where("_some")
    columns = {"names": filled_array(F.col("compound.names")), "labels": filled_array(F.col("compound.labels")), "solvent": filled(F.col("solvent")), "apparatus": filled(F.col("apparatus"))}
    bits = reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << FIELDS.index(f))).otherwise(F.lit(0)) for f, c in columns.items()))
    rows = rows.withColumns({"fills": bits, "time": -F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(2**62))), "tokens": tokens(F.col("compound"), rewrite)})
    keep = ["doc_id", "fills", "time", "tokens", "method"]
    values = with_interval(melting_points(rows, sentences, keep)).where("low is not null and unit is not null")
    values = values.join(trust.select("method", "trust").where("method is not null").dropDuplicates(["method"]), "method", "left")
    both = F.lit(sum(1 << FIELDS.index(f) for f in ("raw_value", "raw_units")))
    key = F.struct(F.coalesce("trust", late).alias("t"), F.col("time").alias("e"), F.col("rec_id").alias("r"))
    return values.select("doc_id", "rec_id", "low", "high", "tokens", F.col("fills").bitwiseOR(both).alias("fills"), key.alias("key"))


def survivors(mp: DataFrame, sentences: DataFrame, trust: DataFrame, together: tuple[tuple[str, str], ...] = DEPENDENT) -> DataFrame:
    """(first_rec_id, field, rec_id): the record that supplies each bundle of each group. Of bundles that a dependency
    leaves without a record nothing is given."""
    shared_checkpoints(mp.sparkSession)
    points = candidates(mp, sentences, trust).checkpoint()
    # all groupings keep the document in front, by which the rows are parted already
    best = duplicate_groups(points).groupBy("doc_id", "first_rec_id", "fills").agg(F.min("key").alias("key"))
    few = best.groupBy("doc_id", "first_rec_id").agg(F.collect_list(F.struct("fills", "key")).alias("candidates"))  # at most 2 ** fields
    return chosen(few, together)


def chosen(few: DataFrame, together: tuple[tuple[str, str], ...] = DEPENDENT) -> DataFrame:
    """(first_rec_id, field, rec_id) by branch and bound over the candidates of each group, field being a bundle."""
    names = {frozenset(fields): name for name, fields in BUNDLES.items()}

    def pick(batches):
        done: dict = {}  # groups whose candidates fill alike, in the same order of trust, choose alike
        for b in batches:
            out = []
            for first, rows in zip(b["first_rec_id"], b["candidates"]):
                rows = sorted((c["key"]["t"], c["key"]["e"], c["key"]["r"], c["fills"]) for c in rows)
                shape = tuple(r[3] for r in rows)
                if shape not in done:
                    found = choose([{"key": (i,), "fills": {f for k, f in enumerate(FIELDS) if m >> k & 1}} for i, m in enumerate(shape)], FIELDS, together)
                    done[shape] = [(name, found[next(iter(fields))]) for fields, name in names.items() if all(f in found for f in fields)]
                out += [(first, name, rows[i][2]) for name, i in done[shape]]
            yield pd.DataFrame(out, columns=["first_rec_id", "field", "rec_id"])

    return few.select("first_rec_id", "candidates").mapInPandas(pick, "first_rec_id bigint, field string, rec_id bigint")
