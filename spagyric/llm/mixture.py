"""A mixture of sources with target weights, in tokens.

Documents are aggregated by membership pattern (the set of sources they may be used for). The token
capacity of the patterns is routed to the quotas of the sources by a min-cost flow whose costs rise with
each repetition; then documents are selected: a pattern's documents, in seeded order, form a ring of tokens,
every source gets an arc of it, and a document is used as often as arcs of a source pass it.

The total is the largest for which all quotas can be met. Positions on the ring come from sums over hash
buckets; only in the few buckets in which an arc ends are documents chosen one by one, so no source is ever in
one task. There a source takes, in seeded order, the documents that fit its part of the bucket, so that a document
larger than what is wanted doesn't take the place of others. What sources then still lack, over all their
patterns, is taken from the documents of the same buckets that are left.

Defined cases: documents of a null or unlisted source take no part, nor do documents without tokens;
sources with a share but no tokens are left out and the others keep their proportions; sources with share 0
get nothing; a quota is met up to the largest document in use, and mostly up to half the smallest that is left.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spagyric.llm.bpe import count_column
from spagyric.session import shared_checkpoints


def min_cost_flow(arcs: list[tuple], source, sink, most: float) -> tuple[float, dict[tuple, float]]:
    """(flow, flow of each arc) by successive cheapest paths; arcs: (from, to, capacity, cost)."""
    graph: dict = {}
    edges: list[list] = []
    for a, b, capacity, cost in arcs:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0.0, -cost)):
            graph.setdefault(x, []).append(len(edges))
            graph.setdefault(y, [])
            edges.append([x, y, c, w])
    height = dict.fromkeys(graph, 0.0)
    total, least = 0.0, 1e-9 * max(1.0, most if most < float("inf") else 1.0)
    while total < most - least and source in graph:
        dist, via, queue, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
        while queue:
            d, _, x = heapq.heappop(queue)
            if d > dist[x] + 1e-12:
                continue
            for e in graph[x]:
                _, y, c, w = edges[e]
                if c > least and d + w + height[x] - height[y] < dist.get(y, float("inf")) - 1e-12:
                    dist[y] = d + w + height[x] - height[y]
                    via[y] = e
                    heapq.heappush(queue, (dist[y], n := n + 1, y))
        if sink not in dist:
            break
        for x in dist:
            height[x] += dist[x]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = edges[via[x]][0]
        step = min([most - total, *(edges[e][2] for e in path)])
        for e in path:
            edges[e][2] -= step
            edges[e ^ 1][2] += step
        total += step
    used: dict[tuple, float] = {}
    for e in range(0, len(edges), 2):
        used[edges[e][0], edges[e][1]] = used.get((edges[e][0], edges[e][1]), 0.0) + edges[e ^ 1][2]
    return total, used


def route(capacity: dict[tuple[str, ...], float], shares: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], float]:
    """(pattern, source) -> tokens, for the largest total whose shares can be met."""
    capacity = dict(sorted(capacity.items()))  # of equally cheap flows, always the same
    shares = {s: w for s, w in sorted(shares.items()) if w > 0 and repeats.get(s, 0) > 0 and any(s in p and n > 0 for p, n in capacity.items())}
    weight = sum(shares.values())
    if not weight:
        return {}

    def flow(total: float):
        arcs = []
        for p, n in capacity.items():
            for k in range(max((repeats[s] for s in p if s in shares), default=0)):
                arcs.append(("from", (p, k), float(n), float(k)))
                arcs += [((p, k), s, float(n), 0.0) for s in p if s in shares and k < repeats[s]]
        arcs += [(s, "to", total * w / weight, 0.0) for s, w in shares.items()]
        return min_cost_flow(arcs, "from", "to", total)

    low, high = 0.0, min(sum(n * repeats[s] for p, n in capacity.items() if s in p) * weight / w for s, w in shares.items())
    got, used = flow(high)
    if got < high * (1 - 1e-9):
        for _ in range(50):
            middle = (low + high) / 2
            got, used_ = flow(middle)
            low, high, used = (middle, high, used_) if got >= middle * (1 - 1e-9) else (low, middle, used)
        used = flow(low)[1]
    out: dict = {}
    for (a, b), n in used.items():
        if isinstance(a, tuple) and b in shares and n > 0:
            out[a[0], b] = out.get((a[0], b), 0.0) + n
    return out


def passed(arc: tuple[float, float], begin: float, size: float, ring: float) -> float:
    """Tokens of an arc, which may go round the ring several times, in the stretch of ``size`` from ``begin`` on."""

    def until(y: float, z: float) -> float:
        laps = y // ring
        return laps * z + min(y - laps * ring, z)

    a, b = arc
    return until(b, begin + size) - until(b, begin) - until(a, begin + size) + until(a, begin)


def fill(sizes: list[int], patterns: list[tuple[str, ...]], used: list[list[int]], wanted: dict[str, int], repeats: dict[str, int], largest: int | None = None) -> dict[str, int]:
    """Adds copies of documents to ``used`` as long as they fit what the sources want; returns what these still want.

    sizes: the documents' tokens, in seeded order; patterns: their sources; used: their copies for each of these.
    Documents used least come first. With ``largest``, the tokens of the largest document in use, one document more
    is taken if that leaves a source nearer to what it wants, or if it lacks more than ``largest``.
    """
    left = dict(wanted)
    most = {p: max(repeats[s] for s in p) for p in set(patterns)}
    for s in sorted(left, key=lambda s: (left[s], s)):
        mine = [(i, p.index(s)) for i, p in enumerate(patterns) if s in p]
        free, least = mine, min((sizes[i] for i, _ in mine), default=0)
        while free and left[s] >= least:
            took = False
            for i, j in sorted(free, key=lambda x: sum(used[x[0]])):
                if sizes[i] <= left[s] and used[i][j] < repeats[s] and sum(used[i]) < most[patterns[i]]:
                    used[i][j] += 1
                    left[s] -= sizes[i]
                    took = True
            free = [(i, j) for i, j in free if sizes[i] <= left[s]] if took else []
        if largest is None or left[s] <= 0:
            continue
        free = [(i, j) for i, j in mine if used[i][j] < repeats[s] and sum(used[i]) < most[patterns[i]]]
        i, j = min(free, key=lambda x: abs(sizes[x[0]] - left[s]), default=(None, None))
        if i is not None and (abs(sizes[i] - left[s]) < left[s] or left[s] > largest):
            used[i][j] += 1
            left[s] -= sizes[i]
            largest = max(largest, sizes[i])
    return left


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source, cut from its lineage."""
    shared_checkpoints(documents.sparkSession)
    return count_column(documents.where("source is not null"), "text", ["doc_id", "source"], vocabulary).checkpoint()


def mixture(counts: DataFrame, weights: DataFrame, seed: int = 0, per_bucket: int = 5_000) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents that are used.

    counts: (doc_id, source or sources ARRAY, n_tokens); weights: (source, target_share, max_repeats), a
    dimension. per_bucket: about how many documents share a hash bucket.
    """
    spark = counts.sparkSession
    if "sources" not in counts.columns:
        counts = counts.withColumn("sources", F.array("source"))
    listed = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in weights.collect() if r["source"] is not None}  # a dimension
    schema = "doc_id bigint, source string, n_tokens bigint, copies bigint"
    if not listed:
        return spark.createDataFrame([], schema)
    # patterns are sets of listed sources, so there are no more of them than the dimension has subsets
    known = F.array_sort(F.array_intersect("sources", F.array(*map(F.lit, sorted(listed)))))
    rows = counts.where("n_tokens > 0").select("doc_id", F.concat_ws("\x1f", known).alias("pattern"), "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("at")).where("pattern <> ''")
    totals = rows.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()  # one row for each set of sources
    capacity = {tuple(r["pattern"].split("\x1f")): float(r["tokens"]) for r in totals}
    repeats = {s: m for s, (_, m) in listed.items()}
    flows = route(capacity, {s: w for s, (w, _) in listed.items()}, repeats)
    quota: dict[str, float] = {}
    for (_, source), n in flows.items():
        quota[source] = quota.get(source, 0.0) + n
    if not quota:
        return spark.createDataFrame([], schema)
    arcs: dict[str, dict[str, tuple[float, float]]] = {}
    ring = {"\x1f".join(p): n for p, n in capacity.items()}
    for pattern in sorted(capacity):
        at = 0.0
        for source in (s for s in pattern if s in quota):
            arcs.setdefault("\x1f".join(pattern), {})[source] = at, (at := at + flows.get((pattern, source), 0.0))
    buckets = max(1, max(r["n"] for r in totals) // per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 20), F.lit(buckets)))
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("size"))
    sums = begun_at(sums)
    arc = spark.createDataFrame([(p, s, a, b, ring[p]) for p, of in arcs.items() for s, (a, b) in of.items()], "pattern string, source string, a double, b double, ring double")
    passes = lambda x, c: F.ceil((x - c) / F.col("ring"))
    copies = lambda c: (passes(F.col("b"), c) - passes(F.col("a"), c)).cast("bigint")
    last = F.col("begin") + F.col("size") - 1
    whole = (copies(F.col("begin")) == copies(last)) & (passes(F.col("a"), F.col("begin")) == passes(F.col("a"), last))
    per = sums.join(F.broadcast(arc), "pattern").select("pattern", "bucket", "begin", "size", F.struct("source", copies(F.col("begin")).alias("copies")).alias("arc"), whole.alias("whole"))
    # the first bucket of every pattern is also for what sources lack in the end
    per = per.groupBy("pattern", "bucket", "begin", "size").agg(F.sort_array(F.collect_list("arc")).alias("arcs"), (F.bool_and("whole") & (F.col("begin") > 0)).alias("whole"))
    all_ = rows.join(per.where("whole").selectExpr("pattern", "bucket", "inline(arcs)").where("copies > 0"), ["pattern", "bucket"]).select("doc_id", "source", "n_tokens", "copies")
    cut = per.where("not whole").select("pattern", "bucket", "begin", "size", F.col("arcs.source").alias("sources"), F.array_repeat(F.lit(0).cast("bigint"), F.size("arcs")).alias("used"))
    some = rows.join(cut, ["pattern", "bucket"])

    def chosen(docs: pa.Table, wanted: dict[str, int], largest: int | None = None) -> pa.Table:
        docs = docs.sort_by([("at", "ascending"), ("doc_id", "ascending"), ("n_tokens", "ascending")])
        used = docs["used"].to_pylist()
        fill(docs["n_tokens"].to_pylist(), [tuple(p) for p in docs["sources"].to_pylist()], used, wanted, repeats, largest)
        field = docs.schema.field("used")
        return docs.set_column(docs.schema.get_field_index("used"), field, pa.array(used, field.type))

    def in_bucket(docs: pa.Table) -> pa.Table:
        pattern, begin, size = (docs[c][0].as_py() for c in ("pattern", "begin", "size"))
        return chosen(docs, {s: round(passed(x, begin, size, ring[pattern])) for s, x in arcs[pattern].items()})

    shared_checkpoints(spark)
    some = some.groupBy("pattern", "bucket").applyInArrow(in_bucket, some.schema).checkpoint()
    by_source = lambda df: df.select("doc_id", "n_tokens", F.inline(F.arrays_zip("sources", "used")).alias("source", "copies")).select("doc_id", "source", "n_tokens", "copies").where("copies > 0")
    met = all_.unionByName(by_source(some)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("n_tokens").alias("largest")).collect()  # a row for each source
    lacks = {s: round(n) - sum(r["tokens"] for r in met if r["source"] == s) for s, n in quota.items()}
    lacks, largest = {s: n for s, n in lacks.items() if n > 0}, max((r["largest"] for r in met), default=0)
    # a document that is more than twice what a source lacks can't bring it nearer
    reach = {s: 2 * n if n <= largest else float("inf") for s, n in lacks.items()}
    near = spark.createDataFrame([(p, float(max(reach.get(s, 0) for s in of))) for p, of in arcs.items()], "pattern string, reach double")
    some = some.join(F.broadcast(near), "pattern")
    more = some.where("n_tokens <= reach").groupBy().applyInArrow(lambda docs: chosen(docs, lacks, largest), some.schema)
    return all_.unionByName(by_source(some.where("n_tokens > reach"))).unionByName(by_source(more))


def begun_at(sums: DataFrame, width: int = 1_000) -> DataFrame:
    """Adds ``begin``, the sum of the sizes of a pattern's buckets before each, in two levels: stretches of ``width``
    buckets are summed first, so that no pattern's buckets go through one task."""
    sums = sums.withColumn("_s", F.floor(F.col("bucket") / width))
    wide = sums.groupBy("pattern", "_s").agg(F.sum("size").alias("_size")).selectExpr("pattern", "_s", "sum(_size) over (partition by pattern order by _s) - _size as _before")
    inner = sums.selectExpr("*", "sum(size) over (partition by pattern, _s order by bucket) - size as _within")
    return inner.join(wide, ["pattern", "_s"]).withColumn("begin", F.col("_before") + F.col("_within")).drop("_s", "_before", "_within")


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of every listed source."""
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total")).select("total", F.lit(1).alias("_k"))
    rows = weights.select("source", "target_share").join(per, "source", "left").withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    zero = F.lit(0).cast("bigint")
    return rows.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"))


