"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spagyric.llm.bpe import encode_column
from spagyric.llm.canonical import solvent_mapping
from spagyric.llm.mixture import counted, mixture, shares
from spagyric.llm.names import entities, linked_pairs
from spagyric.llm.plainform import plain_elements
from spagyric.llm.splitting import oversized, split
from spagyric.llm.survivors import survivors
from spagyric.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return plain_elements(table(spark, d, "mp_records")).where("plain <> text").select("rec_id", "field", "pos").distinct()


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    return plain_elements(table(spark, d, "mp_records")).select("rec_id", "field", "pos", "plain")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "mp_records"), table(spark, d, "sentences"), table(spark, d, "extraction_methods"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group, each bundle taken from the record that supplies it."""
    chosen = p3_found(spark, d).groupBy("first_rec_id").pivot("field", ["quantity", "names", "labels", "solvent", "apparatus"]).agg(F.max("rec_id"))
    mp = table(spark, d, "mp_records").dropDuplicates(["rec_id"])
    out = chosen
    for bundle, columns in {"quantity": ["raw_value", "raw_units"], "names": ["compound.names"], "labels": ["compound.labels"], "solvent": ["solvent"], "apparatus": ["apparatus"]}.items():
        out = out.join(mp.select(F.col("rec_id").alias(bundle), *(F.col(c).alias("out_" + c.rpartition(".")[2]) for c in columns)), bundle, "left")
    return out.select("first_rec_id", *(F.col("out_" + c).alias(c) for c in ("raw_value", "raw_units", "names", "labels", "solvent", "apparatus")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "nmr_records").select("rec_id", "solvent").unionByName(table(spark, d, "uvvis_records").select("rec_id", "solvent"))
    return solvent_mapping(records, table(spark, d, "solvents"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(table(spark, d, "article_meta").select(F.explode("authors").alias("name")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(_entities(spark, d))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(counted(table(spark, d, "documents")), table(spark, d, "source_weights"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "source_weights")
    return shares(mixture(counted(table(spark, d, "documents")), weights), weights)


def _met(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, met): whether a source's tokens are its share of the total, up to the documents at the ends of its
    stretch, which are used whole or not at all."""
    got = shares(mixed, weights)
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"), (2 * F.max("n_tokens")).alias("ends")).first()
    off = F.abs(F.col("tokens") - F.col("target_share") * F.lit(total["total"]))
    return got.select("source", "target_share", (off <= F.lit(total["ends"])).alias("met"))


def p9_met(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "source_weights")
    return _met(mixture(counted(table(spark, d, "documents")), weights), weights)


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The same where every third document may also be used for the source after its own."""
    weights = table(spark, d, "source_weights")
    after = weights.select("source", F.lead("source").over(Window.orderBy("source")).alias("next"))  # a dimension
    counts = counted(table(spark, d, "documents")).join(after, "source", "left")
    counts = counts.select("doc_id", "n_tokens", F.array_compact(F.array("source", F.when(F.col("doc_id") % 3 == 0, F.col("next")))).alias("sources"))
    return _met(mixture(counts, weights), weights)


def p10_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Of each document that is split: its characters, and whether its pieces tile it with overlaps within the limits."""
    pieces = p10_pieces(spark, d).select("doc_id", "piece", "start", "end", "n_tokens", F.length("text").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("piece")
    rows = pieces.withColumn("before", F.lag("end").over(w))  # offsets only
    fine = (F.col("n_tokens") <= 512) & (F.col("n") == F.col("end") - F.col("start")) & (F.coalesce("before", F.lit(0)) >= F.col("start")) & (F.coalesce("before", F.lit(0)) < F.col("end"))
    return rows.groupBy("doc_id").agg(F.max("end").alias("characters"), F.min("start").alias("first"), F.bool_and(fine).alias("fine"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split(table(spark, d, "documents"), "doc_id", "text")


_ALL = (p1_found, p1_plain, p3_found, p3_records, p4_found, p6_found, p6_entities, p8_ids, p9_mixture, p9_shares, p9_met, p9_overlap, p10_found, p10_pieces, p10_tiles)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_SHARES = "select source, target_share, true as met from source_weights"


def oracle_sql() -> dict[str, str]:
    return {"p9_met": _SHARES, "p9_overlap": _SHARES}
