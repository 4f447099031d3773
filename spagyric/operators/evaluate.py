"""Records held against a gold standard, as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_scores(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of two tables of equal columns ``keys`` as multisets: a record found
    twice and there once is a hit and a false one. Null values compare as equal. Ratios without cases are null."""
    by = by or []
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    g, f = count(gold, "_g"), count(found, "_f")
    both = g.withColumn("_f", F.lit(0).cast("bigint")).unionByName(f.withColumn("_g", F.lit(0).cast("bigint"))).groupBy(*keys).agg(F.sum("_g").alias("g"), F.sum("_f").alias("f"))
    out = both.groupBy(*by).agg(F.sum(F.least("g", "f")).alias("tp"), F.sum(F.greatest(F.col("f") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("f"), F.lit(0))).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def projected_scores(gold: DataFrame, found: DataFrame, doc: str, projections: dict[str, list[str]]) -> DataFrame:
    """The scores of several projections of records, one row for each: values alone, values with units, and so on."""
    out = None
    for name, fields in projections.items():
        part = multiset_scores(gold, found, [doc, *fields]).withColumn("projection", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def precision_by_method(labelled: DataFrame, method: str = "method", correct: str = "correct") -> DataFrame:
    """(method, n, right, precision) of records judged right or wrong."""
    return labelled.groupBy(method).agg(F.count(correct).alias("n"), F.count_if(F.col(correct)).alias("right")).withColumn("precision", F.try_divide("right", F.col("n")))
