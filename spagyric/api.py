"""The way from documents to records: ``extract(docs, models)``."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spagyric.operators import extract as X
from spagyric.operators.parsers import Tokenizer
from spagyric.operators.resolve import pooled_confidence, resolve
from spagyric.operators.tagging import Tagger, chemical_tags, defined_abbreviations
from spagyric.operators.tokens import section_filter, sentences, word_spans
from spagyric.session import shared_checkpoints
from spagyric.sources.readers import Profile, elements
from spagyric.spec.models import Model

#: Elements whose sentences are parsed; the text of a table or figure is its caption.
TEXTS = ("Title", "Heading", "Paragraph", "Footnote", "Caption", "Table", "Figure")


def layers(docs: DataFrame, key: str = "doc_id", content: str = "content", name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The element and the sentence layer."""
    els = elements(docs, key, content, name)
    return els, sentences(els.where(F.col("el_type").isin(*TEXTS)), [key, "el_idx"], "text")


def extract(
    docs: DataFrame, models: list[Model], key: str = "doc_id", content: str = "content", name: str | None = None, skip_elements: tuple[str, ...] = (), allow_section: str | None = None, skip_section: str | None = None,
    merge: bool = True, parsers: list = (), tokenizer: Tokenizer = word_spans, tagger: Tagger = chemical_tags, readers: list[Profile] | None = None, adjacent_sections: str | None = None,
) -> DataFrame:
    """(doc_id, el_idx, sent_idx, rec_idx, model, method, payload, confidence) of all records of the models.

    models has no default: without models there is nothing to extract. skip_elements, allow_section and
    skip_section are filters before any sentence is split. parsers, tokenizer, tagger and readers are used besides, or
    instead of, the built-in ones. adjacent_sections: sections that follow each other count as one if both headings fit the
    pattern. Documents are read once: elements are kept as a checkpoint, which sentences, tables and sections read.
    """
    if not models:
        raise ValueError("extract needs models")
    shared_checkpoints(docs.sparkSession)
    every_model = [*models, *(p.model for p in parsers if p.model not in models)]
    els = elements(docs, key, content, name, readers).where(~F.col("el_type").isin(*(skip_elements or ("",)))).checkpoint()
    if allow_section or skip_section:
        els = section_filter(els, allow_section, skip_section, key)
    plain = sentences(els.where(F.col("el_type").isin(*TEXTS)), [key, "el_idx"], "text")
    short = defined_abbreviations(plain, [key]).checkpoint()
    sents = X.with_definitions(plain, key, ["el_idx", "sent_idx"], models)
    sents = X.with_abbreviations(sents, key, short)
    found = X.records(sents, [key, "el_idx", "sent_idx"], models, specifiers="specifiers", parsers=parsers, tokenizer=tokenizer, tagger=tagger, abbreviations="abbreviations")
    # a table's cells stand one sentence before its caption, from which they take what they lack
    tables = X.table_records(els.where("el_type = 'Table'").select(key, "el_idx", F.lit(-1).alias("sent_idx"), "grid", "text"), [key, "el_idx", "sent_idx"], "grid", models, "text")
    every = found.unionByName(tables)
    if not merge:
        return every
    return resolve(every, every_model, key, sections(els, key, adjacent_sections), short)


def sections(els: DataFrame, key: str, adjacent: str | None = None) -> DataFrame:
    """(key, el_idx, section, el_type): sections are counted by headings; a heading that fits ``adjacent``, as the one before
    it does, begins no section of its own."""
    heading = F.col("el_type") == "Heading"
    fits = F.col("text").rlike(f"(?i){adjacent}") if adjacent else F.lit(False)
    heads = els.where(heading).select(key, "el_idx", fits.alias("_fits"))
    heads = heads.withColumn("_new", ~(F.col("_fits") & F.coalesce(F.lag("_fits").over(Window.partitionBy(key).orderBy("el_idx")), F.lit(False))))
    rows = els.select(key, "el_idx", "el_type").join(heads.select(key, "el_idx", "_new"), [key, "el_idx"], "left")
    return rows.withColumn("section", F.count_if("_new").over(_before(key)).cast("int")).drop("_new")


def ranked(records: DataFrame, group: list[str], most: int | None = None) -> DataFrame:
    """The records with ``rank`` by confidence, the surest first, within each group; of equals the earlier. most: only so many."""
    w = Window.partitionBy(*group).orderBy(F.coalesce(pooled_confidence(F.col("confidence")), F.lit(0.0)).desc(), *(c for c in ("el_idx", "sent_idx", "rec_idx") if c in records.columns))
    out = records.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.where(F.col("rank") <= most)


def _before(key: str):
    return Window.partitionBy(key).orderBy("el_idx").rowsBetween(Window.unboundedPreceding, 0)


def view(elements_: DataFrame, *kinds: str) -> DataFrame:
    """The elements of some types: figures, tables, headings and so on."""
    return elements_.where(F.col("el_type").isin(*kinds))


def cached_layer(spark: SparkSession, path: str, config: dict, make, inputs: DataFrame | None = None) -> DataFrame:
    """A layer kept as Parquet under the hash of its configuration; made if absent. Another configuration is another
    layer, so no cached one is ever taken for it. inputs: what the layer is made from; its content then belongs to the
    configuration, so that changed input makes a new layer (one pass over it, sums of hashes only)."""
    told = dict(config)
    if inputs is not None:
        row = inputs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*inputs.columns).cast("decimal(38,0)")).alias("h")).first()
        told["_input"] = [row["n"], str(row["h"])]
    where = f"{path}/{hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(where)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def flat_records(records: DataFrame, model: Model) -> DataFrame:
    """The records of one model with its fields as typed columns."""
    typed = F.from_json("payload", model.struct())
    return records.where(F.col("model") == model.name).select(*(c for c in records.columns if c not in ("payload", "model")), typed.alias("r")).select("*", "r.*").drop("r")
