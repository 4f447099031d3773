"""Jobs over files, each writing JSON lines to a folder.

    python -m spagyric extract INPUT OUTPUT --models MeltingPoint,Compound [--config FILE]
    python -m spagyric read|sentences|tokenize|chemicals|abbreviations INPUT OUTPUT
    python -m spagyric dictionary NAMES OUTPUT                  a list of names, one a line, as a dictionary
    python -m spagyric train CORPUS MODEL [--form slash] [--kind pos|chain]
    python -m spagyric tag INPUT OUTPUT --tagger MODEL          and: accuracy CORPUS OUTPUT --tagger MODEL
    python -m spagyric evaluate GOLD OUTPUT --found FOLDER      records against records
"""

from __future__ import annotations

import argparse
import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.api import extract, layers
from spagyric.operators.evaluate import multiset_scores
from spagyric.operators.tagging import Chain, Perceptron, accuracy, defined_abbreviations, mentions, name_dictionary, regex_tagger, tagged
from spagyric.operators.tokens import tokens
from spagyric.sources.readers import read_files, tagged_corpus
from spagyric.spec.config import Config
from spagyric.spec.models import BUILT_IN

KEYS = ["doc_id", "el_idx", "sent_idx"]
#: Sentences of a corpus that a tagger is trained on, drawn by hash.
SAMPLE = 20_000


def sampled(corpus: DataFrame, most: int = SAMPLE) -> list[tuple[list[str], list[str]]]:
    """A bounded sample of tagged sentences, which is what taggers are fitted on."""
    rows = corpus.orderBy(F.xxhash64("name", "sent_idx")).limit(most).select("tokens").collect()
    return [([t["text"] for t in r["tokens"]], [t["tag"] for t in r["tokens"]]) for r in rows]


def load_tagger(path: str):
    with open(path) as f:
        text = f.read()
    return Chain.loads(text) if "moves" in json.loads(text) else Perceptron.loads(text)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    config = Config.load(a.config) if a.config else Config.of_session(spark)
    if a.action == "dictionary":
        return name_dictionary(spark.read.text(a.input), "value")
    if a.action == "train":
        data = sampled(tagged_corpus(spark, a.input, a.form))
        random.Random(1).shuffle(data)
        model = Chain().train(data) if a.kind == "chain" else Perceptron().train(data)
        with open(a.output, "w") as f:
            f.write(model.dumps())
        return None
    if a.action == "accuracy":
        model = load_tagger(a.tagger)
        corpus = tagged_corpus(spark, a.input, a.form)
        guess = F.pandas_udf(lambda s: s.map(lambda ts: model([t["text"] for t in ts])), "array<string>")
        pairs = corpus.select(F.explode(F.arrays_zip(F.col("tokens.tag").alias("gold"), guess("tokens").alias("said"))).alias("p")).select("p.*")
        return accuracy(pairs, "gold", "said")
    if a.action == "evaluate":
        gold, found = spark.read.json(a.input), spark.read.json(a.found)
        return multiset_scores(gold.select("model", "payload"), found.select("model", "payload"), ["model", "payload"], ["model"])
    docs = read_files(spark, a.input)
    if a.action == "extract":
        return extract(docs, [BUILT_IN[m] for m in a.models.split(",") if m], name="name", **config.arguments())
    els, sents = layers(docs, name="name")
    if a.action == "tag":
        return sents.select(*KEYS, tagged(F.col("text"), load_tagger(a.tagger) if a.tagger else regex_tagger()).alias("tokens"))
    made = {"read": lambda: els, "sentences": lambda: sents, "tokenize": lambda: tokens(sents, KEYS, "text", config.tokenizer), "chemicals": lambda: mentions(sents, KEYS).where("kind = 'CM'"), "abbreviations": lambda: defined_abbreviations(sents, KEYS)}
    return made[a.action]()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spagyric", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("action", choices=["extract", "read", "sentences", "tokenize", "chemicals", "abbreviations", "dictionary", "train", "tag", "accuracy", "evaluate"])
    p.add_argument("input", help="file or folder")
    p.add_argument("output", help="folder for JSON lines, or the file of a model")
    p.add_argument("--models", default="", help="names, separated by commas: " + ", ".join(BUILT_IN))
    p.add_argument("--config", help="a file of settings")
    p.add_argument("--tagger", help="a model made by train")
    p.add_argument("--form", default="slash", choices=["slash", "columns", "brackets"])
    p.add_argument("--kind", default="pos", choices=["pos", "chain"])
    p.add_argument("--found", help="records to be held against the gold ones")
    a = p.parse_args(args)
    out = run(SparkSession.builder.appName("spagyric").getOrCreate(), a)
    if out is not None:
        out.write.mode("overwrite").json(a.output)


if __name__ == "__main__":
    main()
