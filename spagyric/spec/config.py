"""Settings of a run, from a file, the session or keywords; and artefacts, which every executor finds beside it.

Settings are plain names, so that a run is told by them: of the tokenizer, the taggers, the readers and the ways of merging.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark import SparkFiles
from pyspark.sql import SparkSession

PREFIX = "spagyric."


@dataclass(frozen=True)
class Config:
    """tokenizer: 'chem', 'plain' or 'fine'. ner: 'rules' or the path of a saved tagger. pool: how confidences are made one.
    readers: names of reader profiles, in the order in which they are tried; empty for all."""

    tokenizer: str = "chem"
    ner: str = "rules"
    pool: str = "least"
    readers: tuple[str, ...] = ()
    skip_section: str | None = None
    allow_section: str | None = None

    @classmethod
    def of(cls, settings: dict) -> "Config":
        known = {f.name for f in fields(cls)}
        if unknown := set(settings) - known:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})

    @classmethod
    def load(cls, path: str) -> "Config":
        """From a file of JSON, or of YAML where that library is there."""
        with open(path) as f:
            text = f.read()
        try:
            return cls.of(json.loads(text))
        except ValueError:
            import yaml

            return cls.of(yaml.safe_load(text) or {})

    @classmethod
    def of_session(cls, spark: SparkSession) -> "Config":
        """From the session's settings that begin with 'spagyric.'; lists are parted by commas."""
        found = {f.name: v for f in fields(cls) if (v := spark.conf.get(PREFIX + f.name, None)) is not None}
        return cls.of({k: v.split(",") if k == "readers" else v for k, v in found.items()})

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    def arguments(self) -> dict:
        """What ``api.extract`` takes of these settings."""
        from spagyric.operators.tagging import Chain, chemical_tags
        from spagyric.operators.tokens import word_spans
        from spagyric.sources.readers import READERS

        kind = self.tokenizer
        out = {"tokenizer": word_spans if kind == "chem" else lambda text: word_spans(text, kind), "skip_section": self.skip_section, "allow_section": self.allow_section}
        if self.ner == "rules":
            out["tagger"] = chemical_tags
        else:
            with open(self.ner) as f:
                out["tagger"] = Chain.loads(f.read())
        if self.readers:
            by = {p.name: p for p in READERS}
            out["readers"] = [by[n] for n in self.readers]
        return out

    def key(self) -> dict:
        """Tells one configuration from another, as ``api.cached_layer`` needs."""
        return asdict(self)


#: The fast settings: words parted at every change, chemicals by rules.
FAST = Config(tokenizer="fine")


def shared_artefact(spark: SparkSession, path: str) -> str:
    """Sends a file to every executor once; its name, for ``artefact``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def artefact(name: str) -> str:
    """The content of a file sent by ``shared_artefact``, on whatever machine this runs."""
    with open(SparkFiles.get(name)) as f:
        return f.read()
