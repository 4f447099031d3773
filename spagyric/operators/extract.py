"""Records out of sentences and tables, for all models of a query in one pass.

Sentences without any trigger word of the models are dropped by a Catalyst filter before Python. The others are
tokenised and tagged once. Quantities of all models are found together, so that each value goes to one property and one
compound (see ``assign``); every other model is read by its own parser: built-in ones for compounds, spectra and instruments,
``FieldParser`` for models whose fields have patterns, and whatever parsers are passed.

A record is a row (keys, rec_idx, model, method, payload JSON, confidence). Null and empty sentences and those
without values give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spagyric.operators.assign import Mention, assigned, shared_heads
from spagyric.operators.grammar import trigger_column
from spagyric.operators.parsers import FieldParser, Sentence, Tokenizer, patterned
from spagyric.operators.tagging import Tagger, chemical_tags, spans_of
from spagyric.operators.tokens import word_spans
from spagyric.session import joinable, shared_checkpoints
from spagyric.spec import units as U
from spagyric.spec.models import Model

RECORD = "rec_idx int, model string, method string, payload string, confidence map<string,double>"

_NUM = r"[-–−+]?\d+(?:[.,]\d+)*(?:\s*[×x]\s*10\s*\^?\s*[-–−]?\d+)?"
_ERROR = r"(?:\s*±\s*\d+(?:\.\d+)?|\(\d+\))?"
VALUE = rf"(?:[~<>≈≥≤]\s*|(?:ca\.?|about|approximately|around)\s+)?{_NUM}{_ERROR}(?:\s*(?:-|–|−|—|to|\.\.)\s*{_NUM}{_ERROR})?"
VALUE = rf"(?:(?<=between ){_NUM}{_ERROR}\s+and\s+{_NUM}{_ERROR}|{VALUE})"


def unit_pattern(dimension: U.Dimension | None) -> str:
    """One alternation for all units of a dimension, with prefixes and products."""
    return _unit_pattern(dimension, len(U.BASES))


@lru_cache(maxsize=256)
def _unit_pattern(dimension: U.Dimension | None, known: int) -> str:
    if dimension is None or dimension == U.DIMENSIONLESS:
        return ""
    names = {n for n, _ in dimension.powers}
    bases = [b for b in U.BASES if b.dimension == dimension or {n for n, _ in b.dimension.powers} <= names]
    one = "(?:" + "|".join(b.pattern for b in sorted(bases, key=lambda b: -len(b.pattern))) + ")"
    prefix = "" if dimension == U.TEMPERATURE else f"(?:{'|'.join(U.PREFIXES)})?"
    return rf"(?:\[?{prefix}{one}(?:\s?[/·]?\s?\(?{prefix}{one}(?:\^?[-–−]?\d+)?\)?)*\]?)"


def quantity_scanner(model: Model) -> re.Pattern:
    return _scanner(model.dimension, len(U.BASES))


@lru_cache(maxsize=256)
def _scanner(dimension: U.Dimension | None, known: int) -> re.Pattern:
    unit = unit_pattern(dimension)
    tail = rf"\s*(?P<units>{unit})(?![A-Za-z0-9])" if unit else r"(?![\w%°])"
    return re.compile(rf"(?<![\w.,])(?P<value>{VALUE}){tail}")


_LABEL = r"(?:[A-Z]{1,2}\d{1,3}|\d{1,3}[a-z]?|[IVX]{1,5})"
#: Words before a label, and roles of compounds.
_LABELLED = re.compile(rf"(?:\b(?:compounds?|complex(?:es)?|ligands?|products?|derivatives?|samples?)\s+(?P<a>{_LABEL})(?![\w-]))|\((?P<b>{_LABEL})\)")
ROLES = ("product", "intermediate", "starting material", "ligand", "precursor", "solvent", "catalyst", "standard", "title compound")


def compounds(sentence: str | Sentence) -> list[dict]:
    """{names, labels, roles, start, end} of the compounds in a sentence; a label behind a name belongs to it."""
    sentence = Sentence(sentence) if isinstance(sentence, str) else sentence
    text, spans = sentence.text, sentence.spans
    out = []
    for a, b in spans_of([w for w, _, _ in spans], sentence.chemical):
        out.append({"names": [text[spans[a][1] : spans[b - 1][2]]], "labels": [], "roles": [], "start": spans[a][1], "end": spans[b - 1][2]})
    for m in _LABELLED.finditer(text):
        label = m["a"] or m["b"]
        owner = next((c for c in out if 0 <= m.start() - c["end"] <= 1), None)
        if owner is not None:
            owner["labels"].append(label)
            owner["end"] = m.end()
        elif m["a"] or re.search("[a-z]$|^[A-Z]", label):
            out.append({"names": [], "labels": [label], "roles": [], "start": m.start(), "end": m.end()})
    out.sort(key=lambda c: c["start"])
    for c in out:
        before = text[max(0, c["start"] - 30) : c["start"]].lower()
        c["roles"] = [r for r in ROLES if before.rstrip().endswith(r)]
    return out


def _compound(c: dict | None) -> dict | None:
    return None if c is None else {k: sorted(set(c[k])) for k in ("names", "labels", "roles") if c[k]}


def _specifiers(text: str, model: Model, defined: list[str]) -> list[Mention]:
    spec = model["specifier"].pattern
    whole = "|".join(x for x in (spec, *map(re.escape, defined)) if x)
    if not whole:
        return []
    out = [Mention(m.start(), m.end(), m[0], (model.name,)) for m in re.finditer(rf"(?<![\w])(?:{whole})(?![\w])", text)]
    return out + [Mention(a, b, phrase, (model.name,)) for a, b, phrase in shared_heads(text, re.compile(whole))] if " and " in text or " or " in text else out


def _values(text: str, model: Model) -> list[Mention]:
    """The values that a model can take; those of a list may share the unit of its last."""
    values = [Mention(m.start("value"), m.end(), m["value"].strip(), (model.name,), (m.groupdict().get("units") or "").strip().rstrip(".")) for m in quantity_scanner(model).finditer(text)]
    if model.dimension == U.DIMENSIONLESS or not values:
        return values
    first = values[0].start
    shared = [m for m in re.finditer(rf"(?<![\w.,]){_NUM}{_ERROR}(?=(?:\s*,|\s+and)\s)", text[:first]) if re.fullmatch(r"[\s,]*(?:and\s+)?(?:[\d.,\s]|and)*", text[m.end() : first])]
    return [Mention(m.start(), m.end(), m[0], (model.name,), values[0].unit) for m in shared] + values


def quantities(text: str, models: Model | list[Model], found: list[dict] | None = None, specifiers: dict[str, list[str]] | None = None) -> Iterator[tuple[str, str, dict, float]]:
    """(model, method, record, confidence) of the quantity models in a sentence, each value for one of them.

    specifiers: by model, what the document has defined as names of the property besides the model's own.
    """
    models = [models] if isinstance(models, Model) else models
    U.register(*(u for m in models for u in m.units))
    by = {m.name: m for m in models}
    specs = [x for m in models for x in _specifiers(text, m, (specifiers or {}).get(m.name, []))]
    named = {n for s in specs for n in s.models}
    able = [m for m in models if m.name in named or not (m["specifier"].pattern or (specifiers or {}).get(m.name))]
    values = [v for m in able for v in _values(text, m)]
    if not values:
        return
    united = [v for v in values if v.unit]  # a number with a unit isn't one without
    values = [v for v in values if v.unit or not any(u.start <= v.start < u.end for u in united)]
    cems = [Mention(c["start"], c["end"], "", compound=c) for c in (compounds(text) if found is None else found)]
    rows = assigned(text, specs, values, cems)
    given = {(v.start, v.end) for _, _, _, v, _ in rows}
    for m in able:
        if not m["specifier"].pattern:  # a model of any quantity takes what no property claims
            free = [c for c in cems if not any(v.start <= c.start < v.end for v in values)]
            for v in values:
                if m.name in v.models and (v.start, v.end) not in given:
                    near = min(free, key=lambda c: (min(abs(v.start - c.end), abs(c.start - v.end)), c.start), default=None)
                    rows.append(("auto_sentence", m.name, None, v, near))
    for method, name, s, v, c in rows:
        model = by[name]
        unit = U.parse_unit(v.unit, model.dimension) if v.unit else None
        record = {"raw_value": v.text, "raw_units": v.unit or None, "specifier": s.text if s else None, "compound": _compound(c.compound) if c else None, "units": str(unit) if unit else None}
        far = 0 if s is None else max(v.start - s.end, s.start - v.end, 0)
        yield name, method, {k: x for k, x in record.items() if x}, 1.0 if method == "template" else round(1 / (1 + far / 50), 3)


# --- spectra and instruments ---------------------------------------------------------------------------------------

_NUCLEUS = r"(?P<nucleus>\d{0,3}\s?(?:H|C|N|F|P|Si|Se|B|Sn|Pt)(?:\{1H\})?)"
_NMR = re.compile(rf"(?P<head>{_NUCLEUS}[-\s]*NMR\s*(?:\((?P<setting>[^()]*(?:\([^()]*\)[^()]*)*)\))?[:,\s]*(?:δ|d|ppm)?[H|C]?\s*[:=]?\s*)(?P<peaks>[-–−]?\d+\.\d+.*)", re.S)
_PEAK = re.compile(r"(?P<shift>[-–−]?\d+\.\d+(?:\s?[-–−]\s?\d+\.\d+)?)\s*(?:\((?P<inside>[^()]*(?:\([^()]*\)[^()]*)*)\))?")
_MULTIPLICITY = r"(?:br\.?\s?)?(?:s|d|t|q|quint|sext|sept|m|dd|dt|td|ddd|dq|tt|br)(?:\s?br)?"


def nmr(text: str) -> Iterator[tuple[str, dict, float]]:
    for m in _NMR.finditer(text):
        record: dict = {"nucleus": re.sub(r"\s", "", m["nucleus"])}
        for part in re.split(r"[,;]\s*", m["setting"] or ""):
            if f := re.fullmatch(r"([\d.]+)\s*([MGk]?Hz)", part.strip()):
                record |= {"frequency": f[1], "frequency_units": f[2]}
            elif t := re.fullmatch(r"([\d.]+)\s*(K|°C)", part.strip()):
                record |= {"temperature": t[1], "temperature_units": t[2]}
            elif part.strip():
                record.setdefault("solvent", part.strip())
        peaks, at = [], 0
        for p in _PEAK.finditer(m["peaks"]):
            if peaks and not re.fullmatch(r"[\s,;]*(?:and\s+)?", m["peaks"][at : p.start()]):
                break
            at = p.end()
            peak = {"shift": p["shift"]}
            for part in re.split(r",\s*", p["inside"] or ""):
                part = part.strip()
                if j := re.fullmatch(r"J(?:\s?[\w,-]*)?\s*=\s*([\d.]+)\s*(Hz)?", part):
                    peak["coupling"] = j[1]
                    if j[2]:
                        peak["coupling_units"] = j[2]
                elif re.fullmatch(_MULTIPLICITY, part):
                    peak["multiplicity"] = part
                elif re.fullmatch(r"\d+\s?(?:H|C|F|P)s?", part):
                    peak["number"] = part
                elif part:
                    peak["assignment"] = part
            peaks.append(peak)
        if peaks:
            yield "spectrum", record | {"peaks": peaks}, 1.0


_UVVIS = re.compile(r"UV[-–/ ]?[Vv]is.*?(?:λ\s?(?:max)?|lambda\s?max)\s*(?P<tail>.*)", re.S)


def uvvis(text: str) -> Iterator[tuple[str, dict, float]]:
    m = _UVVIS.search(text)
    if not m:
        return
    solvent = re.search(r"\(([^()\d]{2,30})\)", text[: m.start("tail")])
    units = re.search(r"\bnm\b", m["tail"])
    peaks = []
    for p in re.finditer(r"(?<![\d.])(\d{3})(?:\s*nm)?\s*(?:\(\s*(?:ε\s*=?\s*|log\s?ε\s*=?\s*)?([\d.,]+)\s*([^()]*)\))?", m["tail"]):
        peak = {"value": p[1]} | ({"units": "nm"} if units else {}) | ({"extinction": p[2].replace(",", "")} if p[2] else {})
        if p[3] and p[3].strip():
            peak["extinction_units"] = p[3].strip()
        peaks.append(peak)
    if peaks:
        yield "spectrum", ({"solvent": solvent[1].strip()} if solvent else {}) | {"peaks": peaks}, 1.0


_IR = re.compile(r"\b(?:FT-?)?IR\b[^:]*?(?:\((?P<method>[^()]*)\))?[^\d]*?(?P<tail>\d{3,4}.*?)(?:cm\s?[-–−⁻]\s?[1¹]|$)", re.S)


def ir(text: str) -> Iterator[tuple[str, dict, float]]:
    m = _IR.search(text)
    if m:
        units = "cm-1" if re.search(r"cm\s?[-–−⁻]\s?[1¹]", text) else None
        peaks = [{"value": p[1]} | ({"units": units} if units else {}) | ({"strength": p[2]} if p[2] else {}) for p in re.finditer(r"(?<!\d)(\d{3,4})(?!\d)\s*(?:\((s|m|w|vs|br|sh)\))?", m["tail"])]
        if peaks:
            yield "spectrum", ({"solvent": m["method"].strip()} if m["method"] else {}) | {"peaks": peaks}, 1.0


_APPARATUS = re.compile(r"\b(?:on|with|using|by)\s+(?:an?|the)\s+((?:[A-Z][\w-]*[\s-]){1,4}[\w\d-]*\s?(?:spectro(?:photo|fluoro)?meter|diffractometer|microscope|calorimeter|apparatus|analy[sz]er|block)|(?:[A-Z][\w-]*\s){1,3}[A-Z]*\d[\w-]*(?:\s\w*meter)?)")


def apparatus(text: str) -> Iterator[tuple[str, dict, float]]:
    for m in _APPARATUS.finditer(text):
        yield "auto_sentence", {"name": m[1].strip()}, 1.0


_SPECTRA = {"NmrSpectrum": nmr, "UvvisSpectrum": uvvis, "IrSpectrum": ir, "Apparatus": apparatus}


# --- definitions, which hold from their element on ---------------------------------------------------------------------

#: Nouns that a defined property ends with.
_DEFINED = re.compile(r"((?:[A-Za-z][\w-]* ){0,3}(?:temperatures?|points?|ranges?|energy|energies|distances?|lengths?|numbers?))\s*(?:,\s*|\(\s*|\s*=\s*|(?:is |are )?denoted (?:as |by )?)([A-Z][A-Za-z]{0,3}\d?)(?=[\s,.;)]|$)")


def definitions(text: str) -> list[tuple[str, str]]:
    """(phrase, symbol) of properties for which a sentence defines a symbol: 'the Curie temperature, Tc'."""
    return [(m[1].strip(), m[2]) for m in _DEFINED.finditer(text)]


def defined_specifiers(text: str, models: list[Model]) -> dict[str, list[str]]:
    """{model: symbols} that a sentence defines for the models' properties."""
    out: dict[str, list[str]] = {}
    for phrase, symbol in definitions(text):
        for m in models:
            spec = m["specifier"].pattern if m.dimension is not None else None
            if spec and re.search(rf"(?<!\w)(?:{spec})(?!\w)", phrase):
                out.setdefault(m.name, []).append(symbol)
    return out


def with_definitions(sentences: DataFrame, doc: str, order: list[str], models: list[Model], text: str = "text") -> DataFrame:
    """Adds ``specifiers``, an ARRAY of 'model=symbol' that the document has defined up to each sentence. Only sentences that
    define something are looked at in Python and gathered by document: distinct symbols with the first place of each, which
    are joined to the document's sentences."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [f"{m}={y}" for m, ys in defined_specifiers(x, models).items() for y in ys])

    place = F.struct(*order)
    telling = sentences.where(F.col(text).rlike(r"(?:temperature|point|range|energ|distance|length|number)") & F.col(doc).isNotNull())
    told = telling.select(doc, place.alias("_at"), F.explode(run(text)).alias("_s")).groupBy(doc, "_s").agg(F.min("_at").alias("_at"))
    known = told.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_s", "_at"))).alias("_known"))  # the symbols of one document
    shared_checkpoints(sentences.sparkSession)
    known = joinable(known.checkpoint())  # so that sentences stay where they are unless very many documents define something
    up_to = F.filter("_known", lambda k: k["_at"] <= place)
    return sentences.join(known, doc, "left").withColumn("specifiers", F.coalesce(F.transform(up_to, lambda k: k["_s"]), F.array().cast("array<string>"))).drop("_known")


def with_abbreviations(sentences: DataFrame, doc: str, definitions: DataFrame) -> DataFrame:
    """Adds ``abbreviations``, a MAP of the short forms that a document defines to their long forms."""
    known = definitions.where(F.col(doc).isNotNull()).groupBy(doc, "short").agg(F.min("long").alias("long"))
    known = known.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("short", "long"))).alias("abbreviations"))  # of one document
    shared_checkpoints(sentences.sparkSession)
    return sentences.join(joinable(known.checkpoint()), doc, "left")


def is_quantity(model: Model) -> bool:
    return model.dimension is not None and any(f.name == "specifier" for f in model.fields)


def sentence_records(text: str, models: list[Model], specifiers: dict[str, list[str]] | None = None, parsers: list = (), tokenizer: Tokenizer = word_spans, tagger: Tagger = chemical_tags, abbreviations: dict[str, str] | None = None) -> Iterator[tuple[str, str, dict, float]]:
    """(model, method, record, confidence) of everything in one sentence; equal records come once. parsers: any objects as
    in ``parsers``, besides the built-in ones of the models."""
    chemical = {s: x for s, x in (abbreviations or {}).items() if "B-CM" in tagger([w for w, _, _ in tokenizer(x)])}
    sentence = Sentence(text, tokenizer, tagger, abbreviations=chemical)
    sentence.compounds = found = compounds(sentence)
    seen = set()
    rows: list[tuple[Model, str, dict, float]] = []
    by = {m.name: m for m in models}
    told = [m for m in models if is_quantity(m)]
    for model in models:
        if model.name == "Compound":
            rows += [(model, "cem", _compound(c), 1.0) for c in found if _compound(c)]
        elif model.name in _SPECTRA:
            rows += [(model, *x) for x in _SPECTRA[model.name](text)]
        elif told and model is told[0]:
            rows += [(by[name], *x) for name, *x in quantities(text, told, found, specifiers)]
        elif not is_quantity(model) and patterned(model):
            rows += [(model, *x) for x in FieldParser(model).parse(sentence)]
    for p in parsers:
        if not p.trigger or any(w in text for w in p.trigger):
            rows += [(p.model, *x) for x in p.parse(sentence)]
    for model, method, record, confidence in rows:
        key = model.name + json.dumps(record, sort_keys=True)
        if key not in seen and model.required_fulfilled(record, contextual=False):
            seen.add(key)
            yield model.name, method, record, confidence


def trigger(models: list[Model], text: Column, parsers: list = ()) -> Column:
    """Lets through every sentence in which one of the models or parsers can find something."""
    words = [*(m.triggers for m in models), *(tuple(p.trigger) for p in parsers)]
    if any(not w for w in words):
        return F.lit(True)
    return trigger_column(text, sorted({w for ws in words for w in ws}))


def records(sentences: DataFrame, keys: list[str], models: list[Model], text: str = "text", specifiers: str | None = None, parsers: list = (), tokenizer: Tokenizer = word_spans, tagger: Tagger = chemical_tags, abbreviations: str | None = None) -> DataFrame:
    """The records of all sentences, (keys, rec_idx, model, method, payload, confidence). specifiers: a column of
    ``with_definitions``; a sentence with defined symbols passes the trigger. abbreviations: one of ``with_abbreviations``.
    parsers, tokenizer and tagger go to the workers as they are."""
    known = F.col(specifiers) if specifiers else F.array().cast("array<string>")
    short = F.map_entries(abbreviations) if abbreviations else F.lit(None).cast("array<struct<key: string, value: string>>")
    rows = sentences.select(*keys, text, known.alias("_known"), short.alias("_short")).where(F.col(text).isNotNull() & (trigger(models, F.col(text), parsers) | (F.size("_known") > 0)))
    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            out = []
            for *key, t, known, short in zip(*(b[c] for c in [*keys, text, "_known", "_short"])):
                defined: dict[str, list[str]] = {}
                for pair in known if known is not None else ():
                    defined.setdefault(pair.partition("=")[0], []).append(pair.partition("=")[2])
                forms = {x["key"]: x["value"] for x in short} if short is not None else None
                for i, (model, method, record, confidence) in enumerate(sentence_records(t, models, defined, parsers, tokenizer, tagger, forms)):
                    out.append((*key, i, model, method, json.dumps(record, ensure_ascii=False), {"record": confidence}))
            yield pd.DataFrame(out, columns=[*keys, "rec_idx", "model", "method", "payload", "confidence"])

    return rows.mapInPandas(run, f"{schema}, {RECORD}")


# --- tables ----------------------------------------------------------------------------------------------------------


def cells(tables: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """(keys, row_idx, col_idx, data, row_cats, col_cats): the data cells of tables held as ARRAY<ARRAY<STRING>>.

    The first row is the header, the first column the row's category.
    A Catalyst plan: header cells meet data cells by position within the array, without a join.
    """
    header = F.get(F.col(rows), F.lit(0))
    body = tables.select(*keys, header.alias("_h"), F.posexplode(F.slice(F.col(rows), F.lit(2), F.greatest(F.size(F.col(rows)) - 1, F.lit(0)))).alias("row_idx", "_r"))
    each = body.select(*keys, "row_idx", "_h", F.get(F.col("_r"), F.lit(0)).alias("_first"), F.posexplode("_r").alias("col_idx", "data"))
    return each.where("col_idx > 0").select(*keys, "row_idx", "col_idx", "data", F.array("_first").alias("row_cats"), F.array(F.get(F.col("_h"), F.col("col_idx"))).alias("col_cats"))


#: Headers of the column, or row, that names the compounds, and cells that hold no value.
_NAMED_BY = re.compile(r"(?i)\b(?:compounds?|samples?|materials?|complex(?:es)?|names?|compositions?|entry|formula|substances?)\b")
_NO_VALUE = re.compile(r"\s*(?:[-–—−]|n/?[ad]\.?|not (?:determined|given)|none|no name)?\s*", re.I)


def _heads(grid: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """(headers of the columns, body): all rows up to the first with a number in it beyond the first column are headers, which
    are joined by column, repeated texts once. A row of one text in all columns in front of them is a title."""
    n = next((i for i, r in enumerate(grid) if i and any(re.match(rf"\s*{VALUE}", c or "") for c in r[1:])), 1)
    rows = [r for r in grid[:n] if len(set(r)) > 1 or len(r) == 1] or grid[:1]
    width = max(map(len, rows))
    return [" ".join(dict.fromkeys(c.strip() for r in rows if (c := r[j] if j < len(r) else "") and c.strip())) for j in range(width)], grid[n:]


def _named(text: str | None) -> dict | None:
    """The compound that a cell names, by a label or a name."""
    name = (text or "").strip()
    if not name or _NO_VALUE.fullmatch(name):
        return None
    return {"labels" if re.fullmatch(_LABEL, name) else "names": [name]}


def table_rows(grid: list[list[str]], models: list[Model], caption: str | None = None) -> Iterator[tuple[int, str, dict]]:
    """(row, model, record) of the cells of a table. The property stands in a column's header, or in a row's in
    tables with a compound for each column, or in the caption where a header only has a unit; the unit in the cell,
    its header or the caption; the compound in the column that says so, else in the first. Cells without a value give nothing."""
    if not grid:
        return
    U.register(*(u for m in models for u in m.units))
    head, body = _heads(grid)
    told = [m for m in models if is_quantity(m) and m["specifier"].pattern]
    named = next((j for j, h in enumerate(head) if _NAMED_BY.search(h)), 0)
    across = [(i, m) for i, r in enumerate(body) for m in told if r and re.search(rf"(?<!\w)(?:{m['specifier'].pattern})(?!\w)", r[0] or "")]
    heads = {(j, m.name): x for j, h in enumerate(head) for m in told if (x := re.search(rf"(?<!\w)(?:{m['specifier'].pattern})(?!\w)", h or ""))}

    def record(model: Model, cell: str, header: str, spec: str, compound: dict | None) -> dict | None:
        unit = unit_pattern(model.dimension)
        v = re.match(rf"\s*({VALUE})\s*({unit})?" if unit else rf"\s*({VALUE})", cell or "")
        if not v or _NO_VALUE.fullmatch(cell):
            return None
        own = v[2] if unit and v.lastindex and v.lastindex > 1 else None
        for place in (header, caption or "") if unit and not own else ():
            u = re.search(rf"(?<=[\s(/\[,]){unit}(?=[\s)\],]|$)", place)
            own = own or (u[0] if u else None)
        if unit and own is None:
            return None
        out = {"raw_value": v[1].strip(), "raw_units": own, "specifier": spec, "compound": compound}
        return {k: x for k, x in out.items() if x is not None}

    for model in told:
        for j, h in enumerate(head):
            m = heads.get((j, model.name))
            spec, rest = (m[0], h[m.end() :]) if m else (None, h)
            if m is None and not heads and not across and j != named and caption and unit_pattern(model.dimension):
                c = re.search(rf"(?<!\w)(?:{model['specifier'].pattern})(?!\w)", caption)
                spec = c[0] if c and re.search(rf"(?:^|[\s(/\[]){unit_pattern(model.dimension)}(?=[\s)\]]|$)", h or "") else None
                rest = " " + h
            if spec is None:
                continue
            for i, row in enumerate(body):
                found = record(model, row[j] if j < len(row) else "", rest, spec, _named(row[named]) if j != named and named < len(row) else None)
                if found:
                    yield i, model.name, found
    for i, model in across if not heads else ():
        row = body[i]
        m = re.search(rf"(?<!\w)(?:{model['specifier'].pattern})(?!\w)", row[0])
        for j in range(1, len(row)):
            found = record(model, row[j], row[0][m.end() :], m[0], _named(head[j] if j < len(head) else None))
            if found:
                yield i, model.name, found


def table_records(tables: DataFrame, keys: list[str], rows: str, models: list[Model], caption: str | None = None) -> DataFrame:
    """The records of tables held as ARRAY<ARRAY<STRING>>; rec_idx counts within a table. caption: a column."""
    schema = ", ".join(f"`{k}` {tables.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            out = []
            for *key, grid, told in zip(*(b[c] for c in [*keys, rows, "_caption"])):
                grid = [] if grid is None else [[c or "" for c in r] for r in grid]
                for i, (_, model, record) in enumerate(table_rows(grid, models, told)):
                    out.append((*key, i, model, "auto_table", json.dumps(record, ensure_ascii=False), {"record": 1.0}))
            yield pd.DataFrame(out, columns=[*keys, "rec_idx", "model", "method", "payload", "confidence"])

    said = (F.col(caption) if caption else F.lit(None).cast("string")).alias("_caption")
    return tables.select(*keys, rows, said).mapInPandas(run, f"{schema}, {RECORD}")
