"""Models: what to extract, and how records of it are merged.

A model is a schema with flags, the patterns of its fields, and ranges within which missing fields may be taken
from other records. It is immutable; what a document defines (labels, specifiers) is passed beside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spagyric.spec import units as U


# --- distances -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    """A distance in documents, sections, paragraphs and sentences, compared in that order.

    bare: a single range that wasn't made by + or *. At a tie only bare ranges count as equal; hence the two
    predicates, and no others, decide what is near.
    """

    document: float = 0.0
    section: float = 0.0
    paragraph: float = 0.0
    sentence: float = 0.0
    bare: bool = True

    def __add__(self, other):
        return Range(*(a + b for a, b in zip(self.counts(), other.counts())), bare=False)

    def __sub__(self, other):
        return Range(*(a - b for a, b in zip(self.counts(), other.counts())), bare=False)

    def __mul__(self, n: float):
        return Range(*(a * n for a in self.counts()), bare=False)

    __rmul__ = __mul__

    def __truediv__(self, n: float):
        return self * (1 / n)

    def counts(self) -> tuple[float, float, float, float]:
        return self.document, self.section, self.paragraph, self.sentence


DOCUMENT, SECTION, PARAGRAPH, SENTENCE = Range(document=1.0), Range(section=1.0), Range(paragraph=1.0), Range(sentence=1.0)


def within(distance: Range, limit: Range) -> bool:
    return distance.counts() < limit.counts() or distance.counts() == limit.counts() and distance.bare and limit.bare


def beyond(distance: Range, limit: Range) -> bool:
    return distance.counts() > limit.counts() or distance.counts() == limit.counts() and not (distance.bare and limit.bare)


def range_struct(document: Column, section: Column, paragraph: Column, sentence: Column) -> Column:
    """The counts as a struct, which Spark compares lexicographically."""
    return F.struct(*(c.cast("double").alias(n) for c, n in ((document, "document"), (section, "section"), (paragraph, "paragraph"), (sentence, "sentence"))))


# --- fields and models ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """kind: string, double, list, set or a Model. pattern: what the field's text looks like in a sentence."""

    name: str
    kind: object = "string"
    pattern: str | None = None
    default: object = None
    null: bool = False
    required: bool = False
    requiredness: float = 1.0
    contextual: bool = False
    contextual_range: Range = DOCUMENT
    updatable: bool = False
    binding: bool = False
    ignore_when_merging: bool = False
    never_merge: bool = False

    def data_type(self) -> T.DataType:
        if isinstance(self.kind, Model):
            return self.kind.struct()
        if isinstance(self.kind, tuple):  # ('list' or 'set', kind)
            inner = replace(self, kind=self.kind[1])
            return T.ArrayType(inner.data_type())
        return {"string": T.StringType(), "double": T.DoubleType()}[self.kind]

    def is_empty(self, value) -> bool:
        return value is None or value == self.default or value == "" or value == [] or (isinstance(value, dict) and isinstance(self.kind, Model) and self.kind.is_empty(value))


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...] = ()
    dimension: U.Dimension | None = None
    no_merge_range: Range = 0 * SENTENCE
    triggers: tuple[str, ...] = ()
    units: tuple[U.Base, ...] = ()  # besides the built-in ones

    def extend(self, name: str, *fields: Field, **changes) -> "Model":
        """A model with these fields besides, or instead of those of the same name."""
        own = {f.name: f for f in self.fields} | {f.name: f for f in fields}
        return replace(self, name=name, fields=tuple(own.values()), **changes)

    def __getitem__(self, path: str) -> Field:
        head, _, rest = path.partition(".")
        f = next(f for f in self.fields if f.name == head)
        return f.kind[rest] if rest else f

    def struct(self) -> T.StructType:
        flags = lambda f: {"required": f.required, "contextual": f.contextual, "binding": f.binding, "updatable": f.updatable}
        return T.StructType([T.StructField(f.name, f.data_type(), True, flags(f)) for f in self.fields])

    def flatten(self) -> list["Model"]:
        """The model and all below it, by name."""
        out = {self.name: self}
        for f in self.fields:
            kind = f.kind[1] if isinstance(f.kind, tuple) else f.kind
            if isinstance(kind, Model):
                out |= {m.name: m for m in kind.flatten()}
        return [out[k] for k in sorted(out)]

    def required_fields(self) -> list[str]:
        """Names of required fields, nested ones joined by '__'."""
        out = [f.name for f in self.fields if f.required]
        for f in self.fields:
            if isinstance(f.kind, Model) and f.required:
                out += [f"{f.name}__{x}" for x in f.kind.required_fields()]
        return out

    # records are plain dicts of field values

    def is_empty(self, record: dict) -> bool:
        return all(f.is_empty(record.get(f.name)) for f in self.fields)

    def get(self, record: dict, path: str):
        """A value by key path; of a list the first member counts."""
        for name in path.split("."):
            record = record[0] if isinstance(record, list) and record else record
            record = record.get(name) if isinstance(record, dict) else None
        return record

    def required_fulfilled(self, record: dict, contextual: bool = True) -> bool:
        for f in self.fields:
            if f.required and (contextual or not f.contextual):
                value = record.get(f.name)
                if f.is_empty(value) or isinstance(f.kind, Model) and not f.kind.required_fulfilled(value):
                    return False
        return True

    def contextual_fulfilled(self, record: dict) -> bool:
        return all(not f.is_empty(record.get(f.name)) for f in self.fields if f.contextual)

    def requiredness(self, record: dict) -> float:
        """Product over empty fields of what they take from confidence."""
        out = 1.0
        for f in self.fields:
            if f.required and f.is_empty(record.get(f.name)):
                out *= 1 - f.requiredness
        return out

    def serialize(self, record: dict) -> dict:
        """{name of the model: fields}, without empty fields, sets as sorted lists."""
        out = {}
        for f in self.fields:
            value = record.get(f.name)
            if f.is_empty(value) and not f.null:
                continue
            if isinstance(f.kind, Model) and value is not None:
                value = f.kind.serialize(value)
            elif isinstance(f.kind, tuple) and value is not None:
                inner = f.kind[1]
                value = [inner.serialize(v) if isinstance(inner, Model) else v for v in value]
                value = sorted({v for v in value if v is not None}) if f.kind[0] == "set" and not isinstance(inner, Model) else value
            out[f.name] = value
        return {self.name: out}

    def deserialize(self, data: dict) -> dict:
        """The record out of its serialised form, class names around objects dropped."""

        def plain(x):
            if isinstance(x, list):
                return [plain(v) for v in x]
            if isinstance(x, dict):
                if len(x) == 1 and next(iter(x))[:1].isupper():
                    return plain(next(iter(x.values())))
                return {k: plain(v) for k, v in x.items()}
            return x

        return plain(data)

    def is_superset(self, a: dict, b: dict) -> bool:
        """Whether record a says all that record b says."""
        for f in self.fields:
            x, y = a.get(f.name), b.get(f.name)
            if f.is_empty(y):
                continue
            if f.is_empty(x):
                return False
            if isinstance(f.kind, Model):
                if not f.kind.is_superset(x, y):
                    return False
            elif isinstance(f.kind, tuple) and not isinstance(f.kind[1], Model):
                if not set(y) <= set(x):
                    return False
            elif x != y:
                return False
        return True


def superset_column(model: Model, a: Column, b: Column) -> Column:
    """``is_superset`` for flat models as a predicate on two structs."""
    out = F.lit(True)
    for f in model.fields:
        if isinstance(f.kind, Model):
            continue
        x, y = a[f.name], b[f.name]
        if isinstance(f.kind, tuple):
            out = out & (y.isNull() | (F.size(F.array_except(y, F.coalesce(x, F.array().cast(f.data_type())))) == 0))
        else:
            out = out & (y.isNull() | x.eqNullSafe(y))
    return out


def compatible_column(model: Model, a: Column, b: Column) -> Column:
    """No field has two different values; what may be merged at all."""
    out = F.lit(True)
    for f in model.fields:
        if not isinstance(f.kind, (Model, tuple)) and not f.ignore_when_merging:
            out = out & (a[f.name].isNull() | b[f.name].isNull() | (a[f.name] == b[f.name]))
    return out


# --- built-in models -----------------------------------------------------------------------------------------------

_SETTING = (
    Field("solvent", contextual=True),
    Field("temperature", contextual=True),
    Field("temperature_units", contextual=True),
    Field("concentration", contextual=True),
    Field("concentration_units", contextual=True),
)
COMPOUND = Model("Compound", (Field("names", ("set", "string")), Field("labels", ("set", "string"), updatable=True), Field("roles", ("set", "string"))))
APPARATUS = Model("Apparatus", (Field("name"),))
_OF = Field("compound", COMPOUND, contextual=True)
_WITH = Field("apparatus", APPARATUS, contextual=True)
QUANTITY = Model(
    "QuantityModel",
    (
        Field("raw_value", required=True, contextual=True),
        Field("raw_units", required=True, contextual=True),
        Field("value", ("list", "double")),
        Field("units"),
        Field("error", "double"),
        Field("specifier"),
    ),
)
DIMENSIONLESS_QUANTITY = QUANTITY.extend("DimensionlessModel", Field("raw_units"), dimension=U.DIMENSIONLESS)


def quantity_model(name: str, dimension: U.Dimension, specifier: str | None = None, *fields: Field, triggers: tuple[str, ...] = (), units: tuple[U.Base, ...] = ()) -> Model:
    """A model of a property with a value; specifier: a pattern of the words that name the property."""
    base = DIMENSIONLESS_QUANTITY if dimension == U.DIMENSIONLESS else QUANTITY
    spec = Field("specifier", pattern=specifier, required=specifier is not None, updatable=True)
    return base.extend(name, spec, *fields, dimension=dimension, triggers=triggers, units=units)


MELTING_POINT = quantity_model("MeltingPoint", U.TEMPERATURE, r"[Mm]elting (?:points?|range|temperature)|m\.?\s?pt?\.?|m\. ?p\.|Mp|Tm", *_SETTING[:1], *_SETTING[3:], _WITH, _OF, triggers=("melting", "mp", "m.p", "m.pt", "mpt", "Tm", "m. p"))
GLASS_TRANSITION = quantity_model("GlassTransition", U.TEMPERATURE, r"[Gg]lass[- ]transition(?: temperature)?|Tg", Field("method", contextual=True), _OF, triggers=("glass", "Tg"))
CURIE_TEMPERATURE = quantity_model("CurieTemperature", U.TEMPERATURE, r"Curie(?: transition)? temperatures?|Tc|TC", _OF, triggers=("Curie", "Tc"))
NEEL_TEMPERATURE = quantity_model("NeelTemperature", U.TEMPERATURE, r"N[eé]el temperatures?|TN", _OF, triggers=("Neel", "Néel", "TN"))
INTERATOMIC_DISTANCE = quantity_model("InteratomicDistance", U.LENGTH, r"[A-Z][a-z]?[-–−][A-Z][a-z]?", _OF)
COORDINATION_NUMBER = quantity_model("CoordinationNumber", U.DIMENSIONLESS, r"[A-Z][a-z]?[-–−][A-Z][a-z]?", Field("label", pattern=r"[A-Z][a-z]?[-–−][A-Z][a-z]?"), _OF)
UVVIS_PEAK = Model("UvvisPeak", (Field("value"), Field("units", contextual=True), Field("extinction"), Field("extinction_units", contextual=True), Field("shape")))
IR_PEAK = Model("IrPeak", (Field("value"), Field("units", contextual=True), Field("strength"), Field("bond")))
NMR_PEAK = Model("NmrPeak", (Field("shift"), Field("intensity"), Field("multiplicity"), Field("coupling"), Field("coupling_units", contextual=True), Field("number"), Field("assignment")))
UVVIS_SPECTRUM = Model("UvvisSpectrum", (*_SETTING, _WITH, Field("peaks", ("list", UVVIS_PEAK)), _OF), triggers=("UV", "λmax", "lambda"))
IR_SPECTRUM = Model("IrSpectrum", (*_SETTING, _WITH, Field("peaks", ("list", IR_PEAK)), _OF), triggers=("IR", "FT-IR", "cm"))
NMR_SPECTRUM = Model("NmrSpectrum", (Field("nucleus"), *_SETTING, Field("frequency", contextual=True), Field("frequency_units", contextual=True), Field("standard", contextual=True), _WITH, Field("peaks", ("list", NMR_PEAK)), _OF), triggers=("NMR",))
_NUMBER = r"(?:~|ca\. ?)?\d+(?:\.\d+)?(?: ?[±] ?\d+(?:\.\d+)?)?"
#: Values behind the words that name them, or in front of them; (?P<v>) is the part that is taken.
QUANTUM_YIELD = Model("QuantumYield", (Field("value", pattern=rf"quantum (?:yields?|efficiency)(?:\W+\w+){{0,3}}?\W+(?P<v>{_NUMBER})", required=True), Field("units", pattern=rf"{_NUMBER} ?(?P<v>%)(?!\w)"), *_SETTING, Field("standard", pattern=r"(?:relative to|against|versus) (?P<v>[\w ]+?)(?= (?:as|in)|[,.;(]|$)"), Field("standard_value", pattern=rf"standard \((?:\w+ ?= ?)?(?P<v>{_NUMBER})\)"), _WITH, _OF), triggers=("quantum",))
FLUORESCENCE_LIFETIME = Model("FluorescenceLifetime", (Field("value", pattern=rf"lifetimes?(?:\W+\w+){{0,3}}?\W+(?P<v>{_NUMBER})", required=True), Field("units", pattern=rf"{_NUMBER} ?(?P<v>[pnµμm]?s)"), *_SETTING, _WITH, _OF), triggers=("lifetime",))
ELECTROCHEMICAL_POTENTIAL = Model("ElectrochemicalPotential", (Field("value", pattern=rf"(?:potentials?|E(?:ox|red|1/2)|E½)(?:\W+\w+){{0,3}}?\s+(?:=\s*)?(?P<v>[-–−+]?{_NUMBER})", required=True), Field("units", pattern=rf"{_NUMBER} ?(?P<v>m?V)"), Field("type", pattern=r"oxidation|reduction|half-wave|redox|onset"), *_SETTING, _WITH, _OF), triggers=("potential", "Eox", "Ered", "E1/2", "E½"))
BUILT_IN = {m.name: m for m in (COMPOUND, APPARATUS, MELTING_POINT, GLASS_TRANSITION, CURIE_TEMPERATURE, NEEL_TEMPERATURE, INTERATOMIC_DISTANCE, COORDINATION_NUMBER, UVVIS_SPECTRUM, IR_SPECTRUM, NMR_SPECTRUM, QUANTUM_YIELD, FLUORESCENCE_LIFETIME, ELECTROCHEMICAL_POTENTIAL)}
