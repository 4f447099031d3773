"""Dimensions, units and quantities: algebra on the driver, conversion in Catalyst.

A dimension is a map of base dimensions to powers, a unit a map of unit names to powers with a decimal
magnitude. Values are converted as (v * 10 ** magnitude) * scale + offset, by column arithmetic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Powers:
    """Something with powers, that multiplies, divides and is raised; zero powers go."""

    powers: tuple[tuple[str, float], ...] = ()

    @classmethod
    def of(cls, powers: dict[str, float], **rest):
        return cls(tuple(sorted((k, float(v)) for k, v in powers.items() if abs(v) > 1e-12)), **rest)

    def _joined(self, other, sign: int) -> dict[str, float]:
        out = dict(self.powers)
        for k, v in other.powers:
            out[k] = out.get(k, 0.0) + sign * v
        return out


@dataclass(frozen=True)
class Dimension(Powers):
    def __mul__(self, other):
        return Dimension.of(self._joined(other, 1))

    def __truediv__(self, other):
        return Dimension.of(self._joined(other, -1))

    def __pow__(self, power: float):
        return Dimension.of({k: v * power for k, v in self.powers})

    def __str__(self):
        return "  ".join(f"{k}^({v})" for k, v in self.powers) or "Dimensionless"


DIMENSIONLESS = Dimension()
TEMPERATURE, LENGTH, TIME, MASS, CURRENT, AMOUNT, ANGLE, RATIO = (Dimension.of({x: 1}) for x in ("Temperature", "Length", "Time", "Mass", "ElectricalCurrent", "AmountOfSubstance", "Angle", "Ratio"))
ENERGY = MASS * LENGTH**2 / TIME**2
POWER = ENERGY / TIME
CHARGE = CURRENT * TIME
POTENTIAL = POWER / CURRENT


@dataclass(frozen=True)
class Base:
    """A named unit: value in the standard unit = value * scale + offset."""

    name: str
    dimension: Dimension
    scale: float
    offset: float
    pattern: str


#: The named units, the standard one of each dimension first.
BASES = [
    Base("Kelvin", TEMPERATURE, 1.0, 0.0, r"°?(?:[Kk]elvins?|K)\.?"),
    Base("Celsius", TEMPERATURE, 1.0, 273.15, r"(?:°C|℃|[Cc]elsius|[Dd]eg(?:rees?|\.)? ?C(?:elsius|entigrades?)?)\.?"),
    Base("Fahrenheit", TEMPERATURE, 5 / 9, 459.67 * 5 / 9, r"°?(?:[Ff]ahrenheit|F)\.?"),
    Base("Meter", LENGTH, 1.0, 0.0, r"[Mm]et(?:er|re)s?|m"),
    Base("Mile", LENGTH, 1609.34, 0.0, r"[Mm]iles?"),
    Base("Angstrom", LENGTH, 1e-10, 0.0, r"[ÅÅ]"),
    Base("Micron", LENGTH, 1e-6, 0.0, r"[Mm]icrons?"),
    Base("Second", TIME, 1.0, 0.0, r"s(?:ec(?:ond)?s?)?"),
    Base("Minute", TIME, 60.0, 0.0, r"min(?:ute)?s?"),
    Base("Hour", TIME, 3600.0, 0.0, r"h(?:ours?|rs?)?"),
    Base("Day", TIME, 86400.0, 0.0, r"d(?:ays?)?"),
    Base("Year", TIME, 31536000.0, 0.0, r"y(?:ears?|rs?)?"),
    Base("Gram", MASS, 1.0, 0.0, r"g(?:rams?)?"),
    Base("Pound", MASS, 453.592, 0.0, r"pounds?|lbs?"),
    Base("Tonne", MASS, 1e6, 0.0, r"[Tt]onnes?|t"),
    Base("Joule", ENERGY, 1.0, 0.0, r"[Jj]oules?|J"),
    Base("ElectronVolt", ENERGY, 1.602176634e-19, 0.0, r"[Ee]lectron[Vv]olts?|eV"),
    Base("Erg", ENERGY, 1e-7, 0.0, r"[Ee]rgs?"),
    Base("Watt", POWER, 1.0, 0.0, r"[Ww]atts?|W"),
    Base("Volt", POTENTIAL, 1.0, 0.0, r"[Vv]olts?|V"),
    Base("Coulomb", CHARGE, 1.0, 0.0, r"[Cc]oulombs?|C"),
    Base("Ampere", CURRENT, 1.0, 0.0, r"[Aa]mp(?:ere)?s?|A"),
    Base("Mol", AMOUNT, 1.0, 0.0, r"[Mm]oles?|[Mm]ol"),
    Base("Degrees", ANGLE, 1.0, 0.0, r"[°º˚⁰∘]"),
    Base("Percent", RATIO, 1.0, 0.0, r"%"),
]
BASE_OF = {b.name: b for b in BASES}


def register(*units: Base) -> None:
    """Makes units of one's own known in this process. Units that stand in a model are registered wherever it is used, on
    workers too; a name that is known keeps its meaning."""
    for b in units:
        if b.name not in BASE_OF:
            BASE_OF[b.name] = b
            BASES.append(b)


#: Decimal prefixes.
PREFIXES = {"c": -2, "k": 3, "M": 6, "G": 9, "T": 12, "m": -3, "µ": -6, "μ": -6, "n": -9, "p": -12}
_LONG = {"centi": -2, "kilo": 3, "mega": 6, "giga": 9, "tera": 12, "milli": -3, "micro": -6, "nano": -9, "pico": -12}


@dataclass(frozen=True)
class Unit(Powers):
    magnitude: float = field(default=0.0, kw_only=True)

    def __mul__(self, other):
        return Unit.of(self._joined(other, 1), magnitude=self.magnitude + other.magnitude)

    def __truediv__(self, other):
        return Unit.of(self._joined(other, -1), magnitude=self.magnitude - other.magnitude)

    def __pow__(self, power: float):
        return Unit.of({k: v * power for k, v in self.powers}, magnitude=self.magnitude * power)

    @property
    def dimension(self) -> Dimension:
        out = DIMENSIONLESS
        for k, v in self.powers:
            out = out * BASE_OF[k].dimension ** v
        return out

    def __str__(self):
        head = f"(10^{self.magnitude}) * " if self.magnitude else ""
        return head + "  ".join(f"{k}^({v})" for k, v in self.powers)

    def affine(self) -> tuple[float, float]:
        """(scale, offset) to the product of standard units; only a lone unit has an offset."""
        scale = 10.0**self.magnitude
        for k, v in self.powers:
            scale *= BASE_OF[k].scale ** v
        lone = len(self.powers) == 1 and self.powers[0][1] == 1.0
        return scale, BASE_OF[self.powers[0][0]].offset if lone else 0.0


def parse_unit(text: str | None, dimension: Dimension | None = None, strict: bool = False) -> Unit | None:
    """The unit a text states: products, '/', powers (also fractions) and brackets.

    dimension narrows which named units are looked for, as 'm' or 'C' mean different things; what doesn't fit it,
    or has parts that aren't units, is None, or a ValueError if strict.
    """
    try:
        if text is None or not text.strip():
            raise ValueError("no text")
        s = re.sub(r"[\s·⋅*]", "", text.translate(str.maketrans("–−‐‑⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "-----0123456789")))
        if s[0] == "[" and s[-1] == "]":
            s = s[1:-1]
        while s.count(")") > s.count("(") and s.endswith(")"):
            s = s[:-1]
        names = {n for n, _ in dimension.powers} if dimension is not None else None
        bases = [b for b in BASES if names is None or {n for n, _ in b.dimension.powers} <= names or b.dimension == dimension]
        unit, at = _product(s, 0, bases)
        if at != len(s) or not unit.powers:
            raise ValueError(f"not a unit: {text}")
        if dimension is not None and unit.dimension != dimension:
            raise ValueError(f"{text} has dimension {unit.dimension}")
        return unit
    except ValueError:
        if strict:
            raise
        return None


_POWER = re.compile(r"\^?\(?(-?\d+(?:\.\d+)?(?:/\d+)?)\)?")


def _power(s: str, at: int) -> tuple[float, int]:
    m = _POWER.match(s, at)
    if not m:
        return 1.0, at
    if m[0].count("(") != m[0].count(")"):
        m = re.compile(r"\^?(-?\d+(?:\.\d+)?(?:/\d+)?)").match(s, at)
        if not m:
            return 1.0, at
    try:
        return float(Fraction(m[1])), m.end()
    except ZeroDivisionError as e:
        raise ValueError("power by zero") from e


def _product(s: str, at: int, bases: list[Base]) -> tuple[Unit, int]:
    out, sign = Unit(), 1.0
    while at < len(s) and s[at] != ")":
        if s[at] == "/":
            sign, at = -1.0, at + 1
            continue
        if s[at] == "(":
            part, end = _product(s, at + 1, bases)
            if end >= len(s):
                raise ValueError("bracket not closed")
            power, end = _power(s, end + 1)
            out, at, sign = out * part ** (sign * power), end, 1.0
            continue
        if s[at] == "-" and not re.match(r"-\d", s[at:]):
            at += 1
            continue
        part, end = _named(s, at, bases)
        power, end = _power(s, end)
        out, at = out * part ** (sign * power), end
    return out, at


def _named(s: str, at: int, bases: list[Base]) -> tuple[Unit, int]:
    """The named unit at a place, the longest one; a prefix counts only where no unit is as long."""
    best: tuple[int, int, Unit] | None = None
    for prefix, magnitude in (("", 0), *_LONG.items(), *PREFIXES.items()):
        if not s.startswith(prefix, at):
            continue
        for b in bases:
            m = re.compile(b.pattern).match(s, at + len(prefix))
            if m and m.end() > m.start():
                found = (m.end(), -bool(prefix), Unit.of({b.name: 1}, magnitude=float(magnitude)))
                if best is None or found[:2] > best[:2]:
                    best = found
    if best is None:
        raise ValueError(f"no unit at {s[at:]}")
    return best[2], best[0]


# --- quantities ------------------------------------------------------------------------------------------------


def convert(value: Column, source: Unit, target: Unit) -> Column:
    """A DOUBLE, or an ARRAY of them, in another unit of the same dimension."""
    if source.dimension != target.dimension:
        raise ValueError(f"{source} and {target} have different dimensions")
    (a, b), (c, d) = source.affine(), target.affine()
    return (value.cast("double") * F.lit(a) + F.lit(b) - F.lit(d)) / F.lit(c)


def convert_error(error: Column, source: Unit, target: Unit) -> Column:
    """An uncertainty, which no offset moves."""
    return error.cast("double") * F.lit(source.affine()[0] / target.affine()[0])


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit, dimension, scale, offset) of the named units: a dimension table of fixed size."""
    return spark.createDataFrame([(b.name, str(b.dimension), b.scale, b.offset) for b in BASES], "unit string, dimension string, scale double, offset double")


def parsed_units(texts: DataFrame, column: str, dimension: Dimension | None = None) -> DataFrame:
    """(column, unit, scale, offset) of the distinct texts that state a unit: the parser runs once for each
    spelling, and the result is to be joined back."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for t in b[column]:
                u = parse_unit(t, dimension)
                if u is not None:
                    out.append((t, str(u), *u.affine()))
            yield pd.DataFrame(out, columns=[column, "unit", "scale", "offset"])

    return texts.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, unit string, scale double, offset double")


def overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two intervals, in one unit, meet: what makes two quantities equal within their errors."""
    return (a_low <= b_high) & (b_low <= a_high)


def multiply(a: Column, b: Column) -> Column:
    """Product of two value arrays: elementwise for two ranges, else each element with the single value."""
    one = lambda x, y: F.transform(x, lambda v: v * F.get(y, F.lit(0)))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x * y)).when(F.size(b) == 1, one(a, b)).when(F.size(a) == 1, one(b, a))
