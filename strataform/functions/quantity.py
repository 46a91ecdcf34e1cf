"""Amounts written in free text: number, unit, and value in one unit per field, as Column expressions.

Units are composed by rule from prefixes, bases and notations, so that the tables stay short. Only single
amounts count: percentages, mass per volume, ranges, bed or column volumes and words give null.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.lookalikes import fold
from strataform.functions.stage import staged

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _words() -> dict[str, float]:
    w = {s: float(i) for i, s in enumerate(_ONES)} | {t: 10.0 * (k + 2) for k, t in enumerate(_TENS)}
    return w | {f"{t}-{_ONES[i]}": 10.0 * (k + 2) + i for k, t in enumerate(_TENS) for i in range(1, 10)} | {"hundred": 100.0, "half": 0.5}


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


_PREFIX = {"": 1.0, "k": 1e3, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
#: Volumes in mL.
_LITRES = {f"{p}{b}": v * 1e3 for p, v in _PREFIX.items() if p != "k" for b in ("L", "l")}
_VOLUME = _LITRES | {f"{w}{e}{s}": v * 1e3 for w, v in (("", 1.0), ("milli", 1e-3), ("micro", 1e-6), ("centi", 1e-2), ("deci", 1e-1)) for e in ("litre", "liter") for s in ("", "s")}
_VOLUME |= {"cc": 1.0, "ccm": 1.0, "cm3": 1.0, "dm3": 1e3, "m3": 1e6, "mm3": 1e-3}
_VOLUME |= {f"cubic {w}met{e}{s}": v for w, v in (("centi", 1.0), ("deci", 1e3), ("milli", 1e-3), ("", 1e6)) for e in ("re", "er") for s in ("", "s")}
#: Times in minutes.
_TIME = {**dict.fromkeys(["s", "sec", "second", "seconds"], 1 / 60), **dict.fromkeys(["min", "minute", "minutes"], 1.0), **dict.fromkeys(["h", "hr", "hrs", "hour", "hours"], 60.0), **dict.fromkeys(["d", "day", "days"], 1440.0)}
#: Amounts of substance in mol.
_AMOUNT = {f"{p}mol": v for p, v in _PREFIX.items()}
_MOLAR = {f"{p}M": v for p, v in _PREFIX.items() if p in ("", "m", "u", "n")} | {"molar": 1.0, "millimolar": 1e-3, "micromolar": 1e-6}
_CELSIUS = ["C", "°C", "° C", "deg C", "degC", "degree C", "degrees C", "degree Celsius", "degrees Celsius", "Celsius", "degrees celsius", "celsius"]
_KELVIN = ["K", "kelvin", "kelvins", "Kelvin", "°K", "deg K"]
_FAHRENHEIT = ["F", "°F", "° F", "deg F", "degF", "degree F", "degrees F", "degree Fahrenheit", "degrees Fahrenheit", "Fahrenheit", "degrees fahrenheit"]

FIELDS = ("concentration", "volume", "flow_rate", "temperature")
#: The one unit of each field.
BASE_UNIT = {"concentration": "mol/L", "volume": "mL", "flow_rate": "mL/min", "temperature": "°C"}

_DIGITS = r"[-+]?(?:[0-9]{1,3}(?:[ ,][0-9]{3})+(?![0-9])(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?|\.[0-9]+)"
_POWER = r"(?:[eE][-+]?[0-9]+| ?[xX×*] ?10 ?\^ ?[-+]?[0-9]+)?"
_NUMBER = f"^({_DIGITS})({_POWER})(?![0-9])"


def plain(text: Column) -> Column:
    """Look-alikes, signs and spaces brought to one form; the case stays, as units depend on it."""
    t = F.translate(fold(text), "µμº˚·–—−‐‑⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "uu°° -----0123456789-")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def read(df: DataFrame, text: str) -> DataFrame:
    """Adds n (leading number) and u (what follows it) of a text. In steps, so that no regular expression is
    evaluated twice. A comma before one or two digits (or after a lone zero) is decimal; a comma or space
    between groups of three digits is none."""
    t, d, p = F.col("__t"), F.col("__d"), F.col("__p")
    df = staged(df, {"__t": plain(F.col(text))})
    df = staged(df, {"__d": F.regexp_extract(t, _NUMBER, 1), "__p": F.regexp_extract(t, _NUMBER, 2), "__w": F.regexp_extract(t, r"^([A-Za-z]+(?:-[a-z]+)?) ", 1)})
    digits = F.regexp_replace(d, r"^([-+]?0),([0-9]+)$", "$1.$2")
    digits = F.translate(F.regexp_replace(digits, r"(?<=[0-9])[ ,](?=[0-9]{3}(?:[^0-9]|$))", ""), ",", ".").try_cast("double")
    power = F.when(p == "", 0.0).otherwise(F.regexp_extract(p, r"([-+]?[0-9]+)$", 1).try_cast("double"))
    n = F.when(d != "", digits * F.pow(F.lit(10.0), power)).when(F.col("__w") != "", _lookup(_words(), F.lower("__w")))
    rest = F.when(d != "", F.substring(t, F.length(d) + F.length(p) + 1, F.length(t))).when(F.col("__w") != "", F.substring(t, F.length("__w") + 1, F.length(t)))
    return staged(df, {"n": n, "u": F.trim(rest)}).drop("__t", "__d", "__p", "__w")


_PER = r"^(.+?)(?: ?/ ?| per | )([A-Za-z]+[0-9]?)$"
_INVERSE = r"^(.+?)[ .*]?([A-Za-z]+)\^?-([13])$"


def _ratio(u: Column, over: dict[str, float], under: dict[str, float]) -> Column:
    """Factor of 'a/b', 'a per b', 'a b-1' and 'a dm-3' notations."""
    top = F.coalesce(F.nullif(F.regexp_extract(u, _INVERSE, 1), F.lit("")), F.regexp_extract(u, _PER, 1))
    inv = F.concat(F.regexp_extract(u, _INVERSE, 2), F.regexp_replace(F.regexp_extract(u, _INVERSE, 3), "1", ""))
    low = F.coalesce(F.nullif(inv, F.lit("")), F.regexp_extract(u, _PER, 2))
    return _lookup(over, F.trim(top)) / _lookup(under, F.trim(low))


def value(field: str, n: Column, u: Column) -> Column:
    """The amount in the field's one unit; null where u is no unit of a single amount."""
    if field == "temperature":
        return F.when(u.isin(_CELSIUS), n).when(u.isin(_KELVIN), n - 273.15).when(u.isin(_FAHRENHEIT), (n - 32) * 5 / 9)
    if field == "volume":
        return n * _lookup(_VOLUME, u)
    if field == "flow_rate":
        return n * _ratio(u, _VOLUME, _TIME)
    return n * F.coalesce(_lookup(_MOLAR, u), _ratio(u, _AMOUNT, _VOLUME) * 1e3)


#: Units considered where a text has none: name -> (factor, offset) into the field's one unit.
CANDIDATES = {
    "concentration": {"mol/L": (1.0, 0.0), "mmol/L": (1e-3, 0.0), "umol/L": (1e-6, 0.0)},
    "volume": {"mL": (1.0, 0.0), "L": (1e3, 0.0), "uL": (1e-3, 0.0)},
    "flow_rate": {"mL/min": (1.0, 0.0), "mL/h": (1 / 60, 0.0), "uL/min": (1e-3, 0.0), "L/h": (1e3 / 60, 0.0)},
    "temperature": {"°C": (1.0, 0.0), "K": (1.0, -273.15), "°F": (5 / 9, -160 / 9)},
}
