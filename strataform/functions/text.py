"""Canonical forms of scientific text, as Column -> Column functions.

All are built-in expressions but for the compatibility normal form, which Spark lacks: an Arrow function,
applied only to values outside ASCII.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the canonical forms: synonym phrases in order (first hit wins), whole words in order, elements.
SYNONYMS = (
    ("hydrochloric acid", "hcl"), ("hydrochloride acid", "hcl"), ("hydrogen chloride", "hcl"), ("nitric acid", "hno3"), ("sulfuric acid", "h2so4"), ("sulphuric acid", "h2so4"),
    ("ammonium hydroxide", "nh4oh"), ("ammonia solution", "nh4oh"), ("deionized water", "water"), ("ultrapure water", "water"), ("megaohm cm water", "water"), ("mohm cm water", "water"), ("mω cm water", "water"),
)
WORDS = ("hcl", "hno3", "h2so4", "nh4oh", "water")
ELEMENTS = {"cobalt": "co", "nickel": "ni", "copper": "cu", "thorium": "th", "radium": "ra", "actinium": "ac"}

#: White space and word characters as the canonical forms mean them: Unicode-aware.
STRIP = r"(?U)^\s+|\s+$"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility normal form; ASCII values never leave the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def fold_signs(c: Column) -> Column:
    """Multiplication sign to x, dashes to -, dots to spaces, ohm to its name. Input in compatibility form."""
    return F.replace(F.translate(c, "×−–—·•µ", "x---  u"), F.lit("Ω"), F.lit("ohm"))


def canonical_text(c: Column, normal_form: bool = True) -> Column:
    """Lower case, single spaces, only word characters and .-+()/ kept, `1 x 8` written `1x8`. Null -> ''.
    normal_form=False skips the compatibility form where the input is known to be in it."""
    t = strip(fold_signs(nfkc(c) if normal_form else c))
    t = F.regexp_replace(F.lower(t), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)[^\w.\-+()/]+", " ")
    t = F.regexp_replace(t, r"(?U)(\d)\s*[- ]?\s*x\s*[- ]?\s*(\d)", "$1x$2")
    return F.coalesce(strip(F.regexp_replace(t, r"(?U)\s+", " ")), F.lit(""))


def canonical_chemical(c: Column, canonical: bool = False) -> Column:
    """A token for the first synonym phrase held, else for the first known word, else the canonical text."""
    t = c if canonical else canonical_text(c)
    out = F.when(t == "", "")
    for phrase, token in SYNONYMS:
        out = out.when(F.contains(t, F.lit(phrase)), token)
    for w in WORDS:
        out = out.when(t.rlike(rf"(?U)\b{w}\b"), w)
    return out.otherwise(t)


def canonical_isotope(c: Column, canonical: bool = False) -> Column:
    """`58Co`, `cobalt-58` -> `58co`: mass and symbol; unknown element names give their first two letters."""
    t = c if canonical else canonical_text(c)
    packed = F.replace(t, F.lit(" "), F.lit(""))
    short, named = r"^([0-9]{1,3})([a-z]{1,3})$", r"^([a-z]+)\s*[- ]\s*([0-9]{1,3})$"
    mass = lambda x, p, g: F.regexp_extract(x, p, g).try_cast("int").cast("string")
    name = F.regexp_extract(t, named, 1)
    symbol = F.coalesce(F.create_map(*[F.lit(x) for x in chain(*ELEMENTS.items())])[name], F.substring(name, 1, 2))
    return F.when(packed.rlike(short), F.concat(mass(packed, short, 1), F.regexp_extract(packed, short, 2))).when(t.rlike(named), F.concat(mass(t, named, 2), symbol)).otherwise(t)


def canonical_eluent(c: Column, canonical: bool = False) -> Column:
    """Chemical without a leading molarity."""
    return canonical_chemical(without_molarity(c if canonical else canonical_text(c)), canonical=True)


def without_molarity(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\d+(?:\.\d+)?\s*m\s+", "")


def general_number(n: Column) -> Column:
    """Six significant digits without trailing zeros; exponent form below 1e-4 and from 1e6 on."""
    a = F.abs(n)
    e = F.when(a > 0, F.floor(F.log10(a))).otherwise(0)
    e = F.when((a > 0) & (F.round(a / F.pow(F.lit(10.0), e.cast("double")), 5) >= 10), e + 1).otherwise(e).cast("int")
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", F.round(n / F.pow(F.lit(10.0), (e - 5).cast("double"))) * F.pow(F.lit(10.0), (e - 5).cast("double"))), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    m = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", n / F.pow(F.lit(10.0), e.cast("double"))), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sci = F.concat(m, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    return F.when(n == 0, "0").when((e < -4) | (e >= 6), sci).otherwise(fixed)


def canonical_concentration(c: Column, canonical: bool = False) -> Column:
    """`6M`, `6.0 M` -> `6 m`; anything with `concentrated` -> `concentrated`; else the canonical text."""
    t = c if canonical else canonical_text(c)
    p = r"^(\d+(?:\.\d+)?)\s*m$"
    n = F.regexp_extract(t, p, 1).try_cast("double")
    r = F.rint(n)
    whole = F.abs(n - r) <= 1e-9 * F.greatest(F.abs(n), F.abs(r))
    return F.when(F.contains(t, F.lit("concentrated")), "concentrated").when(t.rlike(p), F.concat(F.when(whole, r.cast("decimal(38,0)").cast("string")).otherwise(general_number(n)), F.lit(" m"))).otherwise(t)


def canonical_id(c: Column) -> Column:
    """Identifier of a file or title: lower case, without .pdf and .json, runs of other characters as one _."""
    t = F.lower(strip(c))
    t = F.regexp_replace(F.regexp_replace(t, r"\.pdf(\.json)?$", ""), r"\.json$", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_id(path: Column) -> Column:
    return canonical_id(basename(path))


def experiment_number(path: Column) -> Column:
    """Number of the first path part like exp18; null where there is none."""
    part = F.get(F.filter(F.split(path, "/"), lambda p: p.rlike(r"(?i)^exp\d+$")), F.lit(0))
    return F.regexp_extract(part, r"(\d+)$", 1).try_cast("int")


def fingerprint(doi: Column, title: Column, source: Column, path: Column) -> Column:
    return F.struct(canonical_id(doi).alias("doi"), canonical_id(title).alias("title"), canonical_id(source).alias("source"), stem_id(path).alias("stem"))


def sanitize(c: Column, limit: int = 350_000) -> Column:
    """Without NUL; longer than limit: the first limit-40 characters, right-stripped, and a note."""
    note = "\n\n[... content truncated for API limits ...]"
    t = F.replace(c, F.lit("\x00"), F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit - 40), r"(?U)\s+$", ""), F.lit(note))).otherwise(t)


def retry_after_seconds(message: Column) -> Column:
    """Seconds of a hint like `try again in 250 ms` or `1.5 s`; null without one."""
    ms = F.regexp_extract(message, r"(?i)try again in\s+([0-9]+(?:\.[0-9]+)?)\s*ms\b", 1).try_cast("double")
    s = F.regexp_extract(message, r"(?i)try again in\s+([0-9]+(?:\.[0-9]+)?)\s*(?:seconds|second|sec|s)\b", 1).try_cast("double")
    return F.coalesce(ms / 1000, s)


def nonempty(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def is_small_instruct_family(model: Column, needle: str = "phi") -> Column:
    return F.contains(F.lower(model), F.lit(needle))


def reply_text(*candidates: Column) -> Column:
    """The first reply field that is there, stripped."""
    return strip(F.coalesce(*candidates, F.lit("")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in a])


def nfkc_all(texts: Column) -> Column:
    """Compatibility normal form of an array of texts; arrays of ASCII only never leave the JVM."""
    return F.when(F.exists(texts, lambda x: x.rlike(r"[^\x00-\x7F]")), _nfkc_all(texts)).otherwise(texts)


def item_key(section: str, canon: dict[str, Column], chem: Column | None = None, conc: Column | None = None, iso: Column | None = None, iso_name: Column | None = None) -> Column:
    """Canonical key of an item from its fields' canonical texts: non-empty parts joined by a pipe, which no part
    can hold. Canonical chemical, concentration and isotope may be given where they are computed already."""
    g = lambda n: canon.get(n, F.lit(""))
    conc = canonical_concentration(g("concentration"), True) if conc is None else conc
    iso = canonical_isotope(g("isotope"), True) if iso is None else iso
    if section == "target_materials":
        parts = [iso, g("chemical_formula"), g("name")]
    elif section == "acids_and_solvents":
        parts = [canonical_chemical(g("name"), True) if chem is None else chem, g("type"), conc]
    elif section == "resins_or_columns":
        parts = [g("name"), g("material")]
    elif section == "elution_conditions":
        parts = [canonical_eluent(g("eluent"), True) if chem is None else chem, conc]
    elif section == "final_products":
        named = canonical_isotope(g("name"), True) if iso_name is None else iso_name
        parts = [F.when(iso != "", iso).when(named.rlike(r"^[0-9]{1,3}[a-z]{1,3}$"), named).otherwise(""), g("name"), g("chemical_form")]
    else:
        return F.lit("")
    return F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts])
