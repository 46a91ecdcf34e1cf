"""Characters that look like ordinary ones, and the ordinary ones they stand for.

Compatibility forms (full width, mathematical styles, letter-like symbols) follow from Unicode's own
NFKC data; look-alikes of other scripts are fixed values, listed by script.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts with the Latin letters and digits they look like.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХЬЗаеѕіјорсухһԁԛԝьгпӏ", "ABESIJKMHOPCTYXb3aesijopcyxhdqwbrnl")
GREEK_CAPITAL = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
GREEK_SMALL = ("οινκρυχ", "oivkpux")
ARMENIAN = ("օսոհցզՕՍ", "ounhgqOU")
CHEROKEE = ("ᎪᏴᏟᎠᎬᎢᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃᎻᏴᎥᏀᎡ", "ABCDETJKLMPRSTVWZHBiGR")
LATIN_OTHER = ("ɡıɩʟɴʀᴄᴏᴠᴡᴢᴜ", "giilnrcovwzu")
# Invisible characters and spaces other than the plain one.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SPACES = "               　"
#: Greek letters that count as Greek where they stand alone (alpha-, beta, gamma) but not inside a word.
GREEK_ALONE = ("αβγ", "aBy")


@cache
def fold_pairs() -> tuple[str, str]:
    """(from, to): equally long strings for translate(); spaces included, invisible ones not."""
    pairs: dict[str, str] = {}
    for a, b in (CYRILLIC, GREEK_CAPITAL, GREEK_SMALL, ARMENIAN, CHEROKEE, LATIN_OTHER):
        for x, y in zip(a, b, strict=True):
            pairs.setdefault(x, y)
    blocks = [range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2100, 0x2150), range(0x2460, 0x24EA), range(0x249C, 0x24EA)]
    for block in blocks:
        for cp in block:
            c = chr(cp)
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and n != c and n.isascii():
                pairs.setdefault(c, n)
    pairs |= {s: " " for s in SPACES}
    return "".join(pairs), "".join(pairs.values())


@cache
def wide_pairs() -> dict[str, str]:
    """Characters that stand for several ordinary ones (ligatures, unit signs, fractions, Roman numerals, letters and
    numbers in brackets or with a point): their compatibility form, where that is written in ASCII, the degree sign
    and Greek letters."""
    out: dict[str, str] = {}
    for block in (range(0xBC, 0xBF), range(0x132, 0x14A), range(0x1C4, 0x1F4), range(0x2024, 0x2027), range(0x2033, 0x2058), range(0x2100, 0x2190), range(0x2460, 0x24EA), range(0x3250, 0x3260), range(0x32CC, 0x32D0), range(0x3371, 0x3400), range(0xFB00, 0xFB07)):
        for cp in block:
            n = unicodedata.normalize("NFKC", chr(cp)).translate({0x2044: "/", 0x2215: "/", 0x2032: "'"})
            if len(n) > 1 and all(x.isascii() or x in "°µμΩωπ" for x in n):
                out[chr(cp)] = n
    return out


def fold(c: Column) -> Column:
    """Invisible characters removed, look-alikes and odd spaces replaced. Null stays null."""
    a, b = fold_pairs()
    return F.translate(c, a + INVISIBLE, b)
