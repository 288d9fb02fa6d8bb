"""Unicode normal forms: the one thing Spark has no built-in for, as Arrow UDFs.

Everything else in this package is composed of built-in expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

NUKTA = "़"
ZERO_WIDTH = "‌‍﻿"
#: White space as Python's ``str.split`` and ``\\s`` see it.
WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def _each(s: pd.Series, f) -> pd.Series:
    return s.map(f, na_action="ignore")


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _each(s, lambda t: t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return _each(s, lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def without_nukta(t: str) -> str:
    """Decomposed, nukta dropped, composed again."""
    return t if t.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).replace(NUKTA, ""))


@pandas_udf(StringType())
def strip_nukta(s: pd.Series) -> pd.Series:
    return _each(s, without_nukta)


_DROP = dict.fromkeys(map(ord, ZERO_WIDTH))


@pandas_udf(StringType())
def bare_word(s: pd.Series) -> pd.Series:
    """NFC, zero-width characters dropped, nukta folded."""
    return _each(s, lambda t: t if t.isascii() else without_nukta(unicodedata.normalize("NFC", t).translate(_DROP)))


def once(f, *columns: Column) -> Column:
    """``f`` of the columns, each evaluated once before ``f``'s lambdas see it.

    Lambdas may then use columns that come from an Arrow UDF, which Spark doesn't allow inside them.
    """
    packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(packed), lambda p: f(*[p[f"c{i}"] for i in range(len(columns))])), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def words(c: Column) -> Column:
    """Words of a text; an empty text has none."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def decimal_digits() -> tuple[str, str]:
    """All decimal digits of Unicode but ASCII's, and their ASCII values, by rule."""
    import sys

    found = [chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def odd_digits() -> str:
    """Signs that are digits but not decimal ones (superscripts, circled digits), as a regex class body."""
    import sys

    found = [c for c in range(128, sys.maxunicode + 1) if chr(c).isdigit() and not chr(c).isdecimal()]
    return "".join(f"\\x{{{c:x}}}" for c in found)
