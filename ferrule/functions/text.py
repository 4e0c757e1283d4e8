"""JVM-side text expressions shared by the operators, and the few that Spark lacks as Arrow functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of "nothing here", lower case, without outer blanks.
MISSING = ("", "none", "null", "nil", "nan", "n/a", "n.a.", "na", "n.d.", "nd", "-", "--", "---", "–", "—", "?", "unknown", "missing", "not available", "not given", "untitled", "tbd")

#: White space in the wide sense, for regular expressions of Java.
BLANK = r"[\s\u0085   -​    　﻿]"

#: The same, one character after the other, for ``btrim``.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    """Outer white space removed, inner white space as one space each."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def stated(c: Column) -> Column:
    """The trimmed text, or null where it says that nothing is stated."""
    t = strip(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition."""
    return _nfkc(c)


def nfc(c: Column) -> Column:
    """Unicode canonical composition."""
    return _nfc(c)
