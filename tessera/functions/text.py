"""String and number expressions with the conventions the engine's identities and scores rest on."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as a class that Java and RE2 read alike: ASCII, no-break and other Unicode spaces, line separators, byte-order mark.
SPACES = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def round_half_up(c: Column, digits: int = 2) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC. Only strings with other than ASCII characters go to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, SPACES + "+", " ")


def sha256_short(c: Column) -> Column:
    """First 12 hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 12)
