"""Scalar text functions (null tokens, labels, tokens, Cyrillic share)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "no number".
NULL_TOKENS = (
    "NaN", "nan", "+NaN", "-NaN", "NA", "N/A", "na", "n/a",
    "null", "NULL", "None", "none", "", "-", "—",
)

# Cell texts that carry no data in a placeholder row.
PLACEHOLDER_CELLS = ("", "-", "—", "N/A")

EM_DASH = "—"
MIN_TOKEN_LENGTH = 3

# White space as the statement formats use it (includes no-break spaces).
BLANKS = (
    " \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """Bind a computed value once inside an expression that uses it several times."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def trimmed(c: Column) -> Column:
    """``trim`` that also removes tabs, line breaks and no-break spaces."""
    return F.btrim(c, F.lit(BLANKS))


def is_null_like(c: Column) -> Column:
    return c.isNull() | trimmed(c).isin(*NULL_TOKENS)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tokens(c: Column, letters: str = "a-z") -> Column:
    """Lower-case word tokens of three letters or more.

    The default alphabet is ASCII; pass ``letters=r"\\p{L}"`` to keep words of
    other scripts.
    """
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{letters}0-9]+")
    word = f"^[{letters}]{{{MIN_TOKEN_LENGTH},}}$"
    return F.filter(parts, lambda t: t.rlike(word))


def cyrillic_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\u0400-\u04ff]"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def cyrillic_ratio(c: Column) -> Column:
    """Share of Cyrillic among ASCII and Cyrillic letters; 0 without letters."""
    cyr, lat = cyrillic_letters(c), latin_letters(c)
    return F.when(cyr + lat == 0, F.lit(0.0)).otherwise(cyr / (cyr + lat))


def display_label(description: Column, counterparty: Column, bank_category: Column, mcc: Column) -> Column:
    """First non-blank identifying text of a transaction."""

    def present(c: Column) -> Column:
        return F.nullif(trimmed(c), F.lit(""))

    return F.coalesce(
        present(description), present(counterparty), present(bank_category), mcc, F.lit(EM_DASH)
    )


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        yield names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def normalize_key(c: Column) -> Column:
    """Header name as recall key: NFC, then trimmed.

    Spark has no Unicode normalisation, so this is the one Arrow UDF of the
    library; apply it to distinct header names, never to transactions.
    """
    return trimmed(_nfc(c))
