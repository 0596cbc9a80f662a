"""String normalisation, missing-value tests and number parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from assayer.functions.tokens import WHITESPACE

# Fixed patterns: a plain number, an infinity word, and an identifier-like value.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_WORD = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
STRUCTURED_ID = r"^[A-Za-z]*[-_]?\d+[A-Za-z0-9_-]*$"
CURRENCY_MARKS = r"[,$₹€£%]"


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def trimmed(col: Column) -> Column:
    return F.btrim(col.cast("string"), F.lit(WHITESPACE))


def folded(col: Column) -> Column:
    """Trimmed and lower-cased, the form in which vocabularies are compared."""
    return F.lower(trimmed(col))


def in_words(col: Column, words: Iterable[str]) -> Column:
    return folded(col).isin(list(words))


def missing_like(col: Column, dtype: T.DataType, words: Iterable[str]) -> Column:
    """NULL, or (string columns only) text that stands for a missing value."""
    return (col.isNull() | in_words(col, words)) if is_string(dtype) else col.isNull()


def text_to_number(text: Column) -> Column:
    """Plain numeric text to double; anything else, including NaN, to NULL.

    The pattern test keeps out forms the JVM parser takes but a data file never
    means as numbers (``5f``, ``0x1p3``).
    """
    return (
        F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
        .when(text.rlike(INFINITY_WORD), text.try_cast("double"))
    )


def to_number(col: Column, dtype: T.DataType, lenient: bool = False) -> Column:
    """Numeric value of any column; ``lenient`` also strips currency marks, commas and percent."""
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        value = col.cast("double")
        return F.nanvl(value, F.lit(None).cast("double"))
    text = trimmed(col)
    if lenient:
        text = F.btrim(F.regexp_replace(text, CURRENCY_MARKS, ""), F.lit(WHITESPACE))
    return text_to_number(text)


def finite(value: Column) -> Column:
    """Infinities count as missing in exploration and charts."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)
