"""Datetime parsing: a fixed list of formats, tried in order, plus a mixed fallback."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F, types as T

from assayer.functions.text import is_temporal, trimmed


class DateFormat(NamedTuple):
    label: str    # strptime form, as reported
    pattern: str  # datetime pattern Spark parses with
    shape: str    # regex the text must match before the parser is called


# The formats in the order in which they are tried.
DATE_FORMATS = (
    DateFormat("%Y-%m-%d", "yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    DateFormat("%Y/%m/%d", "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    DateFormat("%d-%m-%Y", "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    DateFormat("%d/%m/%Y", "d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    DateFormat("%m-%d-%Y", "M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    DateFormat("%m/%d/%Y", "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    DateFormat("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    DateFormat("%Y/%m/%d %H:%M:%S", "yyyy/M/d H:m:s", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    DateFormat("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    DateFormat("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    DateFormat("%d/%m/%Y %H:%M:%S", "d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    DateFormat("%Y-%m", "yyyy-M", r"^\d{4}-\d{1,2}$"),
    DateFormat("%Y/%m", "yyyy/M", r"^\d{4}/\d{1,2}$"),
    DateFormat("%b %d %Y", "MMM d yyyy", r"^[A-Za-z]{3} \d{1,2} \d{4}$"),
    DateFormat("%B %d %Y", "MMMM d yyyy", r"^[A-Za-z]{3,9} \d{1,2} \d{4}$"),
    DateFormat("%d %b %Y", "d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    DateFormat("%d %B %Y", "d MMMM yyyy", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
)
BY_LABEL = {f.label: f for f in DATE_FORMATS}
MIXED = "mixed"
# Every text one of the formats or the ISO fallback can parse has this shape.
DATE_LIKE = r"^(?=.*\d)[0-9A-Za-z][0-9A-Za-z:/ .+\-]{3,39}$"
# Bare digits are numbers, not dates, unless they are a year or a compact date.
ISO_SHAPE = r"[-:]|^\d{4}$"
COMPACT = DateFormat("%Y%m%d", "yyyyMMdd", r"^\d{8}$")


def parse_format(text: Column, fmt: DateFormat) -> Column:
    """Parse trimmed text with one format.

    The shape test comes first: a failed parse raises and catches a Java
    exception per row, a failed regex costs nothing, and the shape is implied by
    the format anyway.
    """
    parsed = F.try_to_timestamp(text, F.lit(fmt.pattern)).cast("timestamp_ntz")
    return F.when(text.rlike(fmt.shape), parsed)


def parse_mixed(text: Column) -> Column:
    """First format that fits each value on its own, then ISO 8601 forms."""
    iso_text = F.when(text.rlike(ISO_SHAPE), text).try_cast("timestamp_ntz")
    tries = [parse_format(text, f) for f in (*DATE_FORMATS, COMPACT)]
    return F.when(text.rlike(DATE_LIKE), F.coalesce(*tries, iso_text))


def to_datetime(col: Column, dtype: T.DataType, label: str | None = None) -> Column:
    """Datetime value of any column, by the format recorded for it or the mixed rule."""
    if is_temporal(dtype):
        return col.cast("timestamp_ntz")
    text = trimmed(col)
    return parse_format(text, BY_LABEL[label]) if label in BY_LABEL else parse_mixed(text)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def iso(ts: Column) -> Column:
    """ISO 8601 text; the fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.extract(F.lit("SECOND"), ts) % 1 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
