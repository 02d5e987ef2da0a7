"""Scalar expressions: change rates, cleaning, .NET dates and text predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATE = 0


def pct_change(start: Column, end: Column) -> Column:
    """Change as a fraction of ``|start|``; null when start is null or 0, or end is null."""
    return (end - start) / F.abs(F.nullif(start, F.lit(0.0)))


def cagr(start: Column, end: Column, periods: Column) -> Column:
    """Compound growth per period; null unless both values and the span are positive."""
    defined = (start > 0) & (end > 0) & (periods > 0)
    return F.when(defined, F.pow(end / start, F.lit(1.0) / periods) - 1)


def clean_dash(value: Column) -> Column:
    """An exact ``-`` means "no value"."""
    return F.nullif(value, F.lit("-"))


def as_int(value: Column) -> Column:
    """Null-safe integer; a fractional number is truncated, other text is an error."""
    return value.cast("int")


def is_blank(value: Column) -> Column:
    """True for null and for text that is empty."""
    return value.isNull() | (value == "")


def dotnet_millis(value: Column) -> Column:
    """Milliseconds of a ``/Date(ms)/`` string, 0 when there is none."""
    digits = F.regexp_extract(F.coalesce(value, F.lit("")), r"/Date\((-?\d+)\)/", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(NO_DATE).cast("bigint"))


def dotnet_timestamp(value: Column) -> Column:
    """UTC instant of a ``/Date(ms)/`` string, null when there is none."""
    return F.timestamp_millis(F.nullif(dotnet_millis(value), F.lit(NO_DATE)))


def contains_text(value: Column, needle: str | Column) -> Column:
    """Case-insensitive literal substring test; null text never matches."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lower(needle))


def contains_any(values: Sequence[Column], needle: str | Column) -> Column:
    """True when any of several columns contains the needle."""
    test = F.lit(False)
    for value in values:
        test = test | contains_text(value, needle)
    return test


def starts_with_text(value: Column, prefix: str) -> Column:
    """Case-insensitive literal prefix test; null text never matches."""
    return F.startswith(F.lower(F.coalesce(value, F.lit(""))), F.lit(prefix.lower()))


def equals_any(value: Column, choices: Sequence) -> Column:
    """Equality with one or many choices; an empty list is no filter."""
    return value.isin(list(choices)) if choices else F.lit(True)
