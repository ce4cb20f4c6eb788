"""Null-aware value rules as column expressions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date layouts tried in this order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "yyyyMMdd", "yyyy-MM")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """The value as a double; null where it does not parse, and for NaN."""
    d = _col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def moment(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The value as a timestamp by the first layout that fits; null if none does."""
    c = _col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], c.try_cast("timestamp"))


def differs(c: Column | str, value) -> Column:
    """``!=`` that keeps nulls."""
    return ~_col(c).eqNullSafe(F.lit(value))


def outside(c: Column | str, values: Sequence) -> Column:
    """``not in`` that keeps nulls."""
    return F.coalesce(~_col(c).isin(list(values)), F.lit(True))


def matches(c: Column | str, pattern: str) -> Column:
    """Whether the value's text holds a match of the regular expression; null is no match."""
    return F.coalesce(_col(c).cast("string").rlike(pattern), F.lit(False))


def sum0(c: Column | str) -> Column:
    """A sum that is 0 over no values."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def period(c: Column, freq: str = "M", null_label: str | None = None) -> Column:
    """Calendar label of a timestamp: D, W (Monday/Sunday), M, Q or Y."""
    monday = F.date_trunc("week", c)
    labels = {
        "D": F.date_format(c, "yyyy-MM-dd"),
        "W": F.concat_ws(
            "/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday.cast("date"), 6), "yyyy-MM-dd")
        ),
        "M": F.date_format(c, "yyyy-MM"),
        "Q": F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")),
        "Y": F.date_format(c, "yyyy"),
    }
    key = freq.upper()[:1].replace("A", "Y")
    if key not in labels:
        raise ValueError(f"unknown frequency {freq!r}")
    return F.when(c.isNull(), F.lit(null_label)).otherwise(labels[key])


def semantic(kind: T.DataType) -> str:
    """temporal, quantitative (booleans too) or categorical."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)):
        return "temporal"
    return "quantitative" if isinstance(kind, (T.NumericType, T.BooleanType)) else "categorical"


def iso(c: Column | str) -> Column:
    """A timestamp as ISO text for JSON."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")
