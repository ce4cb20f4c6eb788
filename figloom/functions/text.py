"""Formatting, naming, URL and record helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of large numbers, fixed values.
SI_STEPS = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))


def si(v: Column) -> Column:
    """1500 -> 1.5K; whole numbers below 1000 as they are, others with two decimals."""
    v = v.cast("double")
    out = F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(F.format_string("%.2f", v))
    for size, suffix in reversed(SI_STEPS):
        out = F.when(F.abs(v) >= size, F.format_string(f"%.1f{suffix}", v / size)).otherwise(out)
    return F.when(v.isNotNull(), out)


def percent(v: Column) -> Column:
    return F.format_string("%.1f%%", v.cast("double") * 100)


def wrap(c: Column, width: int = 16) -> Column:
    """A line feed after every ``width`` characters but the last."""
    return F.regexp_replace(c, f"(.{{{width}}})(?=.)", "$1\n")


def shorten(c: Column, limit: int, tail: int = 0) -> Column:
    """The first characters, and the last ``tail``, of a text over ``limit``."""
    cut = F.concat(F.substring(c, 1, limit - tail), F.lit("..."), F.right(c, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def safe_name(c: Column, limit: int = 180) -> Column:
    """Characters unfit for file names become underscores."""
    return F.substring(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), 1, limit)


def has_token(c: Column, tokens: Sequence[str]) -> Column:
    """Whether the lower-case text holds any of the tokens."""
    return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.lower(c), t))


def first_text(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def authors(c: Column) -> Column:
    """``array<struct<given,family,name>>`` as ``Family, Given; ...``."""

    def one(a: Column) -> Column:
        given, family, name = (F.nullif(F.trim(a[k]), F.lit("")) for k in ("given", "family", "name"))
        return F.coalesce(F.nullif(F.concat_ws(", ", family, given), F.lit("")), name, F.lit(""))

    return F.array_join(F.filter(F.transform(F.coalesce(c, F.array()), one), lambda x: x != ""), "; ")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_key(c: Column) -> Column:
    """Host and path without a leading ``www.``, a query, a fragment or a last slash."""
    host = F.regexp_replace(url_host(c), r"^www\.", "")
    return F.concat(host, F.regexp_replace(url_path(c), r"/+$", ""))


def url_base(c: Column) -> Column:
    """The decoded last part of the path."""
    return F.try_url_decode(F.element_at(F.split(url_path(c), "/"), -1))


def likely_image(c: Column, blocked: Sequence[str] = (), image_hosts: Sequence[str] = ()) -> Column:
    """An http(s) URL that ends like an image or comes from an image host, and from no blocked one."""
    host, path = url_host(c), F.lower(url_path(c))
    bad = has_token(host, blocked) if blocked else F.lit(False)
    known = has_token(host, image_hosts) if image_hosts else F.lit(False)
    looks = path.rlike(r"\.(png|jpg|jpeg|gif|webp)$")
    return F.coalesce(c.rlike("^https?://") & ~bad & (looks | known), F.lit(False))


def compress_axis(v: Column, start: float, end: float, width: float) -> Column:
    """Axis position of a value when (start, end) is drawn ``width`` wide."""
    shift = (end - start) - width
    inner = F.lit(start) + (v - F.lit(start)) * F.lit(width / (end - start))
    return F.when(v >= end, v - F.lit(shift)).when(v > start, inner).otherwise(v)


def restore_axis(p: Column, start: float, end: float, width: float) -> Column:
    """The inverse of ``compress_axis``."""
    shift = (end - start) - width
    inner = F.lit(start) + (p - F.lit(start)) * F.lit((end - start) / width)
    return F.when(p >= start + width, p + F.lit(shift)).when(p > start, inner).otherwise(p)
