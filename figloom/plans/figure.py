"""From a table to a figure document: spec, mark-ready rows of bounded size, scale hints, scores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import encode as E
from ..operators import marks as M
from ..operators import stats as S
from ..sources.tables import ROW
from . import spec as P

#: Rows of an overlay that a document holds at most.
ROWS = 5_000


class SlotProvider(Protocol):
    """Gives data steps (prepare, aggregate, encode) beyond the default ones."""

    def slots(self, spec: dict) -> dict[str, Callable[[DataFrame, dict], DataFrame]]: ...


class Renderer(Protocol):
    def render(self, document: dict) -> bytes: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> str | None: ...


class Judge(Protocol):
    def judge(self, document: dict, image: bytes) -> dict: ...


def columns_of(df: DataFrame) -> P.Columns:
    """Kinds, distinct counts and rows."""
    profile = S.coarse_profile(df)
    counts = {r["name"]: r["distinct"] for r in S.profile_counts(df).collect()}
    return P.Columns(profile["columns"], counts, profile["n"])


def mark_table(df: DataFrame, o: dict, ratio: bool) -> DataFrame:
    """The overlay's mark-ready rows."""
    x, y, g = o["x"], o["y"], o.get("group")
    mark, variant = o["mark"], o.get("variant", "main")
    if mark == "bar":
        if g is None:
            return M.waterfall(df, x, y) if variant == "waterfall" else M.bar(df, x, y, ratio)
        makers = {"stacked": M.bar_stacked, "grouped": M.bar_grouped}
        return M.bar_percent(df, x, g, y) if variant == "percent" else makers.get(variant, M.bar_grouped)(df, x, g, y, ratio)
    if mark == "area":
        return M.area_stacked(df, x, g, y, ratio) if g else M.line(df, x, y, None, ratio)
    if mark == "line":
        return M.line(df, x, y, g, ratio)
    if mark in ("scatter", "lollipop"):
        return M.points(df, [c for c in (x, g, y) if c], x, y)
    tables = {"hist": lambda: M.histogram(df, y), "hexbin": lambda: M.hexbin(df, x, y), "boxplot": lambda: M.box(df, y, x), "violin": lambda: M.violin(df, y, x)}
    return M.heatmap(df, g or x, x, y) if mark == "heatmap" else tables[mark]()


def in_order(table: DataFrame, df: DataFrame, o: dict) -> DataFrame:
    """An overlay's rows as they are drawn: by series and x, in order of first appearance where the table has row numbers, else by value."""
    keys = []
    for c in (o.get("group"), o["x"]):
        if c is None or c not in table.columns:
            continue
        if ROW in df.columns and V.semantic(df.schema[c].dataType) == "categorical":
            code = f"_order_{c}"
            table = E.encode(table, c, E.first_seen(df, c, ROW, code), code)
            keys.append(F.col(code))
        else:
            keys.append(F.col(c).asc_nulls_last())
    rest = [F.col(c).asc_nulls_last() for c in table.columns if c not in (o.get("group"), o["x"]) and not c.startswith("_order_")]
    return table.orderBy(*keys, *rest).drop(*[c for c in table.columns if c.startswith("_order_")])


def figure(df: DataFrame, intent: dict | None = None, slots: dict[str, Callable[[DataFrame, dict], DataFrame]] | None = None, rows: int = ROWS) -> dict[str, Any]:
    """The document of a table: spec, per overlay its rows in drawing order, axis hints, scores and diagnostics.

    An overlay of more than ``rows`` rows has its first ones, and its id stands in ``truncated``.
    """
    c = columns_of(df)
    spec = P.validate_spec(P.compose(c, intent))
    df = E.guarded_moment(df, spec["overlays"][0]["x"], c.timely(spec["overlays"][0]["x"]) and c.kinds[spec["overlays"][0]["x"]] == "string")
    for name in ("data.prepare", "data.aggregate", "data.encode"):
        if slots and name in slots:
            df = df.transform(lambda d, f=slots[name]: f(d, spec))
    spec = P.repair(spec, df.columns, intent)
    data, truncated, ratios, shares = {}, [], {}, {}
    for o in spec["overlays"]:
        shares[o["id"]] = f = S.fractions(df, o["y"]).first()
        ratios[o["id"]] = P.is_ratio(c, o["y"], f["unit"], f["magnitude"], f["mean_magnitude"])
        got = in_order(mark_table(df, o, ratios[o["id"]]), df, o).limit(rows + 1).collect()
        if len(got) > rows:
            truncated.append(o["id"])
        data[o["id"]] = [r.asDict() for r in got[:rows]]
    main = spec["overlays"][0]
    q = S.high_quantile(df, main["y"]).first()
    gap = S.axis_break(q["n"], q["low"], q["top"], q["high"])
    if gap:
        spec["scales"]["y_left"]["breaks"] = [[gap.start, gap.end]]
    asked = spec["scales"]["y_left"].get("kind")
    spec["scales"]["y_left"]["kind"] = P.scale_kind(asked, shares[main["id"]]["positive"] or 0.0)
    limits = S.y_range(q["low"], q["top"], ratios[main["id"]]) if q["n"] else None
    return {
        "spec": spec, "data": data, "truncated": truncated, "ratios": ratios, "y_range": limits, "axis_break": gap, "scores": P.score(spec),
        "legend": P.legend(spec), "fonts": P.fonts(spec), "area_style": P.area_style(spec),
        "diagnostics": P.diagnostics(spec), "alt_text": P.alt_text(spec),
    }
