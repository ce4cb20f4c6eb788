"""A declarative transform plan folded on a DataFrame.

Plans come as JSON documents or as the dataclasses below.  Folding only builds
a logical plan: column pruning, filter push-down and partial aggregation are
left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == F.lit(v),
    "!=": V.differs,
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "not in": V.outside,
    "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "contains": V.matches,
}
LIST_OPS = {"in": 0, "not in": 0, "between": 2}


def _valued(col: str, order: str | None, pick: Callable) -> Column:
    if order is None:
        raise ValueError("first and last need an order column")
    return pick(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


#: Aggregates by name, from the column's name and the order column's.
AGGREGATES: dict[str, Callable[[str, str | None], Column]] = {
    "sum": lambda c, o: V.sum0(c),
    "mean": lambda c, o: F.avg(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "size": lambda c, o: F.count(F.lit(1)),
    "nunique": lambda c, o: F.count_distinct(F.col(c)),
    "median": lambda c, o: F.median(c),
    "std": lambda c, o: F.stddev_samp(c),
    "var": lambda c, o: F.var_samp(c),
    "prod": lambda c, o: F.coalesce(F.product(F.col(c)), F.lit(1.0)),
    "first": lambda c, o: _valued(c, o, F.min_by),
    "last": lambda c, o: _valued(c, o, F.max_by),
}
AGGREGATES["avg"] = AGGREGATES["mean"]


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Derive:
    name: str
    source: str
    freq: str | None = None  # a period; None: a copy


@dataclass(frozen=True)
class Measure:
    column: str
    agg: str = "sum"
    name: str | None = None


@dataclass(frozen=True)
class Aggregate:
    by: tuple[str, ...]
    measures: tuple[Measure, ...]


@dataclass(frozen=True)
class TopK:
    column: str
    k: int = 5
    by: tuple[str, ...] = ()
    descending: bool = True


@dataclass(frozen=True)
class Sort:
    keys: tuple[tuple[str, bool], ...]  # column, descending


Step = Filter | Derive | Aggregate | TopK | Sort


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    filters: tuple[Filter, ...] = ()
    time_field: str | None = None
    time_range: tuple[Any, Any] | None = None


def parse_filter(doc: dict) -> Filter:
    return Filter(doc["column"], str(doc.get("op", "")).lower(), doc.get("value"))


def parse_step(doc: dict, first_measure_only: bool = False, compat_sort: bool = False) -> Step:
    """One JSON step.  ``compat_sort`` ignores ``asc`` in a sort, ``first_measure_only`` further measures."""
    op = str(doc.get("op", "")).lower()
    if op == "filter":
        return parse_filter(doc["expr"])
    if op == "derive":
        expr = str(doc["expr"]).strip()
        if expr.startswith("to_period(") and expr.endswith(")"):
            args = [a.strip().strip("'\"") for a in expr[len("to_period(") : -1].split(",")]
            return Derive(doc["as"], args[0], args[1] if len(args) > 1 and args[1] else "M")
        return Derive(doc["as"], expr)
    if op == "aggregate":
        found = [Measure(m["col"], m.get("agg") or "sum", m.get("as")) for m in doc.get("measures") or []]
        return Aggregate(tuple(doc.get("group_by") or ()), tuple(found[:1] if first_measure_only else found))
    if op == "topk":
        order = doc.get("order_by") or {}
        down = bool(order.get("desc", True)) if order else True
        return TopK(order.get("col") or doc["by"], max(1, int(doc.get("k") or 5)), tuple(doc.get("group_by") or ()), down)
    if op == "sort":
        down = lambda b: bool(b["desc"]) if "desc" in b else not compat_sort and b.get("asc") is False
        return Sort(tuple((b["col"], down(b)) for b in doc.get("by") or ()))
    raise PlanError(f"unknown step {op!r}")


def parse(doc: dict, **options) -> Plan:
    """A plan document: ``transforms`` and, applied after them, ``constraints``."""
    limits = doc.get("constraints") or {}
    span = limits.get("time_range") or ()
    field_ = limits.get("time_field")
    timed = len(span) == 2 and field_
    return Plan(
        tuple(parse_step(s, **options) for s in doc.get("transforms") or ()),
        tuple(parse_filter(f) for f in limits.get("filters") or ()),
        field_ if timed else None,
        tuple(span) if timed else None,
    )


def predicate(f: Filter, lenient: bool = False) -> Column | None:
    """The filter's condition; unknown operators and unfit values raise, or give None if lenient."""
    bad = f.op not in COMPARE or (f.op in LIST_OPS and not (isinstance(f.value, (list, tuple)) and len(f.value) >= LIST_OPS[f.op]))
    if bad:
        if lenient:
            return None
        raise PlanError(f"cannot filter {f.column!r} by {f.op!r} {f.value!r}")
    return COMPARE[f.op](F.col(f.column), f.value)


def ordering(column: str, descending: bool) -> Column:
    """Nulls last in both directions."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


@dataclass
class Folder:
    """``order``: a column that gives the rows' own order; it breaks ties and serves first and last."""

    order: str | None = None
    lenient: bool = False
    seen: list[str] = field(default_factory=list)

    def _ties(self, df: DataFrame) -> list[Column]:
        return [F.col(self.order)] if self.order in df.columns else []

    def _need(self, df: DataFrame, *names: str) -> None:
        for n in names:
            if n not in df.columns:
                raise PlanError(f"no column {n!r}; there are {df.columns}")

    def step(self, df: DataFrame, s: Step) -> DataFrame:
        if isinstance(s, Filter):
            self._need(df, s.column)
            p = predicate(s, self.lenient)
            return df if p is None else df.filter(p)
        if isinstance(s, Derive):
            if s.freq is None:
                return df.withColumn(s.name, F.col(s.source) if s.source in df.columns else F.lit(None).cast("string"))
            self._need(df, s.source)
            kind = dict(df.dtypes)[s.source]
            c = F.col(s.source) if kind.startswith(("timestamp", "date")) else V.moment(s.source)
            return df.withColumn(s.name, V.period(c, s.freq))
        if isinstance(s, Aggregate):
            self._need(df, *s.by, *[m.column for m in s.measures])
            if not s.measures:
                return df
            order = self.order if self.order in df.columns else None
            try:
                aggs = [AGGREGATES[m.agg](m.column, order).alias(m.name or m.column) for m in s.measures]
            except KeyError as e:
                raise PlanError(f"unknown aggregate {e}") from None
            return df.groupBy(*s.by).agg(*aggs)
        if isinstance(s, TopK):
            self._need(df, s.column, *s.by)
            keys = [ordering(s.column, s.descending), *self._ties(df)]
            if not s.by:
                return df.orderBy(*keys).limit(s.k)
            rank = F.row_number().over(Window.partitionBy(*s.by).orderBy(*keys))
            return df.withColumn("_rank", rank).filter(F.col("_rank") <= s.k).drop("_rank")
        self._need(df, *[c for c, _ in s.keys])
        return df.orderBy(*[ordering(c, d) for c, d in s.keys], *self._ties(df)) if s.keys else df


def apply_plan(df: DataFrame, plan: Plan | dict | Sequence[Step], order: str | None = None, lenient: bool = False) -> DataFrame:
    """Fold a plan: its steps in order, then its filters and its time range."""
    plan = parse(plan) if isinstance(plan, dict) else plan if isinstance(plan, Plan) else Plan(tuple(plan))
    folder = Folder(order, lenient)
    for s in (*plan.steps, *plan.filters):
        df = folder.step(df, s)
    if plan.time_field and plan.time_range:
        folder._need(df, plan.time_field)
        low, high = (V.moment(F.lit(str(v))) for v in plan.time_range)
        kind = dict(df.dtypes)[plan.time_field]
        c = F.col(plan.time_field) if kind.startswith(("timestamp", "date")) else V.moment(plan.time_field)
        df = df.filter(c.between(low, high))
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise if there are no rows (an action)."""
    if df.isEmpty():
        raise PlanError(f"{what} is empty")
    return df
