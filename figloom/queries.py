"""One query per operator over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .operators import encode as E
from .operators import extract as H
from .operators import harvest as R
from .operators import marks as M
from .operators import stats as S
from .operators import transforms as P
from .plans import rounds as L
from .session import shared_folder
from .sources import sinks as K
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: _r(c, digits) for c in columns})


# plans

FLAGSHIP = {
    "transforms": [
        {"op": "filter", "expr": {"column": "l_extendedprice", "op": ">", "value": 0}},
        {"op": "derive", "as": "month", "expr": "to_period(l_shipdate,'M')"},
        {"op": "aggregate", "group_by": ["l_returnflag", "month"], "measures": [{"col": "l_extendedprice", "agg": "sum", "as": "total"}]},
        {"op": "topk", "group_by": ["l_returnflag"], "order_by": {"col": "total", "desc": True}, "k": 5},
        {"op": "sort", "by": [{"col": "total", "desc": False}]},
    ]
}


@query("""
SELECT l_returnflag, month, round(total, 2) AS total FROM (
  SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, sum(l_extendedprice) AS total
  FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY total DESC) <= 5""")
def flagship_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.apply_plan(table(spark, sf_dir, "lineitem"), FLAGSHIP), "total", digits=2)


def _filter_query(name: str, tab: str, keep: list[str], column: str, op: str, value, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.apply_plan(table(spark, sf_dir, tab), [P.Filter(column, op, value)]).select(*keep)

    query(f"SELECT {', '.join(keep)} FROM {tab} WHERE {where}", name)(run)


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
for _n, _op, _sql in (("gt", ">", ">"), ("lt", "<", "<"), ("ge", ">=", ">="), ("le", "<=", "<="), ("eq", "==", "=")):
    _filter_query(f"filter_{_n}", "lineitem", _LINE, "l_quantity", _op, 25, f"l_quantity {_sql} 25")
_filter_query("filter_compare", "lineitem", _LINE, "l_extendedprice", ">", 50000.0, "l_extendedprice > 50000")
_filter_query("filter_ne_nullsafe", "lineitem", _LINE, "l_returnflag", "!=", "A", "l_returnflag IS DISTINCT FROM 'A'")
_filter_query("filter_in", "orders", ["o_orderkey", "o_orderpriority"], "o_orderpriority", "in", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter_query("filter_not_in", "orders", ["o_orderkey", "o_orderpriority"], "o_orderpriority", "not in", ["1-URGENT", "2-HIGH"], "coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), true)")
_filter_query("filter_between", "lineitem", _LINE, "l_quantity", "between", [10, 20], "l_quantity BETWEEN 10 AND 20")
_filter_query("filter_contains_regex", "part", ["p_partkey", "p_name"], "p_name", "contains", "r.d|ring$", "regexp_matches(p_name, 'r.d|ring$')")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = {"constraints": {"time_field": "o_orderdate", "time_range": ["1996-01-01", "1996-06-30"]}}
    return P.apply_plan(table(spark, sf_dir, "orders"), doc).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O')")
def filter_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint filters come after the transforms."""
    doc = {
        "transforms": [{"op": "filter", "expr": {"column": "o_totalprice", "op": ">=", "value": 100000}}],
        "constraints": {"filters": [{"column": "o_orderstatus", "op": "in", "value": ["F", "O"]}]},
    }
    return P.apply_plan(table(spark, sf_dir, "orders"), doc).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL")
def valid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return E.valid_rows(df, ["l_quantity", "l_extendedprice", "l_discount"]).select("l_orderkey", "l_linenumber")


_PERIODS = {
    "month": ("M", "strftime(o_orderdate, '%Y-%m')"),
    "quarter": ("Q", "year(o_orderdate) || 'Q' || quarter(o_orderdate)"),
    "week": ("W", "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d')"),
    "day": ("D", "strftime(o_orderdate, '%Y-%m-%d')"),
    "year": ("Y", "strftime(o_orderdate, '%Y')"),
}


def _period_query(name: str, freq: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = P.apply_plan(table(spark, sf_dir, "orders"), [P.Derive("period", "o_orderdate", freq)])
        return out.groupBy("period").agg(F.count(F.lit(1)).alias("n"))

    query(f"SELECT {sql} AS period, count(*) AS n FROM orders GROUP BY 1", f"derive_period_{name}")(run)


for _n, (_f, _sql) in _PERIODS.items():
    _period_query(_n, _f, _sql)


@query("SELECT o_orderkey, o_totalprice AS price, NULL::VARCHAR AS nothing FROM orders")
def derive_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [P.Derive("price", "o_totalprice"), P.Derive("nothing", "no_such_column")]
    return P.apply_plan(table(spark, sf_dir, "orders"), steps).select("o_orderkey", "price", "nothing")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", V.number(k).alias("k"), V.number("event_type").alias("bad"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y/%-m/%-d') AS VARCHAR) AS txt, o_orderdate AS ts FROM orders")
def coerce_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.date_format("o_orderdate", "yyyy/M/d")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("txt"), V.moment(t).alias("ts"))


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type")
def ordinal_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""WITH d AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT event_id, coalesce(code, -1) AS code FROM events LEFT JOIN d USING (event_type)""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    dim = E.first_seen(df.filter("event_type <> 'error'"), "event_type", "event_id")
    return E.encode(df, "event_type", dim).select("event_id", "code")


@query("WITH d AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS code, count(*) OVER () AS n FROM events GROUP BY 1) SELECT user_id, code FROM d WHERE n <= 50 OR code % CAST(ceil(n / 50) AS BIGINT) = 0")
def tick_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = E.first_seen(table(spark, sf_dir, "events"), "user_id", "event_id")
    return E.thin_ticks(dim, dim.count())


_AGGS = {
    "sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(v)", "size": "count(*)",
    "nunique": "count(DISTINCT v)", "median": "median(v)", "std": "stddev_samp(v)", "var": "var_samp(v)",
    "first": "arg_min(v, event_id)", "last": "arg_max(v, event_id)",
}


def _aggregate_query(agg: str, sql: str) -> None:
    whole = agg in ("count", "size", "nunique")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        step = P.Aggregate(("event_type",), (P.Measure("value", agg, "v"),))
        out = P.apply_plan(table(spark, sf_dir, "events"), [step], order="event_id")
        return out if whole else rounded(out, "v")

    body = sql if whole else f"round({sql}, 4)"
    query(f"SELECT event_type, {body} AS v FROM (SELECT event_type, event_id, value AS v FROM events) GROUP BY 1", f"aggregate_{agg}")(run)


for _a, _sql in _AGGS.items():
    _aggregate_query(_a, _sql)


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def mixed_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (P.Measure("l_quantity", "sum", "qty"), P.Measure("l_discount", "mean", "disc"), P.Measure("l_suppkey", "nunique", "suppliers"))
    out = P.apply_plan(table(spark, sf_dir, "lineitem"), [P.Aggregate(("l_returnflag",), ms)])
    return rounded(rounded(out, "qty", digits=2), "disc", digits=6)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return P.apply_plan(df, [P.TopK("p_retailprice", 5)], order="p_partkey")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return P.apply_plan(df, [P.TopK("o_totalprice", 3, ("o_orderpriority",))], order="o_orderkey")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey LIMIT 20")
def sort_multi_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return P.apply_plan(df, [P.Sort((("c_mktsegment", False), ("c_acctbal", True)))], order="c_custkey").limit(20)


# wide tables, grids, stacks

_FLAGS, _STATUS = ["A", "N", "R"], ["F", "O"]


@query("SELECT l_linenumber, " + ", ".join(f"round(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0), 2) AS {f}" for f in _FLAGS) + " FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pivot(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", _FLAGS), *_FLAGS, digits=2)


@query("SELECT l_linenumber, " + ", ".join(f"round(coalesce(avg(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0), 4) AS {f}" for f in _FLAGS) + " FROM lineitem GROUP BY 1")
def pivot_mean_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pivot(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", _FLAGS, "mean"), *_FLAGS)


_GRID = """r AS (SELECT DISTINCT {a} AS a FROM c), s AS (SELECT DISTINCT {b} AS b FROM c),
g AS (SELECT a, b, coalesce(v, 0.0) AS v FROM r CROSS JOIN s LEFT JOIN c ON c.{a} = a AND c.{b} = b)"""


def _cells(tab: str, a: str, b: str, value: str) -> str:
    return f"WITH c AS (SELECT {a}, {b}, {value} AS v FROM {tab} GROUP BY 1, 2), " + _GRID.format(a=a, b=b)


@query(_cells("lineitem", "l_returnflag", "l_linestatus", "avg(l_quantity)") + " SELECT a AS l_returnflag, b AS l_linestatus, round(v, 4) AS value FROM g")
def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.heatmap(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), "value")


@query(_cells("events", "user_id", "event_type", "sum(value)") + " SELECT a AS user_id, b AS event_type, round(v, 2) AS value FROM g")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.dense_grid(table(spark, sf_dir, "events"), "user_id", "event_type", "value"), "value", digits=2)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, event_type), 2) AS total FROM events")
def group_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.group_broadcast(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", name="total")
    return rounded(out.select("event_id", "total"), "total", digits=2)


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS mean FROM events")
def group_mean_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.group_broadcast(table(spark, sf_dir, "events"), ["event_type"], "value", ratio=True, name="mean")
    return rounded(out.select("event_id", "mean"), "mean")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


_STACK = " SELECT a AS l_returnflag, b AS l_linestatus, round(v, 2) AS height, round(coalesce(sum(v) OVER w, 0), 2) AS base FROM g WINDOW w AS (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(_cells("lineitem", "l_returnflag", "l_linestatus", "sum(l_quantity)") + _STACK)
def stack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_stacked(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity").drop("top"), "height", "base", digits=2)


@query(_cells("lineitem", "l_returnflag", "l_linestatus", "sum(l_quantity)") + """, n AS (SELECT a, b, v / CASE WHEN sum(v) OVER (PARTITION BY a) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY a) END AS v FROM g)
SELECT a AS l_returnflag, b AS l_linestatus, round(v, 6) AS height, round(coalesce(sum(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS base FROM n""")
def stack_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_percent(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity").drop("top"), "height", "base", digits=6)


@query("""WITH s AS (SELECT date_trunc('year', o_orderdate) AS y, sum(o_totalprice) AS d FROM orders GROUP BY 1)
SELECT y, round(d, 2) AS delta, round(coalesce(sum(d) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS base FROM s""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("y", F.date_trunc("year", "o_orderdate"))
    return rounded(M.waterfall(df, "y", "o_totalprice").drop("top"), "delta", "base", digits=2)


@query("WITH s AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 0) SELECT o_orderpriority, round(v, 2) AS value, round(v / sum(v) OVER (), 6) AS share FROM s")
def pie_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.pie(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(rounded(out, "value", digits=2), "share", digits=6)


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS height FROM orders GROUP BY 1")
def bar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), "height", digits=2)


@query(_cells("lineitem", "l_linenumber", "l_returnflag", "sum(l_extendedprice)") + " SELECT a AS l_linenumber, b AS l_returnflag, round(v, 2) AS height FROM g")
def bar_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_grouped(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_extendedprice"), "height", digits=2)


@query(_cells("orders", "o_orderpriority", "o_orderstatus", "sum(o_totalprice)") + " SELECT a AS o_orderpriority, b AS o_orderstatus, round(v, 2) AS height, round(v + coalesce(sum(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS top FROM g")
def bar_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_stacked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice").drop("base"), "height", "top", digits=2)


@query("SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(M.line(df, "day", "value", "event_type"), "value", digits=2)


@query("WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events), c AS (SELECT day, event_type, sum(value) AS v FROM e GROUP BY 1, 2), " + _GRID.format(a="day", b="event_type") + " SELECT a AS day, b AS event_type, round(v, 2) AS height, round(coalesce(sum(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS base FROM g")
def area_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(M.area_stacked(df, "day", "event_type", "value").drop("top"), "height", "base", digits=2)


@query("SELECT p_size, p_retailprice, p_brand FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.points(table(spark, sf_dir, "part"), ["p_size", "p_retailprice", "p_brand"], "p_size", "p_retailprice")


@query("SELECT l_linenumber, round(avg(l_extendedprice), 4) AS value, round(avg(l_discount), 6) AS low, round(avg(l_tax), 6) AS high FROM lineitem GROUP BY 1")
def line_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.band(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return rounded(rounded(out, "value"), "low", "high", digits=6)


@query("SELECT p_partkey, p_retailprice AS value, round(p_retailprice - p_size, 4) AS low, round(p_retailprice + p_size, 4) AS high FROM part")
def error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.error_bars(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", "p_size"), "low", "high")


# distributions

@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), c AS (
  SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS "left", round(lo + b.bin * ((hi - lo) / 20) + (hi - lo) / 20, 6) AS "right", coalesce(n, 0) AS n
FROM (SELECT unnest(range(20)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 20), "left", "right", digits=6)


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
SELECT l_returnflag, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, round(min(v) FILTER (WHERE inside), 4) AS low, round(max(v) FILTER (WHERE inside), 4) AS high, count(*) FILTER (WHERE NOT inside) AS n_out FROM j GROUP BY l_returnflag, q1, med, q3""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.box(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"), "q1", "med", "q3", "low", "high")


@query("""WITH s AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS total, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s.l_returnflag, CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 19, 6) AS "at",
       round(sum(n * exp(-0.5 * pow((lo + i * (hi - lo) / 19 - v) / h, 2)) / 2.5066282746310002) / (any_value(total) * any_value(h)), 6) AS density
FROM s CROSS JOIN (SELECT unnest(range(20)) AS i) JOIN c ON c.l_returnflag = s.l_returnflag GROUP BY s.l_returnflag, i, lo, hi""")
def violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.violin(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", 20), "at", "density", digits=6)


@query("""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem),
r AS (SELECT (l_quantity - x0) / ((x1 - x0) / 20) AS a, (l_discount - y0) / ((y1 - y0) / 11) AS b FROM lineitem, e),
d AS (SELECT a, b, floor(a + 0.5) AS i1, floor(b + 0.5) AS j1, floor(a) AS i2, floor(b) AS j2 FROM r),
f AS (SELECT *, (a - i1 - 0.0) * (a - i1 - 0.0) + 3 * ((b - j1 - 0.0) * (b - j1 - 0.0)) < (a - i2 - 0.5) * (a - i2 - 0.5) + 3 * ((b - j2 - 0.5) * (b - j2 - 0.5)) AS "even" FROM d)
SELECT CAST(CASE WHEN "even" THEN i1 ELSE i2 END AS BIGINT) AS i, CAST(CASE WHEN "even" THEN j1 ELSE j2 END AS BIGINT) AS j, "even", count(*) AS n FROM f GROUP BY 1, 2, 3""")
def hexbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hexbin(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")


# scalars

_HIGH = """h AS (SELECT count(*) AS n, min(v) AS low, max(v) AS top, quantile_cont(v, 0.9) AS q9, quantile_cont(v, 0.75) AS q7 FROM s),
k AS (SELECT n, low, top, CASE WHEN q >= top THEN (SELECT max(v) FROM s WHERE v < top) ELSE q END AS high
  FROM (SELECT *, CASE WHEN n >= 6 THEN q9 ELSE q7 END AS q FROM h))"""


@query("WITH s AS (SELECT l_extendedprice AS v FROM lineitem), " + _HIGH + " SELECT n, round(low, 4) AS low, round(top, 4) AS top, round(high, 4) AS high FROM k")
def quantile_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.high_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "low", "top", "high")


@query("WITH s AS (SELECT value AS v FROM events), " + _HIGH + """, b AS (SELECT *, top - 0.35 * (top - high) AS gap_end, CASE WHEN high - low > 0 THEN high - low ELSE greatest(1, 0.1 * abs(low)) END AS spread FROM k)
SELECT round(high, 4) AS gap_start, round(gap_end, 4) AS gap_end, round(0.12 * (gap_end - high), 4) AS width FROM b WHERE top - high > greatest(1, spread / 4)""")
def axis_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.high_quantile(table(spark, sf_dir, "events"), "value").first()
    gap = S.axis_break(r["n"], r["low"], r["top"], r["high"])
    rows = [(round(gap.start, 4), round(gap.end, 4), round(gap.width, 4))] if gap else []
    return spark.createDataFrame(rows, "gap_start double, gap_end double, width double")


@query("SELECT greatest(0, min(l_discount) - greatest(0.2 * (max(l_discount) - min(l_discount)), CASE WHEN max(l_discount) <= 0.5 THEN 0.02 ELSE 0.05 END)) AS bottom, round(least(1.2, max(l_discount) + greatest(0.2 * (max(l_discount) - min(l_discount)), CASE WHEN max(l_discount) <= 0.5 THEN 0.02 ELSE 0.05 END)), 6) AS top FROM lineitem")
def y_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, top = M.bounds(table(spark, sf_dir, "lineitem"), "l_discount")
    low, top = S.y_range(low, top, True)
    return spark.createDataFrame([(round(low, 6), round(top, 6))], "bottom double, top double")


@query("SELECT max(l_quantity) AS second FROM lineitem WHERE l_quantity < (SELECT max(l_quantity) FROM lineitem)")
def second_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.second_largest(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT round(avg(CAST(l_discount BETWEEN 0 AND 1 AS INTEGER)), 6) AS unit, round(avg(CAST(l_discount BETWEEN 0 AND 100 AS INTEGER)), 6) AS hundred, round(avg(CAST(l_discount > 0 AS INTEGER)), 6) AS positive, max(abs(l_discount)) AS magnitude, round(avg(abs(l_discount)), 6) AS mean_magnitude FROM lineitem")
def fraction_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.fractions(table(spark, sf_dir, "lineitem"), "l_discount"), "unit", "hundred", "positive", "mean_magnitude", digits=6)


@query("WITH p AS (SELECT l_discount AS v FROM lineitem UNION ALL SELECT l_tax FROM lineitem) SELECT count(*) AS n, min(v) AS low, max(v) AS top, round(quantile_cont(v, 0.9), 6) AS q9 FROM p")
def pooled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.pooled(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])
    return v.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("top"), _r(F.percentile("value", 0.9), 6).alias("q9"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def peak_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peak(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT round(avg(s), 4) AS mean FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority)")
def reference_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.reference_mean(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), "mean")


_STAT_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in _STAT_COLS))
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.profile_stats(table(spark, sf_dir, "lineitem"), _STAT_COLS), "mean", "std")


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_nulls, count(DISTINCT {c}) AS distinct FROM customer" for c in _CUST))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile_counts(table(spark, sf_dir, "customer").select(*_CUST))


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, c_custkey AS o FROM customer" for c in ("c_nationkey", "c_mktsegment")) + "), c AS (SELECT name, value, count(*) AS n, min(o) AS o FROM l GROUP BY 1, 2) SELECT name, value, n, CAST(row_number() OVER w AS INTEGER) AS rank FROM c WINDOW w AS (PARTITION BY name ORDER BY n DESC, o) QUALIFY row_number() OVER w <= 5")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_values(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 5, "c_custkey")


@query("SELECT c_name FROM customer WHERE c_name IS NOT NULL ORDER BY c_custkey LIMIT 5")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_values(table(spark, sf_dir, "customer"), "c_name", "c_custkey")


@query("SELECT * FROM region ORDER BY r_regionkey LIMIT 8")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.preview(table(spark, sf_dir, "region"), "r_regionkey")


# records

@query("SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic = 1, false) AS flagged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", "lang", "quality", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ledger_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unprocessed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


_URL_KEY = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, url FROM (SELECT page_id, url, {_URL_KEY} AS k FROM pages) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id % 2, page_id) = 1")
def keyed_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return R.merge_first(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1"), X.url_key(F.col("url")), "page_id")


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.insert_absent(old, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 50")
def year_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return R.schedule(df, "year_desc", 50, "o_orderkey")


_OUTCOME = "CASE WHEN n > 8 THEN 'ok' WHEN n = 8 THEN 'no-figures' WHEN n = 0 THEN 'fetch-error' ELSE 'no-source-data' END"
_LINKS = r"""len(list_distinct(regexp_extract_all(html, '<a[^>]*\shref="([^"#][^"]*)"', 1)))"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(H.hrefs(F.col("html")))
    found = F.when(n > 8, n).when(n == 8, 0).when(n > 0, -1)
    return table(spark, sf_dir, "pages").select("page_id", R.outcome(found).alias("outcome"))


@query(f"SELECT page_id, {_OUTCOME} AS outcome FROM (SELECT page_id, {_LINKS} AS n FROM pages)")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(f"SELECT o.outcome, count(p.outcome) AS n FROM (VALUES ('ok'), ('no-source-data'), ('no-figures'), ('fetch-error')) o(outcome) LEFT JOIN (SELECT {_OUTCOME} AS outcome FROM (SELECT {_LINKS} AS n FROM pages)) p ON p.outcome = o.outcome GROUP BY 1")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tally(_outcomes(spark, sf_dir), "outcome", R.OUTCOMES)


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a[^>]*\shref="([^"#][^"]*)"', 1)) AS href FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), '') AS title FROM pages")
def html_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_URL_KEY} AS key FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_key(F.col("url")).alias("key"))


@query()
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, best image, caption and labelled links by one parse per page; the fixtures in the tests hold the cases."""
    return H.extract_pages(table(spark, sf_dir, "pages"), label="a")


# text

@query("SELECT p_partkey, substr(regexp_replace(trim(p_name || '/' || p_brand), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 180) AS name FROM part")
def name_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(name).alias("name"))


@query("SELECT o_orderkey, CASE WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', v / 1e3) WHEN v = floor(v) THEN printf('%d', CAST(v AS BIGINT)) ELSE printf('%.2f', v) END AS label FROM (SELECT o_orderkey, floor(o_totalprice) + 0.26 AS v FROM orders)")
def si_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.si(F.floor("o_totalprice") + F.lit(0.26)).alias("label"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS label FROM lineitem")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.percent(F.col("l_discount")).alias("label"))


@query("SELECT c_custkey, c_name[1:16] || CASE WHEN length(c_name) > 16 THEN chr(10) || c_name[17:32] ELSE '' END AS label FROM customer")
def label_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.wrap(F.col("c_name")).alias("label"))


@query("SELECT p_partkey, CASE WHEN length(n) > 12 THEN n[1:8] || '...' || n[-4:] ELSE n END AS label FROM (SELECT p_partkey, p_name || ' ' || p_type AS n FROM part)")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.shorten(F.concat_ws(" ", "p_name", "p_type"), 12, 4).alias("label"))


@query("SELECT p_partkey, round(p, 6) AS position, round(CASE WHEN p >= 1112 THEN p + 88 WHEN p > 1100 THEN 1100 + (p - 1100) / 0.12 ELSE p END, 4) AS restored FROM (SELECT p_partkey, CASE WHEN v >= 1200 THEN v - 88 WHEN v > 1100 THEN 1100 + (v - 1100) * 0.12 ELSE v END AS p FROM (SELECT p_partkey, p_retailprice AS v FROM part))")
def axis_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").select("p_partkey", X.compress_axis(F.col("p_retailprice"), 1100.0, 1200.0, 12.0).alias("p"))
    return out.select("p_partkey", _r("p", 6).alias("position"), _r(X.restore_axis(F.col("p"), 1100.0, 1200.0, 12.0)).alias("restored"))


@query("SELECT p_partkey, (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red')) AS hit FROM part")
def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.has_token(F.col("p_name"), ("ring", "red")).alias("hit"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AND regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\\.(png|jpg|jpeg|gif|webp)$') AS image FROM pages")
def likely_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.likely_image(F.col("url")).alias("image"))


@query("SELECT r_name || ' ' || n_name AS term FROM region CROSS JOIN nation ORDER BY r_regionkey, n_nationkey LIMIT 100")
def keyword_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    none = r.select(F.col("r_name").alias("term"), F.col("r_regionkey").alias("pos")).limit(0)
    return R.keyword_product(none, r.select("r_name", "r_regionkey"), n.select("n_name", "n_nationkey"), 100)


@query(r"""SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE regexp_replace(p_name, '(\.[^./\\]*)$', '') || '_' || k || regexp_extract(p_name, '(\.[^./\\]*)$', 1) END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_names(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""WITH f AS (SELECT user_id, event_id, event_type <> 'error' AS found FROM events), i AS (SELECT *, sum(CAST(found AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f),
s AS (SELECT *, sum(CAST(NOT found AS INTEGER)) OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM i),
x AS (SELECT *, max(CAST(k >= 2 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM s)
SELECT user_id, event_id, found FROM x WHERE coalesce(stopped, 0) = 0""")
def consecutive_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("found"))
    return R.stop_after_empty(f, "user_id", "event_id", "found")


@query("SELECT p_name FROM part WHERE p_size <= 10 INTERSECT SELECT p_name FROM part WHERE p_size > 40")
def label_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return L.labels_on_both(p.filter("p_size <= 10"), p.filter("p_size > 40"), "p_name")


@query("SELECT t.etype, count(e.event_id) AS n FROM (VALUES ('constraint'), ('style'), ('geom'), ('layout'), ('ref')) t(etype) LEFT JOIN events e ON t.etype = CASE e.event_type WHEN 'error' THEN 'constraint' WHEN 'view' THEN 'style' WHEN 'click' THEN 'geom' END GROUP BY 1")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("event_type") == "error", "constraint").when(F.col("event_type") == "view", "style").when(F.col("event_type") == "click", "geom")
    return L.evidence_counts(table(spark, sf_dir, "events").select(e.alias("etype")))


# fixtures and sources

ITEMS = [
    ("10.1/a", ["A title"], ["Journal A"], {"date-parts": [[2023, 5]]}, "https://x.example/a", None,
     [{"given": "Ann", "family": "Lee", "name": None}, {"given": None, "family": None, "name": "The Group"}]),
    ("10.1/B", [], ["journal b"], None, None, "text", None),
]


@query("""SELECT * FROM (VALUES ('10.1/a', 'A title', 'Journal A', 2023, 'https://x.example/a', 'P1', 'https://pmc.example/P1', '7', true, 'full', 'Lee, Ann; The Group'),
('10.1/B', '', 'journal b', CAST(NULL AS INTEGER), NULL, NULL, NULL, NULL, false, 'text', '')) t(doi, title, journal, year, url, pmcid, pmc_url, pmid, is_open_access, abstract, authors)""")
def record_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame(ITEMS, R.ITEM)
    extra = spark.createDataFrame([("10.1/A", "P1", "7", "full", "Y", None)], R.ENRICHMENT)
    return R.enrich(R.project(items), extra, "https://pmc.example/")


@query("SELECT * FROM (VALUES ('10.1/a', 'Lee, Ann; The Group'), ('10.1/B', '')) t(doi, authors)")
def author_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(ITEMS, R.ITEM).select(F.col("DOI").alias("doi"), X.authors(F.col("author")).alias("authors"))


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'column'), (2, 'a_2'), (3, 'column_2')) t(pos, name)")
def column_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(T.unique_columns(["a", "", "a", ""]))), "pos int, name string")


SHEET = [("Report", None, None), ("day", "city", "sold"), ("2024-01-01", "x", "1"), ("2024-01-02", "y", "2.5"), (None, None, None), ("2024-01-03", "x", "-3")]


@query("SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 'x', 1.0::DOUBLE), (TIMESTAMP '2024-01-02', 'y', 2.5), (TIMESTAMP '2024-01-03', 'x', -3.0)) t(day, city, sold)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(SHEET)], f"{T.ROW} long, c0 string, c1 string, c2 string")
    return T.tidy_sheet(raw).drop(T.ROW)


@query("SELECT CAST(1 AS BIGINT) AS header_row")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(SHEET)], f"{T.ROW} long, c0 string, c1 string, c2 string")
    return spark.createDataFrame([(T.header_row(raw),)], "header_row long")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedupe_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as a file stream; first rows per key are appended by a checkpointed query."""
    from .streaming import ingest as I

    base = _folder(spark, "stream")
    src = table(spark, sf_dir, "events").select("event_type", "user_id")
    src.repartition(4).write.parquet(f"{base}/in")
    stream = I.file_stream(spark, f"{base}/in", "event_type string, user_id long", 1, "parquet")
    out = I.first_per_key(stream, F.concat_ws("|", "event_type", "user_id"))
    I.append(out, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("event_type string, user_id long").parquet(f"{base}/out")


# drawing order, guarded times, jitter, products

def _placed(df: DataFrame, key: str) -> DataFrame:
    """The sorted rows' places, from the order in which one writer sees them."""
    return df.select(key, (F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS TIMESTAMP) AS p_size FROM part)")
def drawing_order_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("timestamp").alias("at"))
    return _placed(E.drawing_order(df, "at", "p_partkey"), "p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY b, p_partkey) AS place FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS b FROM part)")
def drawing_order_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(E.drawing_order(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey"), "p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY t, b, p_partkey) AS place FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type) AS t, min(p_partkey) OVER (PARTITION BY p_brand) AS b FROM part)")
def drawing_order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return _placed(E.drawing_order(df, "p_brand", "p_partkey", "p_type"), "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS day, o_orderpriority FROM orders")
def guarded_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of one text column parse, none of the other."""
    day = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), "o_orderpriority")
    return E.guarded_moment(E.guarded_moment(df, "day"), "o_orderpriority")


@query("SELECT p_partkey, true AS near, CAST(p_size AS BIGINT) AS code FROM part")
def jitter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("code"))
    df = df.withColumn("x", E.jitter(F.col("code"), 50, 7))
    return df.select("p_partkey", ((F.abs(F.col("x") - F.col("code")) <= 0.02) & (F.round("x") == F.col("code"))).alias("near"), "code")


@query("SELECT l_returnflag, round(product(1 + l_discount / 1000), 6) AS total FROM lineitem GROUP BY 1")
def aggregate_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("v", 1 + F.col("l_discount") / 1000)
    plan = {"transforms": [{"op": "aggregate", "group_by": ["l_returnflag"], "measures": [{"col": "v", "agg": "prod", "as": "total"}]}]}
    return rounded(P.apply_plan(df, plan), "total", digits=6)


# files written and read back

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size FROM part")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    K.write_jsonl(part.filter("p_partkey % 2 = 0"), path)
    K.write_jsonl(part.filter("p_partkey % 2 = 1"), path, append=True)
    return T.read_jsonl(spark, path, part.schema.simpleString()[7:-1].replace(":", " ")).drop(T.ROW)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, '' AS nothing FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    K.write_csv(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "nothing"])
    return T.read_csv(spark, path, "p_partkey string, p_name string, nothing string").drop(T.ROW).na.fill("")


@query("SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> ''")
def line_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lines")
    part = table(spark, sf_dir, "part")
    part.select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value")).unionAll(part.select(F.lit(" "))).write.text(path)
    return T.read_lines(spark, path)


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0")
def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a ledger of two appends, with and without a reason, are skipped."""
    from .streaming import ingest as I

    path, part = _folder(spark, "ledger"), table(spark, sf_dir, "part").select("p_partkey")
    K.append_ledger(part.filter("p_partkey % 8 = 0"), path, "p_partkey")
    K.append_ledger(part.filter("p_partkey % 8 = 4").withColumn("why", F.lit("no-figures")), path, "p_partkey", "why")
    known = I.ledger_keys(spark, path).select(F.col("_key").cast("long").alias("p_partkey"))
    return R.unprocessed(part, known, "p_partkey")


@query("SELECT p_partkey, lower(trim(p_brand)) = 'brand#13' OR starts_with(lower(trim(p_brand)), 'brand#2') AS inside FROM part")
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = R.in_family(F.array(F.concat(F.lit(" "), "p_brand")), ["Brand#13"], ["brand#2"])
    return table(spark, sf_dir, "part").select("p_partkey", inside.alias("inside"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(i % 7 AS BIGINT) AS page FROM range(40) t(i)")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a cursor-paged source up to the one without a next cursor; the first try of each page fails."""
    spark.dataSource.register(T.cursor_source(T.retrying(_flaky_pages(), sleep=0.0), "id long, page long", 7, 1_000, "demo_cursor"))
    return spark.read.format("demo_cursor").option("query", "q").load()


def _flaky_pages():
    failed = set()

    def fetch(query: str, cursor: str | None, rows: int):
        at = int(cursor or 0)
        if at not in failed:
            failed.add(at)
            raise OSError("busy")
        got = [(i, i % 7) for i in range(at, min(at + rows, 40))]
        return got, str(at + rows) if at + rows < 40 else None

    return fetch
