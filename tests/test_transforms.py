import pandas as pd
import pytest
from pyspark.sql import functions as F

from figloom.functions import text as X
from figloom.functions import values as V
from figloom.operators import encode as E
from figloom.operators import marks as M
from figloom.operators import stats as S
from figloom.operators import transforms as P

SALES = [(0, "2024-01-01", "E", 100), (1, "2024-01-02", "W", 120), (2, "2024-01-03", "S", 115), (3, "2024-01-04", "N", 98), (4, "2024-01-05", "E", 140)]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "_row_idx long, day string, region string, sales int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_recorded_plan(sales):
    doc = {
        "transforms": [
            {"op": "filter", "expr": {"column": "sales", "op": ">", "value": 0}},
            {"op": "derive", "as": "month", "expr": "to_period(day,'M')"},
            {"op": "aggregate", "group_by": ["region"], "measures": [{"col": "sales", "agg": "sum", "as": "total"}]},
            {"op": "topk", "order_by": {"col": "total", "desc": True}, "k": 2},
            {"op": "sort", "by": [{"col": "total", "asc": False}]},
        ]
    }
    assert rows(P.apply_plan(sales, doc)) == [("E", 240), ("W", 120)]
    assert P.parse(doc, compat_sort=True).steps[-1] == P.Sort((("total", False),))


def test_strict_and_lenient(sales):
    with pytest.raises(P.PlanError):
        P.apply_plan(sales, [P.Filter("sales", "like", 1)])
    with pytest.raises(P.PlanError):
        P.apply_plan(sales, [P.Filter("nothing", ">", 1)])
    assert P.apply_plan(sales, [P.Filter("sales", "in", 3)], lenient=True).count() == 5
    with pytest.raises(P.PlanError):
        P.require_rows(sales.limit(0))


def test_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (3, None, 4.0)], "i int, k string, v double")
    assert {r[0] for r in rows(P.apply_plan(df, [P.Filter("k", "!=", "a")]))} == {2, 3}
    assert {r[0] for r in rows(P.apply_plan(df, [P.Filter("k", "not in", ["a"])]))} == {2, 3}
    out = P.apply_plan(df, [P.Aggregate(("k",), (P.Measure("v", "sum", "s"), P.Measure("v", "first", "f")))], order="i")
    assert sorted(rows(out), key=str) == sorted([("a", 0.0, None), (None, 7.0, 3.0)], key=str)
    first = P.apply_plan(df, [P.Sort((("k", True),))], order="i")
    assert [r[0] for r in rows(first)] == [1, 2, 3]


@pytest.mark.parametrize("text", [" 12 ", "1e3", "inf", "1,234", "12%", "0x10", "", "True", "nan", "-7.5"])
def test_numbers_as_in_pandas(spark, text):
    want = pd.to_numeric(pd.Series([text]), errors="coerce")[0]
    got = spark.createDataFrame([(text,)], "t string").select(V.number("t")).first()[0]
    assert (got is None and pd.isna(want)) or got == want


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_periods_as_in_pandas(spark, freq):
    days = ["2024-02-15", "2023-12-31", "2024-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert [r[0] for r in df.select(V.period(V.moment("d"), freq)).collect()] == list(pd.to_datetime(pd.Series(days)).dt.to_period(freq).astype(str))


def test_formats(spark):
    df = spark.createDataFrame([(999.0,), (1500.0,), (2.5e6,), (0.125,), (None,)], "v double")
    assert [r[0] for r in df.select(X.si(F.col("v"))).collect()][:3] == ["999", "1.5K", "2.5M"]
    a, b, w = 1672.0, 3965.2, 275.184
    xs = [120.0, 1672.0, 2000.0, 3965.2, 5200.0]
    back = spark.createDataFrame([(x,) for x in xs], "v double").select(
        X.restore_axis(X.compress_axis(F.col("v"), a, b, w), a, b, w)
    )
    assert [r[0] for r in back.collect()] == pytest.approx(xs)


def test_axis_break(spark):
    df = spark.createDataFrame([(v,) for v in (120, 130, 140, 150, 160, 125, 135, 5200)], "value int")
    r = S.high_quantile(df, "value").first()
    gap = S.axis_break(r["n"], r["low"], r["top"], r["high"])
    assert (gap.start, gap.end) == pytest.approx((1672.0, 3965.2))
    assert (gap.width, gap.shift, gap.display_top, gap.visual_top) == pytest.approx((275.184, 2018.016, 1947.184, 3243.724))
    assert S.axis_break(3, 1.0, 2.0, 1.9) is None


def test_stack_and_shares(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0), ("b", "x", 2.0), (None, "x", 9.0)], "k string, g string, v double")
    stacked = {(r["k"], r["g"]): (r["base"], r["top"]) for r in M.bar_stacked(df, "k", "g", "v").collect()}
    assert stacked == {("a", "x"): (0, 1), ("a", "y"): (1, 4), ("b", "x"): (0, 2), ("b", "y"): (2, 2)}
    tops = M.bar_percent(df, "k", "g", "v").groupBy("k").agg(F.max("top"))
    assert all(r[1] == pytest.approx(1) for r in tops.collect())
    assert sum(r["share"] for r in M.pie(df, "k", "v").collect()) == pytest.approx(1)


def test_histogram_counts_all(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, None)], "v int")
    out = M.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == [1, 1, 1, 2]
    assert M.histogram(df.limit(0), "v").count() == 0
    same = spark.createDataFrame([(5,)], "v int")
    assert sum(r["n"] for r in M.histogram(same, "v", 3).collect()) == 1


def test_first_seen_and_encode(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "i int, c string")
    dim = E.first_seen(df, "c", "i")
    assert {r[0]: r[1] for r in dim.collect()} == {"b": 0, "a": 1, None: 2}
    coded = E.encode(df, "c", dim.filter("c = 'b'"))
    assert [r["code"] for r in coded.orderBy("i").collect()] == [0, -1, 0, -1]


def test_profile_golden(spark):
    df = spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate([("e", 100), ("w", 120), ("s", 115), ("n", 98), ("e", 140), ("w", 130), ("s", 150)])], "_row_idx int, region string, sales int")
    by = {c["name"]: c for c in S.rich_profile(df, "_row_idx")}
    assert [(t["value"], t["count"]) for t in by["region"]["top_values"]] == [("e", 2), ("w", 2), ("s", 2), ("n", 1)]
    s = by["sales"]["stats"]
    assert (s["min"], s["max"], s["mean"], s["std"]) == pytest.approx((98, 150, 121.85714285714286, 18.06676958577006))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x string, g string, v double")
    for out in (M.bar(df, "x", "v"), M.bar_stacked(df, "x", "g", "v"), M.pie(df, "x", "v"), M.box(df, "v"), M.violin(df, "v"), M.hexbin(df, "v", "v")):
        assert out.count() == 0


def test_plans_push_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = P.apply_plan(df, [P.Filter("l_quantity", ">", 25), P.Aggregate(("l_returnflag",), (P.Measure("l_extendedprice"),))])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25" in plan and "l_comment" not in plan and "l_shipdate" not in plan
    top = P.apply_plan(df, [P.TopK("l_quantity", 3)])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
