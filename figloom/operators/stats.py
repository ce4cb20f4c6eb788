"""Profiles and scalar statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from .encode import bounded, same


def coarse_profile(df: DataFrame) -> dict:
    """Name to datetime, numeric or string, from the schema alone, and the row count."""
    kind = {"temporal": "datetime", "quantitative": "numeric", "categorical": "string"}
    return {"columns": {f.name: kind[V.semantic(f.dataType)] for f in df.schema}, "n": df.count()}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: name, non_nulls, distinct (by text).  One pass over the table."""
    if not exact:
        aggs = [a for i, c in enumerate(df.columns) for a in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))]
        rows = [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("non_nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(df.columns)]
        return df.agg(*aggs).select(F.inline(F.array(*rows)))
    # one row per column and value after partial aggregation; nulls count nothing
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    values = df.select(F.inline(cells)).groupBy("name", "value").agg(F.count("value").alias("n"))
    found = values.groupBy("name").agg(F.sum("n").alias("non_nulls"), F.count("value").alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return F.broadcast(names).join(found, "name", "left").select("name", zero("non_nulls"), zero("distinct"))


def profile_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: name, min, max, mean and population std (null if there are no values)."""
    names = list(columns or _numeric(df))
    fs = (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in names for n, f in fs])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{c}__{n}").alias(n) for n, _ in fs]) for c in names])
    return one.select(F.inline(rows))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, order: str | None = None) -> DataFrame:
    """Per column its k commonest values as text, nulls included; ties by first appearance (or by value)."""
    at = F.col(order) if order else F.lit(0)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(at.alias("_o"), F.explode(cells).alias("c")).select("_o", "c.name", "c.value")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_o"))
    w = Window.partitionBy("name").orderBy(F.col("n").desc(), "_o", F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_o")


def sample_values(df: DataFrame, column: str, order: str, k: int = 5) -> DataFrame:
    """The first k non-null values in row order."""
    return df.filter(F.col(column).isNotNull()).orderBy(order).select(column).limit(k)


def preview(df: DataFrame, order: str, k: int = 8) -> DataFrame:
    return df.orderBy(order).limit(k)


def rich_profile(df: DataFrame, order: str, k: int = 5) -> list[dict]:
    """Per column: dtype, semantic type, counts, samples, top values, stats; the result is small whatever the table."""
    names = [c for c in df.columns if c != order]
    data = df.select(order, *names)
    counts = {r["name"]: r for r in profile_counts(df.select(*names)).collect()}
    stats = {r["name"]: r for r in profile_stats(df.select(*names)).collect()} if _numeric(df.select(*names)) else {}
    top: dict[str, list] = {c: [] for c in names}
    for r in top_values(data, names, k, order).orderBy("name", "rank").collect():
        top[r["name"]].append({"value": r["value"], "count": r["n"]})
    out = []
    for f in df.schema:
        if f.name == order:
            continue
        s = stats.get(f.name)
        out.append(
            {
                "name": f.name,
                "dtype": f.dataType.simpleString(),
                "semantic_type": V.semantic(f.dataType),
                "non_nulls": counts[f.name]["non_nulls"],
                "distinct": counts[f.name]["distinct"],
                "sample_values": [r[0] for r in sample_values(df, f.name, order, k).collect()],
                "top_values": top[f.name],
                "stats": {n: s[n] for n in ("min", "max", "mean", "std")} if s else None,
            }
        )
    return out


def pooled(df: DataFrame, columns: Sequence[str], name: str = "value") -> DataFrame:
    """All values of the columns in one."""
    return df.select(F.explode(F.array(*[V.number(c) for c in columns])).alias(name)).filter(F.col(name).isNotNull())


def second_largest(df: DataFrame, y: str, name: str = "second") -> DataFrame:
    """One row: the second largest distinct value, or null."""
    top = df.select(V.number(y).alias("v")).filter("v is not null").distinct().orderBy(F.col("v").desc()).limit(2)
    return top.agg(F.when(F.count(F.lit(1)) == 2, F.min("v")).alias(name))


#: Groups of so many values are ranked whole; in larger ones, values this far (as a share) from the wanted rank are only counted.
RANKED, MARGIN, ACCURACY = 10_000, 0.001, 10_000


def quantiles(df: DataFrame, v: str, shares: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each, per group (null keys are groups); values must not be null.

    A first pass takes sketches of the quantiles' neighbourhoods, a second one counts the values below each and
    ranks only those inside, so no task holds a group's values.
    """
    names = list(names) or [f"q{i}" for i in range(len(shares))]
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(v).alias("_v"))
    ends = [min(1.0, max(0.0, p + d)) for p in shares for d in (-MARGIN, MARGIN)]
    sketch = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    sketch = sketch.toDF(*[f"_s{i}" for i in range(len(k))], "_n", "_e")
    small = bounded(sketch)
    near = small if small is not None else sketch
    both = rows.join(near, same([F.col(x) for x in k], [F.col(f"_s{i}") for i in range(len(k))])) if k else rows.crossJoin(near)
    whole = F.col("_n") <= RANKED
    parts = F.array(*[F.struct(F.lit(j).alias("j"), F.col("_e")[2 * j].alias("lo"), F.col("_e")[2 * j + 1].alias("hi")) for j in range(len(shares))])
    cells = both.select(*k, "_n", "_v", F.inline(parts)).filter(whole | (F.col("_v") <= F.col("hi")))
    inside = F.when(whole | (F.col("_v") >= F.col("lo")), F.col("_v"))
    counted = cells.groupBy(*k, "_n", "j", inside.alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    up_to = F.sum("_m").over(Window.partitionBy(*k, "_n", "j").orderBy(F.col("_x").asc_nulls_first()))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in shares]), F.col("j") + 1)
    at = p * (F.col("_n") - 1)
    low = F.floor(at)
    ranked = counted.withColumn("_up", up_to).groupBy(*k, "_n", "j").agg(
        F.min(F.when(F.col("_up") > low, F.col("_x"))).alias("a"), F.min(F.when(F.col("_up") > F.least(low + 1, F.col("_n") - 1), F.col("_x"))).alias("b")
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (at - low)
    wide = ranked.groupBy(*k).agg(*[F.max(F.when(F.col("j") == j, value)).alias(n) for j, n in enumerate(names)])
    return wide.select(*[F.col(x).alias(c) for x, c in zip(k, keys, strict=True)], *names)


def high_quantile(df: DataFrame, y: str) -> DataFrame:
    """One row: n, low, top, high.  ``high`` is the 0.9 quantile (0.75 under 6 values); if it is the top, the next lower value."""
    v = df.select(V.number(y).alias("v")).filter("v is not null")
    ends = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("top"))
    under = v.crossJoin(F.broadcast(ends)).groupBy("n", "low", "top").agg(F.max(F.when(F.col("v") < F.col("top"), F.col("v"))).alias("next"))
    one = ends.crossJoin(F.broadcast(quantiles(v, "v", (0.75, 0.9), names=("q7", "q9")))).join(F.broadcast(under.select("next")), how="left")
    q = F.when(F.col("n") >= 6, F.col("q9")).otherwise(F.col("q7"))
    return one.select("n", "low", "top", F.when(q >= F.col("top"), F.col("next")).otherwise(q).alias("high"))


def fractions(df: DataFrame, y: str) -> DataFrame:
    """One row: shares of values in [0, 1], in [0, 100] and above 0, and the largest magnitude."""
    v = V.number(y)
    share = lambda c: F.avg(F.when(v.isNotNull(), c.cast("double")))
    return df.agg(
        share(v.between(0, 1)).alias("unit"), share(v.between(0, 100)).alias("hundred"), share(v > 0).alias("positive"),
        F.max(F.abs(v)).alias("magnitude"), F.avg(F.abs(v)).alias("mean_magnitude"),
    )


@dataclass(frozen=True)
class AxisBreak:
    """A gap in the value axis that is drawn ``width`` wide."""

    start: float
    end: float
    width: float
    shift: float
    display_top: float
    visual_bottom: float
    visual_top: float


def axis_break(n: int, low: float | None, top: float | None, high: float | None, keep: float = 0.12) -> AxisBreak | None:
    """Whether few values lie so far above the rest that the axis should be broken, from ``high_quantile``'s row."""
    if not n or low is None or top is None or high is None or top <= 0:
        return None
    spread = high - low
    if spread <= 0:
        spread = max(1.0, 0.1 * abs(low))
    lead = top - high
    if lead <= max(1.0, spread / 4):
        return None
    end = top - 0.35 * lead
    width = keep * (end - high)
    shift = (end - high) - width
    bottom = min(low, high - 0.05 * max(1.0, high - low))
    return AxisBreak(high, end, width, shift, high + width, bottom, top - shift + 0.05 * max(1.0, top - end))


def y_range(low: float, top: float, ratio: bool) -> tuple[float, float]:
    """Limits of the value axis: padded and within [0, 1.2] for ratios, else from 0 or below."""
    if ratio and top <= 1.5:
        pad = max(0.2 * (top - low), 0.02 if top <= 0.5 else 0.05)
        return max(0.0, low - pad), min(1.2, top + pad)
    bottom = min(0.0, low)
    return bottom, top if top != bottom else bottom + (0.1 * abs(bottom) if bottom else 1.0)


def peak(df: DataFrame, y: str, order: str) -> DataFrame:
    """The row with the largest value, the first of equals."""
    return df.filter(V.number(y).isNotNull()).orderBy(V.number(y).desc(), order).limit(1)


def reference_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """The mean of the sums per x."""
    return df.groupBy(x).agg(V.sum0(V.number(y)).alias("s")).agg(F.avg("s").alias("mean"))


def tally(df: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Rows per kind, 0 for kinds without rows."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k,) for k in kinds], f"`{column}` string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
