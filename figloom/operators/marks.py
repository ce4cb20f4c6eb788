"""Mark-ready tables: what each kind of chart draws, as one lazy DataFrame per mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .encode import bounded, collapse, dense_grid
from .stats import quantiles


def bar(df: DataFrame, x: str, y: str, ratio: bool = False) -> DataFrame:
    return collapse(df, [x], y, ratio, "height")


def bar_grouped(df: DataFrame, x: str, group: str, y: str, ratio: bool = False) -> DataFrame:
    return dense_grid(df, x, group, y, ratio, "height")


def stack(cells: DataFrame, x: str, series: str, value: str, normalise: bool = False) -> DataFrame:
    """Offsets of stacked values per x in series order; ``normalise`` divides by the total (a total of 0 counts as 1)."""
    per_x = Window.partitionBy(x)
    if normalise:
        total = F.sum(value).over(per_x)
        cells = cells.withColumn(value, F.col(value) / F.when(total == 0, 1.0).otherwise(total))
    below = per_x.orderBy(series).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(value).over(below), F.lit(0.0))
    return cells.withColumn("base", base).withColumn("top", F.col("base") + F.col(value))


def bar_stacked(df: DataFrame, x: str, group: str, y: str, ratio: bool = False) -> DataFrame:
    return stack(dense_grid(df, x, group, y, ratio, "height"), x, group, "height")


def bar_percent(df: DataFrame, x: str, group: str, y: str) -> DataFrame:
    return stack(dense_grid(df, x, group, y, False, "height"), x, group, "height", normalise=True)


def area_stacked(df: DataFrame, x: str, group: str, y: str, ratio: bool = False) -> DataFrame:
    """Ratios are averaged and normalised to 1 per x, others stacked as they are."""
    return stack(dense_grid(df.filter(V.number(y).isNotNull()), x, group, y, ratio, "height"), x, group, "height", ratio)


def waterfall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Running totals of the sums per x, in order of x."""
    steps = collapse(df, [x], y, False, "delta")
    before = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)  # over the aggregated steps only
    base = F.coalesce(F.sum("delta").over(before), F.lit(0.0))
    return steps.withColumn("base", base).withColumn("top", F.col("base") + F.col("delta"))


def pie(df: DataFrame, label: str, y: str) -> DataFrame:
    """Positive slices and their share of the whole."""
    slices = collapse(df, [label], y, False, "value").filter("value > 0")
    return slices.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def points(df: DataFrame, columns: Sequence[str], x: str, y: str) -> DataFrame:
    """Scatter, lollipop and line rows: the needed columns where x and y are known."""
    keep = [c for c in columns if c in df.columns]
    return df.select(*keep).filter(F.col(x).isNotNull() & V.number(y).isNotNull())


def line(df: DataFrame, x: str, y: str, group: str | None = None, ratio: bool = False) -> DataFrame:
    """One value per x and series (``encode.drawing_order`` sorts rows as they are drawn)."""
    keys = [x] if group is None else [group, x]
    return collapse(df.filter(V.number(y).isNotNull()), keys, y, ratio, "value")


def band(df: DataFrame, x: str, y: str, low: str, high: str, group: str | None = None) -> DataFrame:
    """A line with its interval (means per x and series)."""
    keys = [x] if group is None else [group, x]
    return df.groupBy(*keys).agg(*[F.avg(V.number(c)).alias(n) for c, n in ((y, "value"), (low, "low"), (high, "high"))])


def error_bars(df: DataFrame, x: str, y: str, err: str, group: str | None = None) -> DataFrame:
    v, e = V.number(y), V.number(err)
    keep = [x, *([group] if group else [])]
    return df.select(*keep, v.alias("value"), (v - e).alias("low"), (v + e).alias("high")).filter("value is not null")


def heatmap(df: DataFrame, row: str, column: str, y: str) -> DataFrame:
    """Mean per cell, 0 for empty cells of rows and columns that have a value."""
    return dense_grid(df.filter(V.number(y).isNotNull()), row, column, y, True, "value")


def pivot(df: DataFrame, row: str, column: str, y: str, names: Sequence, how: str = "sum") -> DataFrame:
    """A wide table with given column values (no extra job to find them); null keys are dropped, gaps are 0."""
    v = V.number(y)
    rows = df.na.drop(subset=[row, column])
    rows = rows.filter(v.isNotNull()) if how == "mean" else rows
    wide = rows.groupBy(row).pivot(column, list(names)).agg(V.sum0(v) if how == "sum" else F.avg(v))
    return wide.na.fill(0)


def bounds(df: DataFrame, y: str) -> tuple[float | None, float | None]:
    """Least and largest value (one aggregate row)."""
    r = df.agg(F.min(V.number(y)), F.max(V.number(y))).first()
    return r[0], r[1]


def histogram(df: DataFrame, y: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins, the last one closed; empty bins are listed."""
    v = V.number(y)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))  # one row
    ends = ends.filter("lo is not null").select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.select(v.alias("v")).filter("v is not null").crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    out = grid.join(counts, "bin", "left")
    left = F.col("lo") + F.col("bin") * F.col("w")
    return out.select("bin", left.alias("left"), (left + F.col("w")).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, y: str, category: str | None = None) -> DataFrame:
    """Exact quartiles, whiskers (extreme values within 1.5 quartile ranges) and the count outside them."""
    keys = [category] if category else []
    rows = df.select(*keys, V.number(y).alias("v")).filter("v is not null")
    q = quantiles(rows, "v", (0.25, 0.5, 0.75), keys, ("q1", "med", "q3"))
    small = bounded(q)
    q = small if small is not None else q
    if category:
        k = q.withColumnRenamed(category, "_k")
        joined = rows.join(k, F.col(category).eqNullSafe(F.col("_k"))).drop("_k")
    else:
        joined = rows.crossJoin(F.broadcast(q))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return joined.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("low"),
        F.max(F.when(inside, F.col("v"))).alias("high"),
        F.count(F.when(~inside, 1)).alias("n_out"),
    )


#: Distinct values of a category up to which a density takes each; beyond, values go to so many even bins.
DENSITY_BINS = 4_096


def violin(df: DataFrame, y: str, category: str | None = None, grid: int = 50, bins: int = DENSITY_BINS) -> DataFrame:
    """Gaussian density on an even grid (Scott's bandwidth), per category (a null category is left out).

    The work is at most ``bins`` values times grid points a category: where a category has more distinct values
    (by a sketch), each value is shared out between its two neighbouring bins in proportion.
    """
    keys = [category] if category else []
    rows = df.select(*keys, V.number(y).alias("v")).filter("v is not null")
    s = rows.groupBy(*keys).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"), F.stddev_samp("v").alias("sd"),
        F.approx_count_distinct("v", 0.01).alias("kinds"),
    )
    s = s.filter("total > 1 and sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("total"), -0.2))
    small = bounded(s)
    s = small if small is not None else s
    placed = rows.join(s, keys[0]) if keys else rows.crossJoin(F.broadcast(s))
    step = (F.col("hi") - F.col("lo")) / (bins - 1)
    place = (F.col("v") - F.col("lo")) / step
    below = F.floor(place)
    shared = F.array(
        F.struct((F.col("lo") + below * step).alias("v"), (1 - (place - below)).alias("w")),
        F.struct((F.col("lo") + (below + 1) * step).alias("v"), (place - below).alias("w")),
    )
    own = F.array(F.struct(F.col("v").alias("v"), F.lit(1.0).alias("w")))
    cells = placed.select(*keys, F.inline(F.when(F.col("kinds") > bins, shared).otherwise(own)))
    counted = cells.groupBy(*keys, "v").agg(F.sum("w").alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    s = s.select(*keys, at, "lo", "hi", "total", "h").withColumn("at", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (grid - 1))
    joined = counted.join(s, keys[0]) if keys else counted.crossJoin(F.broadcast(s))
    z = (F.col("at") - F.col("v")) / F.col("h")
    kernel = F.exp(-0.5 * z * z) / F.lit(2.5066282746310002)
    return joined.groupBy(*keys, "i", "at").agg(
        (F.sum(kernel * F.col("n")) / (F.first("total") * F.first("h"))).alias("density")
    )


def hexbin(df: DataFrame, x: str, y: str, size: int = 20) -> DataFrame:
    """Counts per hexagon: the nearer centre of two offset rectangular lattices."""
    vx, vy = V.number(x), V.number(y)
    ends = df.agg(*[f(v).alias(n) for v, a in ((vx, "x"), (vy, "y")) for f, n in ((F.min, f"{a}0"), (F.max, f"{a}1"))])
    rows = df.select(vx.alias("vx"), vy.alias("vy")).na.drop().crossJoin(F.broadcast(ends))
    ny = max(1, int(size / 3**0.5))
    w = F.when(F.col("x1") > F.col("x0"), (F.col("x1") - F.col("x0")) / size).otherwise(1.0)
    h = F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / ny).otherwise(1.0)
    a, b = (F.col("vx") - F.col("x0")) / w, (F.col("vy") - F.col("y0")) / h
    i1, j1, i2, j2 = F.floor(a + 0.5), F.floor(b + 0.5), F.floor(a), F.floor(b)

    def far(i: Column, j: Column, shift: float) -> Column:
        return (a - i - shift) * (a - i - shift) + 3 * (b - j - shift) * (b - j - shift)

    first = far(i1, j1, 0.0) < far(i2, j2, 0.5)
    cell = rows.select(
        F.when(first, i1).otherwise(i2).alias("i"), F.when(first, j1).otherwise(j2).alias("j"), first.alias("even")
    )
    return cell.groupBy("i", "j", "even").agg(F.count(F.lit(1)).alias("n"))
