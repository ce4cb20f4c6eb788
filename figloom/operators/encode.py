"""Category dimensions, dense grids and row-preserving group values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def first_seen(df: DataFrame, column: str, order: str, code: str = "code") -> DataFrame:
    """One row per distinct value (null too) with its number in order of first appearance, from 0.

    The numbering runs over the aggregated dimension only, never over the rows.
    """
    dim = df.groupBy(column).agg(F.min(order).alias("_first"))
    return dim.select(column, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias(code))


def encode(df: DataFrame, column: str, dimension: DataFrame, code: str = "code") -> DataFrame:
    """Rows with their value's code; unknown and null values get -1."""
    d = dimension.select(F.col(column).alias("_v"), F.col(code).alias("_c"))
    out = df.join(d, F.col(column) == F.col("_v"), "left")
    return out.withColumn(code, F.coalesce("_c", F.lit(-1)).cast("long")).drop("_v", "_c")


def thin_ticks(dimension: DataFrame, count: int, code: str = "code", most: int = 50) -> DataFrame:
    """Every ceil(count / most)-th category once there are more than ``most``."""
    return dimension.filter(F.col(code) % max(1, -(-count // most)) == 0)


def jitter(code: Column, categories: int, seed: int = 0) -> Column:
    """The code moved at random by at most min(0.15, 1 / max(2, categories))."""
    j = min(0.15, 1 / max(2, categories))
    return code + (F.rand(seed) - 0.5) * 2 * j


def valid_rows(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Rows in which every measure is a number."""
    return df.filter(reduce(lambda a, b: a & b, [V.number(m).isNotNull() for m in measures]))


def value_of(column: str, ratio: bool) -> Column:
    """Ratios are averaged, other measures summed."""
    return F.avg(V.number(column)) if ratio else V.sum0(V.number(column))


#: Rows of an aggregate that may be sent to every executor.
SMALL_ROWS = 10_000


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame | None:
    """A small result as a broadcast table, or None if it has more than ``rows`` rows.  Runs it, reading one row more at most."""
    got = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if len(got) <= rows else None


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Whether keys agree; null is a key like others."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def group_broadcast(df: DataFrame, keys: Sequence[str], measure: str, ratio: bool = False, name: str | None = None) -> DataFrame:
    """Each row with its group's sum (or mean); rows stay.

    The groups are aggregated (partially where the rows lie) and joined back, so no task holds a group; few
    groups are broadcast.
    """
    out = name or measure
    keyed = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    v = F.avg(V.number(measure)) if ratio else V.sum0(V.number(measure)).cast("double")
    values = df.groupBy(*keyed).agg(v.alias("_value"))
    values = bounded(values) or values
    joined = df.join(values, same([df[k] for k in keys], [F.col(f"_key{i}") for i in range(len(keys))]), "left")
    return joined.withColumn(out, F.col("_value")).drop("_value", *[f"_key{i}" for i in range(len(keys))])


def collapse(df: DataFrame, keys: Sequence[str], measure: str, ratio: bool = False, name: str | None = None) -> DataFrame:
    """One row per key."""
    return df.groupBy(*keys).agg(value_of(measure, ratio).alias(name or measure))


def dense_grid(
    df: DataFrame, row: str, column: str, measure: str, ratio: bool = False, name: str = "value", most: int = SMALL_ROWS
) -> DataFrame:
    """Every pair of the two columns' non-null values with the measure's value, 0 where there is none.

    The product is of two dimensions that a chart shows side by side, after aggregation.  ``column`` may
    have ``most`` values: that is checked, and more raise.
    """
    known = df.na.drop(subset=[row, column])
    cells = collapse(known, [row, column], measure, ratio, name)
    cols = bounded(known.select(column).distinct(), most)
    if cols is None:
        raise ValueError(f"{column} has more than {most} values; a grid shows few")
    grid = known.select(row).distinct().crossJoin(cols).join(cells, [row, column], "left")
    return grid.withColumn(name, F.coalesce(name, F.lit(0.0)))


def drawing_order(df: DataFrame, x: str, order: str, series: str | None = None) -> DataFrame:
    """Rows in the order in which a mark is drawn: by series, then by x, then as they came.

    Times go by value (nulls last); other x and the series go by first appearance.
    """
    keys, drop = [], []
    for k, column in enumerate(c for c in (series, x) if c):
        if column == x and V.semantic(df.schema[x].dataType) == "temporal":
            keys.append(F.col(x).asc_nulls_last())
            continue
        code = f"_code{k}"
        seen = first_seen(df, column, order, code).withColumnRenamed(column, f"_seen{k}")
        seen = bounded(seen) or seen
        df = df.join(seen, same([F.col(column)], [F.col(f"_seen{k}")]), "left")
        keys.append(F.col(code))
        drop += [code, f"_seen{k}"]
    return df.orderBy(*keys, order).drop(*drop)


def guarded_moment(df: DataFrame, x: str, timely: bool = True, least: int = 3, share: float = 0.3) -> DataFrame:
    """x as timestamps, if it is time by name and at least max(``least``, ``share`` of all rows) parse; else as it is."""
    if not timely:
        return df
    n, parsed = df.agg(F.count(F.lit(1)), F.count(V.moment(x))).first()
    return df.withColumn(x, V.moment(x)) if parsed >= max(least, share * n) else df


def duplicates(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Keys of several rows, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def has_duplicates(df: DataFrame, keys: Sequence[str]) -> bool:
    return not duplicates(df, keys, "_n").isEmpty()
