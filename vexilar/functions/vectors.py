"""Vector arithmetic on array<double> columns, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.functions.aggregate import deviations, means, vector_states

#: Added to norms and standard deviations before dividing by them.
NORM_EPS, STD_EPS = 1e-8, 1e-8


def doubles(v: Column | str) -> Column:
    """Any numeric array as array<double>, so that sums are in double precision."""
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = NORM_EPS) -> Column:
    """v / (|v| + eps)."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm(v) + eps, F.size(v)).alias("n")), lambda p: p["x"] / p["n"])


def unit(df: DataFrame, v: str, eps: float = NORM_EPS) -> DataFrame:
    """Replaces the column ``v`` by its unit vector; the norm is computed once a row."""
    return df.withColumn("_n", norm(F.col(v)) + eps).withColumn(v, F.expr(f"transform({v}, x -> x / _n)")).drop("_n")


def sq_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def scale(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * k)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clean(x: Column) -> Column:
    """NaN and infinities as 0, like null."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def mean_by(df: DataFrame, keys: list[str], v: str, out: str | None = None) -> DataFrame:
    """Vector mean of each group: (keys, n, out), n its vectors. A task sends one state a group through the shuffle."""
    return vector_states(df, keys, v).select(*keys, F.col("_n").alias("n"), means().alias(out or v))


def column_stats(df: DataFrame, v: str) -> DataFrame:
    """(i, mean, std): mean and population standard deviation of each component over all rows."""
    both = vector_states(df, [], v).select(F.arrays_zip(means().alias("mean"), deviations().alias("std")).alias("_s"))
    return both.select(F.posexplode("_s").alias("i", "_s")).select("i", "_s.mean", "_s.std")


def standardize(df: DataFrame, v: str, stats: DataFrame | None = None, eps: float = STD_EPS, unit_if_flat: bool = False) -> DataFrame:
    """Column z-scores of ``v`` with the given or the frame's own statistics (one row a component).

    eps is added to the standard deviation; with unit_if_flat a deviation of 0 counts as 1 instead. NaN becomes 0.
    """
    stats = column_stats(df, v) if stats is None else stats
    one = stats.agg(F.sort_array(F.collect_list(F.struct("i", "mean", "std"))).alias("_s"))
    std = (lambda s: F.when(s["std"] == 0, 1.0).otherwise(s["std"])) if unit_if_flat else (lambda s: s["std"] + eps)
    done = df.crossJoin(F.broadcast(one))  # one row: a component's mean and deviation for each of a vector's places
    return done.withColumn(v, F.zip_with(v, "_s", lambda x, s: clean((x - s["mean"]) / std(s)))).drop("_s")
