"""Result tables: grouped statistics, pivots, joins of summaries, custom orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a grid of dimensions at most; its dimension tables are broadcast.
MOST_CELLS = 10_000_000


def mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric by group, named metric_mean and metric_std."""
    return df.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def pivot_rounds(df: DataFrame, keys: list[str], rounds: str, values: list, metric: str, mean_name: str = "mean") -> DataFrame:
    """One column a round, and the mean of those that aren't null."""
    wide = df.groupBy(*keys).pivot(rounds, values).agg(F.avg(metric))
    names = [F.col(f"`{v}`") for v in values]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in names])
    s = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in names])
    return wide.withColumn(mean_name, F.when(n > 0, s / n))


def mapped(c: Column, table: dict, default) -> Column:
    """Dictionary look-up with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def custom_order(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Rows in a given order of values, unknown values last."""
    return df.orderBy(mapped(F.col(column), {v: k for k, v in enumerate(order)}, 99), column, *then)


def per_round_summary(incremental: DataFrame, clustering: DataFrame) -> DataFrame:
    """Incremental rows after a round, with the clustering metrics of the same method and round where there are any."""
    rounds = incremental.where(F.col("stage").startswith("After R")).withColumn("round", F.regexp_extract("stage", r"R(\d+)", 1).cast("int"))
    out = rounds.join(clustering, ["method", "round"], "left")
    return out.withColumn("coverage", 1 - F.expr("try_cast(noise as double)"))


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows, with null where a table lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def cell_grid(df: DataFrame, dims: list[DataFrame], keys: list[str], least: int) -> DataFrame:
    """Counts over a dense grid of small dimension tables: rows, and whether a cell is valid (>= least) or empty."""
    cells = reduce(lambda a, b: a * b, (d.count() for d in dims), 1)
    if cells > MOST_CELLS:
        raise ValueError(f"a design of {cells} cells isn't a grid of small dimensions")
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)  # a row a cell of the design
    n = F.coalesce("count", F.lit(0))
    return grid.join(df.groupBy(*keys).count(), keys, "left").select(*keys, n.alias("n"), (n >= least).alias("valid"), (n == 0).alias("empty"))


def best_row(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)
