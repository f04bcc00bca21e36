"""Running sums in order over any number of rows: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.session import materialize


def running(df: DataFrame, keys: list[str], order: list[str | Column], whole: dict[str, str] | None = None, **sums: Column) -> DataFrame:
    """``df`` with the sum of each column in ``sums`` over its group's rows up to and with its own, as a stored table.

    whole: names of further columns, and the sums whose totals over the whole group they hold.

    Rows are dealt by ranges of keys and order, so that a large group fills several partitions. Each partition sums its
    own rows, and gets the totals of those before it: a row a partition and group, which is all that is joined. Rows
    that are equal in keys and order are summed in any order. Columns must not be called _part or _sum_*.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.select("*", *[c.alias(f"_sum_{k}") for k, c in sums.items()]).repartitionByRange(n, *[F.col(k) for k in keys], *order)
    parts = materialize(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(f"_sum_{k}").alias(k) for k in sums])
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before_{k}") for k in sums], *[F.sum(k).over(Window.partitionBy(*keys)).alias(out) for out, k in (whole or {}).items()])
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.select(*parts.columns, *[F.sum(f"_sum_{k}").over(within).alias(f"_own_{k}") for k in sums])
    same = summed["_part"] == totals["_p"]
    for k in keys:
        same &= summed[k].eqNullSafe(totals[f"_k_{k}"])
    joined = summed.join(totals, same)
    return joined.select(*df.columns, *[(F.col(f"_before_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums], *(whole or {}))
