"""Exact quantiles of groups of any size: a sketch brackets each rank, counts place the bracket, and only it is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.operators.prefix import running
from vexilar.session import materialize

#: Of the sketch: ranks are found to within a group's rows / ACCURACY. Brackets reach MARGIN times as far on both sides.
ACCURACY, MARGIN = 10_000, 4
#: Brackets that are broadcast at most.
BROADCAST_BRACKETS = 200_000


def exact_quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(key, q, value): for each group and share the quantile with linear interpolation, as ``percentile`` gives it.

    Null values don't count; a group without others gives no row; a null key is a group. A task never holds a group: a
    mergeable sketch gives two values around each rank, a second pass counts the rows below them, and a third reads the
    rows between them, some MARGIN * 2 / ACCURACY of a group, counted by value and ranked by ranges.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null")
    reach = MARGIN / ACCURACY
    ends = [s for q in shares for s in (max(0.0, q - reach), min(1.0, q + reach))]
    sketch = rows.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("x", [float(e) for e in ends], ACCURACY).alias("e"))
    each = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high")) for i, q in enumerate(shares)])
    brackets = materialize(sketch.select("k", "n", each.alias("b")), "brackets")
    held = F.broadcast(brackets) if brackets.limit(BROADCAST_BRACKETS + 1).count() <= BROADCAST_BRACKETS else brackets
    joined = rows.withColumnRenamed("k", "_k").join(held, F.col("_k").eqNullSafe(F.col("k"))).select("k", "n", "b", "x")
    sides = []
    for i in range(len(shares)):  # rows below the bracket, and the values next to it on both sides
        low, high = F.get("b", F.lit(i))["low"], F.get("b", F.lit(i))["high"]
        under, above = F.max(F.when(F.col("x") < low, F.col("x"))), F.min(F.when(F.col("x") > high, F.col("x")))
        sides.append(F.struct(F.count_if(F.col("x") < low).alias("below"), under.alias("under"), above.alias("above")))
    around = joined.groupBy("k").agg(F.array(*sides).alias("s")).select(F.col("k").alias("_k"), F.posexplode("s").alias("_i", "s"))
    inside = joined.select("k", "n", "x", F.posexplode("b").alias("i", "b")).where("x between b.low and b.high").groupBy("k", "i", "b.q", "n", "x").agg(F.count("*").alias("c"))
    ranked = running(inside, ["k", "i"], ["x"], upto=F.col("c"))
    placed = ranked.join(around, F.col("k").eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i"))).withColumn("at", F.col("q") * (F.col("n") - 1))
    upto = F.col("s.below") + F.col("upto")
    value_at = lambda rank: F.min(F.when((upto > rank) & (F.col("s.below") <= rank), F.col("x")))  # noqa: E731 - values rise with their rank
    found = placed.groupBy("k", "i", "q", "at").agg(value_at(F.floor("at")).alias("a"), value_at(F.ceil("at")).alias("z"), F.first("s").alias("s"), F.max(upto).alias("end"))
    beside = lambda rank, own: F.when(F.col(own).isNotNull(), F.col(own)).when(rank == F.col("s.below") - 1, F.col("s.under")).when(rank == F.col("end"), F.col("s.above"))
    a, z = beside(F.floor("at"), "a"), beside(F.ceil("at"), "z")
    exact = F.when(a.isNotNull() & z.isNotNull(), a + (F.col("at") - F.floor("at")) * (z - a)).otherwise(F.raise_error(F.lit("a bracket lost its rank")).cast("double"))
    return found.select(F.col("k").alias(key), "q", exact.alias("value"))
