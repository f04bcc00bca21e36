"""Quantiles and splits of groups that hold all rows: exact, and in several tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexilar.operators import quantiles, splits
from vexilar.session import materialize


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 2)
    rng = np.random.default_rng(1)
    data = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: rng.uniform(size=77)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("nothing", None)]
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {(r["k"], r["q"]): r["value"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", shares).collect()}
    assert set(got) == {(k, q) for k in data for q in shares}
    assert all(got[k, q] == pytest.approx(np.quantile(v, q), abs=1e-12) for k, v in data.items() for q in shares)


def test_quantiles_plan_holds_no_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 5000).cast("double").alias("v"))
    found = quantiles.exact_quantiles(df, "k", "v", (0.5,))
    assert "percentile(" not in found._jdf.queryExecution().executedPlan().toString() and found.first()["value"] == 2499.5
    assert quantiles.exact_quantiles(df.limit(0), "k", "v", (0.5,)).count() == 0


@pytest.mark.parametrize("split", ["seeded", "stratified", "order_block"])
def test_a_class_of_all_rows_fills_several_tasks(spark, split):
    df = materialize(spark.range(4000).select("id", F.when(F.col("id") < 3990, 1).otherwise(2).alias("label")), "hot")
    found = {"seeded": lambda: splits.seeded(df, ["label"], "id", 0.7), "stratified": lambda: splits.stratified(df, "label", "id", 0.25), "order_block": lambda: splits.order_block(df, ["label"], ["id"])}[split]()
    sizes = {(r["label"], r["split"]): r["count"] for r in found.groupBy("label", "split").count().collect()}
    assert sizes == {"seeded": {(1, "train"): 2793, (1, "eval"): 1197, (2, "train"): 7, (2, "eval"): 3}, "stratified": {(1, "val"): 998, (1, "train"): 2992, (2, "val"): 2, (2, "train"): 8}, "order_block": {(1, "train"): 2793, (1, "eval"): 1197, (2, "train"): 7, (2, "eval"): 3}}[split]
    parts = found.where("label = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000 and found.columns == ["id", "label", "split"]
