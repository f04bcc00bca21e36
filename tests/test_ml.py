"""Feature bank and prototypes as ML stages: their rows are those of the functions, also after saving and loading."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from vexilar.models.ml import FeatureBank, NearestPrototype, NearestPrototypeModel
from vexilar.operators import prototypes
from vexilar.plans import discovery
from vexilar.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(i, i % 5, rng.normal(i % 5, 0.4, 6).tolist(), rng.normal(-(i % 5), 0.4, 3).tolist(), "kept") for i in range(200)]
    return materialize(spark.createDataFrame(data, "id bigint, label bigint, deep array<double>, rf array<double>, note string"), "ml_rows")


def pairs(df, *columns):
    return {r["id"]: [np.array(r[c]) for c in columns] for r in df.collect()}


def test_loaded_pipeline_gives_the_functions_rows(spark, rows, tmp_path):
    train, later = rows.where("id < 120"), rows.where("id >= 120")
    pipe = Pipeline(stages=[FeatureBank(inputCols=["deep", "rf"]), NearestPrototype(inputCol="hybrid", oldClasses=2, bonus=0.05)])
    pipe.write().overwrite().save(f"{tmp_path}/pipe")
    model = Pipeline.load(f"{tmp_path}/pipe").fit(train)
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    assert isinstance(loaded.stages[1], NearestPrototypeModel) and loaded.stages[1].getOrDefault("oldClasses") == 2 and loaded.stages[1].uid == model.stages[1].uid
    out = loaded.transform(later)
    assert out.columns == ["id", "label", "deep", "rf", "note", "hybrid", "pred", "sim"]
    bank_train, bank_later = discovery.feature_bank(train, later)
    want = pairs(bank_later, "deep", "rf", "hybrid")
    got = pairs(out, "deep", "rf", "hybrid")
    assert got.keys() == want.keys() and all(np.allclose(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    protos = prototypes.make_prototypes(bank_train.join(train.select("id", "label"), "id").select("label", F.col("hybrid").alias("v")))
    plain = {r["id"]: (r["pred"], round(r["sim"], 6)) for r in prototypes.predict(bank_later.select("id", F.col("hybrid").alias("v")), protos, 2, 0.05).collect()}
    assert {r["id"]: (r["pred"], round(r["sim"], 6)) for r in out.collect()} == plain


def test_nulls_and_several_prototypes(spark, rows):
    odd = rows.select("id", "label", F.col("deep").alias("v")).union(spark.createDataFrame([(900, 1, None), (901, None, [1.0] * 6)], "id bigint, label bigint, v array<double>"))
    model = NearestPrototype(prototypesPerClass=2).fit(odd)
    assert model.table.count() == 10
    got = {r["id"]: r["pred"] for r in model.transform(odd).collect()}
    assert got[900] is None and got[901] is not None and len(got) == 202
