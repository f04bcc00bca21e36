"""Cubes of several files, one of them with a single record."""

import numpy as np
import pytest
from compare import assert_same, duck

from vexilar.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["cube_inspection", "cube_scan_chosen", "cube_scan_environments"])
def test_cubes_of_several_files(spark, tmp_path, name):
    """The third file holds one record: it still has all places of the dimensions."""
    ids = [*range(200), *range(5_000, 5_200), 10_000]
    x = np.random.default_rng(5).normal(size=(len(ids), 64)).astype(np.float32)
    rows = [(i, v.tolist(), i % 10) for i, v in zip(ids, x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    assert_same(queries()[name](spark, str(tmp_path)), duck(str(tmp_path)), oracle_sql()[name])
