"""Folds and hold-outs of tables with missing ids."""

import pytest

from propspark.operators.folds import SplitConfig, holdout, random_folds


@pytest.mark.parametrize("shuffle", [True, False])
def test_balanced_folds_with_null_ids(spark, shuffle):
    df = spark.createDataFrame([(i if i > 1 else None,) for i in range(23)], "id long")
    got = {r["fold"]: r["count"] for r in random_folds(df, "id", 5, seed=3, shuffle=shuffle).groupBy("fold").count().collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 4, 5: 4}


def test_holdout_with_a_null_id(spark):
    df = spark.createDataFrame([(i or None,) for i in range(20)], "id long")
    assert holdout(df, "id", SplitConfig(random_state=1), 0.25).filter("is_valid").count() == 5
