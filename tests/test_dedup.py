import math

import pytest
from pyspark.sql import functions as F

from propspark.operators.dedup import deduplicate, prefer_rows

SCHEMA = "smiles_std string, activity double"


def rows(df, key="smiles_std"):
    return {r[key]: r for r in df.collect()}


def test_mean(spark):
    df = spark.createDataFrame([("CCO", 1.0), ("CCO", 3.0), ("c1ccccc1", 10.0)], SCHEMA)
    out = deduplicate(df, key_cols=["smiles_std"], target_col="activity")
    assert out.columns == ["smiles_std", "activity_deduplicated", "n_reps", "y_std", "y_min", "y_max"]
    got = rows(out)
    cco = got["CCO"]
    assert (cco["activity_deduplicated"], cco["n_reps"], cco["y_min"], cco["y_max"]) == (2.0, 2, 1.0, 3.0)
    assert cco["y_std"] == pytest.approx(math.sqrt(2))
    assert got["c1ccccc1"]["y_std"] is None and got["c1ccccc1"]["n_reps"] == 1


@pytest.mark.parametrize("group_rows", [1000, 1])
def test_median_keeps_first_present(spark, group_rows):
    df = spark.createDataFrame(
        [("K", 1.0, None, "CCN", 1), ("K", 2.0, "assay_1", "C-C-N", 2), ("K", 3.0, "assay_2", "CC[NH2]", 3)],
        SCHEMA + ", assay_id string, smiles string, ord int")
    out = deduplicate(df, key_cols=["smiles_std"], target_col="activity", method="median", keep_cols=["assay_id", "smiles", "nope"],
                      order_cols=["ord"], group_rows=group_rows).collect()
    assert len(out) == 1
    assert (out[0]["activity_deduplicated"], out[0]["assay_id"], out[0]["smiles"]) == (2.0, "assay_1", "CCN")


def test_drop_missing(spark):
    df = spark.createDataFrame([("CCO", 1.0), (None, 2.0), ("c1ccccc1", None)], SCHEMA)
    out = deduplicate(df, key_cols=["smiles_std"], target_col="activity").collect()
    assert [(r["smiles_std"], r["activity_deduplicated"]) for r in out] == [("CCO", 1.0)]


def test_null_key_forms_a_group(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 4.0)], SCHEMA)
    out = deduplicate(df, key_cols=["smiles_std"], target_col="activity", drop_missing_keys=False).collect()
    assert len(out) == 1 and out[0]["activity_deduplicated"] == 3.0


def test_errors(spark):
    df = spark.createDataFrame([("CCO", 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="target_col"):
        deduplicate(df, key_cols=["smiles_std"], target_col="y")
    with pytest.raises(ValueError, match="key_cols"):
        deduplicate(df, key_cols=["nope"], target_col="activity")
    with pytest.raises(ValueError, match="prefer_value must be provided"):
        deduplicate(df, key_cols=["smiles_std"], target_col="activity", prefer_col="activity")
    with pytest.raises(ValueError, match="method"):
        deduplicate(df, key_cols=["smiles_std"], target_col="activity", method="mode")


@pytest.mark.parametrize("method", ["mean", "median"])
def test_prefer(spark, method):
    df = spark.createDataFrame([("CCO", 1.0, False), ("CCO", 3.0, True), ("c1ccccc1", 10.0, True)], SCHEMA + ", scaled boolean").withColumn(
        "ord", F.monotonically_increasing_id())
    got = rows(deduplicate(df, key_cols=["smiles_std"], target_col="activity", method=method, prefer_col="scaled", prefer_value="false",
                           keep_cols=["scaled"], order_cols=["ord"]))
    assert (got["CCO"]["activity_deduplicated"], got["CCO"]["n_reps"], got["CCO"]["scaled"]) == (1.0, 1, False)
    assert got["c1ccccc1"]["activity_deduplicated"] == 10.0


def test_prefer_uniform_group(spark):
    df = spark.createDataFrame([("CCO", 1.0, True), ("CCO", 3.0, True)], SCHEMA + ", scaled boolean")
    out = deduplicate(df, key_cols=["smiles_std"], target_col="activity", prefer_col="scaled", prefer_value=False).first()
    assert (out["activity_deduplicated"], out["n_reps"]) == (2.0, 2)
    kept = prefer_rows(df, key_cols=["smiles_std"], prefer_col="scaled", prefer_value=False)
    assert kept.count() == 2


def test_one_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = deduplicate(df, key_cols=["l_partkey", "l_suppkey"], target_col="l_extendedprice", prefer_col="l_returnflag", prefer_value="N")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan
