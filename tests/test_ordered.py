import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators.ordered import average_ranks, global_index, join_counted, quantiles, running_total, sequential_ids


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), 5.0 if i % 3 == 0 else float(rng.integers(0, 400))) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, g int, x double").cache()


def test_global_index(skewed):
    got = global_index(skewed, ["x", "id"]).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(1500))
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)


def test_running_total(skewed):
    dist = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    got = running_total(dist, ["x"], "w", "before").orderBy("x").collect()
    want = np.concatenate([[0], np.cumsum([r["w"] for r in got])[:-1]])
    assert [r["before"] for r in got] == want.tolist()


@pytest.mark.parametrize("group_rows", [10_000, 10])
def test_quantiles(skewed, group_rows):
    pdf = skewed.toPandas()
    got = {r["g"]: r for r in quantiles(skewed, "x", {"a": 0.05, "b": 0.5}, ["g"], group_rows=group_rows).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g]["a"] == pytest.approx(np.percentile(part.x, 5))
        assert got[g]["b"] == pytest.approx(np.median(part.x))
    one = quantiles(skewed, "x", {"a": 0.05}, group_rows=group_rows).first()["a"]
    assert one == pytest.approx(np.percentile(pdf.x, 5))


def test_quantiles_mixed_group_sizes(spark):
    df = spark.createDataFrame([("big", float(i)) for i in range(40)] + [("small", 1.0), ("small", 2.0)], "g string, x double")
    got = {r["g"]: r["m"] for r in quantiles(df, "x", {"m": 0.5}, ["g"], group_rows=10).collect()}
    assert got == {"big": 19.5, "small": 1.5}


def test_average_ranks(skewed):
    pdf = skewed.toPandas()
    want = dict(zip(zip(pdf.g, pdf.x), pdf.groupby("g").x.rank(method="average")))
    got = average_ranks(skewed.withColumn("w", F.lit(1)), "x", "w", ["g"]).collect()
    assert {(r["g"], r["x"]): r["rank"] for r in got} == want


def test_join_counted_splits_hot_keys(skewed):
    table = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted(map(tuple, skewed.join(table.select("x", "top"), "x").select("id", "x", "top").collect()))
    got = join_counted(skewed.select("id", "x"), table, ["x"], {"top": "top"}, "n", hot_rows=50)
    assert sorted(map(tuple, got.select("id", "x", "top").collect())) == want


def test_sequential_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    got = {r["k"]: r["mol_id"] for r in sequential_ids(df, ["k"], "src_").collect()}
    assert got == {1: "src_1", 2: "src_2", 3: "src_3"}
    with pytest.raises(ValueError):
        sequential_ids(df, [], "x")
