import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import folds as S
from propspark.operators.folds import SplitConfig


@pytest.fixture(scope="module")
def six(spark):
    rows = [(0, "CC", "a", 1), (1, "CCC", "a", 2), (2, "c1ccccc1", "b", 3), (3, "c1ccccc1O", "b", 4), (4, "CCO", "c", 5), (5, "CCN", "d", 6)]
    return spark.createDataFrame(rows, "id int, smiles string, grp string, t int").withColumn("time", F.timestamp_seconds("t"))


def naive_greedy(sizes, k):
    loads, out = [0] * k, []
    for s in sizes:
        j = int(np.argmin(loads))
        loads[j] += s
        out.append(j)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_schedule_equals_group_by_group_rule(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(2, 9))
    sizes = sorted((int(v) for v in rng.choice([1, 1, 2, 3, 7, 40, 300], size=int(rng.integers(1, 400)))), reverse=True)
    classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    got = []
    for _, lo, hi, turn in S.lightest_first_schedule(classes, k):
        got += [turn[i % len(turn)] for i in range(hi - lo)]
    assert got == naive_greedy(sizes, k)


def test_random(six):
    out = S.random_folds(six, "id", 3, seed=7)
    got = {r["id"]: r["fold"] for r in out.collect()}
    assert sorted(got) == list(range(6)) and sorted(got.values()) == [1, 1, 2, 2, 3, 3]
    assert got == {r["id"]: r["fold"] for r in S.random_folds(six, "id", 3, seed=7).collect()}
    assert [r["fold"] for r in S.random_folds(six, "id", 4, shuffle=False).orderBy("id").collect()] == [1, 1, 2, 2, 3, 4]
    for k in (1, 7):
        with pytest.raises(ValueError):
            S.random_folds(six, "id", k)


def test_group(six):
    got = {}
    for r in S.group_folds(six, "grp", 2).collect():
        got.setdefault(r["grp"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in got.values()) and set.union(*got.values()) == {1, 2}
    with pytest.raises(ValueError, match="group_column"):
        S.assign_folds(six, "id", SplitConfig("group"), 2)
    with pytest.raises(ValueError, match="unique groups"):
        S.group_folds(six.withColumn("grp", F.lit("x")), "grp", 2)


def test_derived_key(six):
    ring = F.when(F.col("smiles").contains("c1"), F.lit("ring"))
    out = S.derived_group_folds(six, ring, 2, order_col="id").collect()
    assert {r["fold"] for r in out if "c1" in r["smiles"]} == {2} and {r["fold"] for r in out if "c1" not in r["smiles"]} == {1}
    with pytest.raises(ValueError):
        S.derived_group_folds(six, F.lit("same"), 2, order_col="id")
    three = S.derived_group_folds(six, ring, 3, order_col="id")
    assert {r["fold"] for r in three.collect()} == {1, 2}


def test_hot_group_split(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"g{i % 40}") for i in range(600)], "id int, grp string")
    sizes = df.groupBy("grp").count().collect()
    out = S.group_folds(df, "grp", 4)
    assert out.count() == 600
    assert len({(r["grp"], r["fold"]) for r in out.select("grp", "fold").distinct().collect()}) == len(sizes)


def test_time(six):
    with pytest.raises(ValueError, match="time_column"):
        S.assign_folds(six, "id", SplitConfig("time_series"), 2)
    got = S.time_splits(six, "time", "id", 2).collect()
    side = lambda s, r: sorted(x["id"] for x in got if x["split"] == s and x["role"] == r)
    assert (side(1, "train"), side(1, "test")) == ([0, 1], [2, 3])
    assert (side(2, "train"), side(2, "test")) == ([0, 1, 2, 3], [4, 5])
    cfg = SplitConfig("time_series", time_column="time")
    tr, te = S.train_test(S.assign_folds(six, "id", cfg, 2), cfg, 2)
    assert sorted(r["id"] for r in tr.collect()) == [0, 1, 2, 3] and sorted(r["id"] for r in te.collect()) == [4, 5]


def test_holdout(six):
    cfg = SplitConfig("random", random_state=1)
    a = {r["id"]: r["is_valid"] for r in S.holdout(six, "id", cfg, 0.34).collect()}
    assert sum(a.values()) == 3 and a == {r["id"]: r["is_valid"] for r in S.holdout(six, "id", cfg, 0.34).collect()}
    t = {r["id"]: r["is_valid"] for r in S.holdout(six, "id", SplitConfig("time_series", time_column="time"), 0.34).collect()}
    assert t == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True}
    g = S.holdout(six, "id", SplitConfig("scaffold", derived_key="grp"), 0.34)
    assert 0 < g.filter("is_valid").count() < 6
    with pytest.raises(ValueError):
        S.holdout(six.filter("id < 3"), "id", cfg, 0.3)
    with pytest.raises(ValueError):
        S.assign_folds(six, "id", SplitConfig("nope"), 2)
