"""Resampling by splitting and inside tasks, against plain Python and the joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import resample as R

Y, P = "y", "p"


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 1))) for g, n in (("a", 230), ("b", 37), ("c", 1)) for i in range(n)]
    rows += [("d", i, 2.0, float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "g string, k long, y double, p double")


def test_block_totals_add_up():
    """Blocks draw on their own and still share out every resample, each in proportion to its rows."""
    size, rows = 1_050, 100
    totals = np.stack([R.block_totals((3, "g"), size, b, rows, 400) for b in range(11)])
    assert (totals.sum(axis=0) == size).all() and totals.min() >= 0
    assert totals[:10].mean() == pytest.approx(100, rel=0.02) and totals[10].mean() == pytest.approx(50, rel=0.05)
    # The spread of a binomial, and the negative correlation of multinomial counts.
    p = 100 / size
    assert totals[:10].var() == pytest.approx(size * p * (1 - p), rel=0.1)
    assert np.mean([np.cov(totals[0], totals[j])[0, 1] for j in range(1, 10)]) == pytest.approx(-size * p * p, rel=0.5)
    assert (R.block_totals((3, "g"), 50, 0, 100, 5) == 50).all()


def test_runs_share_their_halves(monkeypatch):
    """Neighbouring blocks have the totals that each finds alone, and a half of the range is drawn once for all of them."""
    alone = [R.block_totals((3, "g"), 5_010, b, 16, 40) for b in range(314)]
    asked, stream = [], R._stream
    monkeypatch.setattr(R, "_stream", lambda *name: asked.append(name) or stream(*name))
    together = R.run_totals((3, "g"), 5_010, range(128, 256), 16, 40)
    assert all((together[b] == alone[b]).all() for b in range(128, 256))
    assert len(asked) == len(set(asked)) <= 128 + 2 * 9


def test_split_weights(spark, pairs):
    w = R.split_weights(pairs, ["g"], "k", [Y], samples=60, seed=5, block_rows=16)
    again = R.split_weights(pairs.repartition(7), ["g"], "k", [Y], samples=60, seed=5, block_rows=16)
    rows = {(r["g"], r["Sample"], r["k"]): r["_weight"] for r in w.collect()}
    assert rows == {(r["g"], r["Sample"], r["k"]): r["_weight"] for r in again.collect()}
    total = {}
    for (g, s, _), n in rows.items():
        total[g, s] = total.get((g, s), 0) + n
    assert total == {(g, s): n for g, n in (("a", 230), ("b", 37), ("c", 1), ("d", 20)) for s in range(60)}
    drawn = np.zeros((60, 230))
    for (g, s, k), n in rows.items():
        if g == "a":
            drawn[s, k] = n
    assert (drawn > 0).mean() == pytest.approx(1 - np.exp(-1), abs=0.02) and drawn.var() == pytest.approx(1, abs=0.06)


def test_split_metrics_from_its_weights(spark, pairs):
    """The block sums are the metrics of the very rows that ``split_weights`` draws."""
    got = {(r["g"], r["Sample"]): r for r in R.split_metrics(pairs, Y, P, by=["g"], key="k", samples=30, seed=5, block_rows=16).collect()}
    w = R.split_weights(pairs, ["g"], "k", [Y, P], samples=30, seed=5, block_rows=16).toPandas()
    assert len(got) == 120
    for (g, s), part in w.groupby(["g", "Sample"]):
        r, n = got[g, s], part["_weight"].to_numpy(float)
        mae, rae, r2 = R.weighted_metrics(part[Y].to_numpy(), part[P].to_numpy(), n)[:3]
        assert r["n"] == n.sum() and r["mae"] == pytest.approx(mae)
        assert (r["rae"], r["r2"]) == (pytest.approx(rae) if rae is not None else None, pytest.approx(r2) if r2 is not None else None)


def test_tasks_draw_what_the_join_draws(spark, pairs):
    """Groups in tasks, groups by the join, and both side by side give the same table."""
    table = lambda rows: {(r["g"], r["Sample"], r["Metric"]): r["Value"] for r in R.bootstrap_metrics(
        pairs, Y, P, by=["g"], key="k", samples=30, seed=2, group_rows=rows).collect()}
    inside, joined, mixed = table(1000), table(0), table(100)
    assert len(inside) == 4 * 30 * 5 and inside.keys() == joined.keys() == mixed.keys()
    for k, v in inside.items():
        for other in (joined[k], mixed[k]):
            assert (v is None) == (other is None) and (v is None or v == pytest.approx(other, abs=1e-9)), k
    assert inside["d", 0, "R2"] is None and inside["c", 0, "Kendall's Tau"] is None


def test_split_method_and_missing_values(spark, pairs):
    holes = pairs.unionByName(spark.createDataFrame([("a", 900, None, 1.0), ("b", 901, 1.0, None)], pairs.schema))
    run = lambda df, m: {tuple(r) for r in R.bootstrap_metrics(df, Y, P, by=["g"], key="k", samples=4, method=m).withColumn("Value", F.round("Value", 9)).collect()}
    for method in ("exact", "split"):
        assert run(holes, method) == run(pairs, method)
    assert {m for *_, m, _ in run(pairs, "split")} == {"MAE", "RAE", "R2"}
    assert run(pairs.limit(0), "exact") == run(pairs.limit(0), "split") == set()
    with pytest.raises(ValueError, match="method"):
        R.bootstrap_metrics(pairs, Y, P, by=["g"], key="k", method="other")


def test_poisson_in_tasks(spark):
    """Groups that fit a task are weighted there, by the same weights as row by row; NaN, null keys and null groups stay as they were."""
    from propspark.operators.resample import bootstrap_metrics

    rows = [(g, None if i == 3 else i, float(i * 7 % 11), float(i * 5 % 13)) for g in ("a", None) for i in range(40)]
    rows += [("b", 1, 2.0, 3.0), ("c", 1, None, 3.0), ("d", 1, float("nan"), 1.0), ("d", 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, key int, y double, p double")
    small, large = (bootstrap_metrics(df, "y", "p", by=["g"], key="key", samples=30, method="poisson", group_rows=n) for n in (1000, 0))
    assert "FlatMapGroupsInPandas" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "Sample" in small.columns and small.filter("g is null").count() == 30 * 5
    key = lambda r: (r["g"] or "", r["Sample"], r["Metric"])
    one, two = ({key(r): r["Value"] for r in d.collect()} for d in (small, large))
    assert one.keys() == two.keys()
    for k, v in one.items():
        assert v == two[k] or (v != v and two[k] != two[k]) or abs(v - two[k]) < 1e-9, k
