"""Ranks of rows where they lie in sorted ranges, against plain ranks of whole columns."""

import numpy as np
import pandas as pd
import pytest

from propspark.operators import metrics as M
from propspark.operators import ordered


@pytest.fixture(scope="module")
def rows():
    """A hot value that spans many ranges, a group of one value, a missing group key, weights."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 900, 3000)).astype(float)
    x[5] = np.nan
    g = rng.choice(["a", "b", None], 3000, p=[0.6, 0.3, 0.1])
    frame = pd.DataFrame({"g": g, "y": x, "p": np.round(x / 100 + rng.integers(0, 40, 3000)), "w": rng.integers(1, 5, 3000)})
    frame.loc[frame["p"].isna(), "p"] = 3.0
    return pd.concat([frame, pd.DataFrame({"g": "flat", "y": 1.0, "p": rng.integers(0, 9, 60).astype(float), "w": 1})], ignore_index=True)


def test_centred_ranks(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rows = rows.assign(_g=rows["g"].fillna("none").astype("category").cat.codes.astype("int64"), id=range(len(rows)))
    df = spark.createDataFrame(list(rows[["_g", "y", "w", "id"]].itertuples(index=False, name=None)), "_g long, y double, w int, id long")
    got = {r["id"]: r["r"] for r in ordered.centred_ranks(df, "_g", "y", "w", "r", ["id"]).collect()}
    assert len(got) == len(rows)
    for _, part in rows.groupby("_g"):
        spread = part.loc[part.index.repeat(part["w"])]
        ranks = spread["y"].fillna(np.inf).rank(method="average")
        want = (ranks - (len(spread) + 1) / 2).groupby(spread["id"]).first()
        assert {i: got[i] for i in want.index} == want.to_dict()


def test_large_groups_are_ranked_without_a_table_of_values(spark, rows, monkeypatch):
    """No join of all rows with their values' ranks, and the rho of groups that fit a task."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 200)
    clean = rows.dropna(subset=["y"])
    df = spark.createDataFrame(list(clean.itertuples(index=False, name=None)), "g string, y double, p double, w int")
    asked = []
    monkeypatch.setattr(M, "join_counted", lambda *a, join=M.join_counted, **k: asked.append(a) or join(*a, **k))
    kw = dict(metrics=["spearman_rho", "spearman_pvalue"], by=["g"], weight="w")
    large = {r["g"]: r for r in M.metric_table(df, "y", "p", leaf=20, **kw).collect()}
    small = {r["g"]: r for r in M.metric_table(df, "y", "p", **kw).collect()}
    assert not asked and large.keys() == small.keys() == {"a", "b", None, "flat"}
    for g, r in small.items():
        assert large[g]["n"] == r["n"] and large[g]["spearman_rho"] == pytest.approx(r["spearman_rho"], abs=1e-12)
        assert large[g]["spearman_pvalue"] == pytest.approx(r["spearman_pvalue"], abs=1e-9)
    assert large["flat"]["spearman_rho"] == 0


def test_tau_is_counted_only_where_it_is_asked_for(monkeypatch):
    x, y, w = np.arange(9.0), np.arange(9.0)[::-1], np.ones(9)
    with_tau = M.rank_sums(x, y, w)
    monkeypatch.setattr(M, "net_order", lambda *a: pytest.fail("pairs were counted"))
    assert M.rank_sums(x, y, w, False)[1:] == with_tau[1:]
