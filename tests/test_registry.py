"""A sample of the registered queries against DuckDB on the smallest tables, and a look at their plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = ("lookup_join", "dedup_prefer", "dedup_min_keep", "histogram", "pivot_macro", "harvested", "standardized_keys", "substructure_bits",
          "dual_ad_table", "group_folds", "time_splits", "kendall_tied", "domain_errors", "nested_cv_scores",
          "dedup_prefer_text", "dedup_median", "scored_gaps", "scoring_facts", "ad_sink", "holdout_group", "holdout_time", "pca_variance", "rank_pvalues", "projection")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as from '{sf}/{f}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    flat = lambda rows: sorted(repr([0.0 if v == 0 and isinstance(v, float) else v for v in r]) for r in rows)
    assert flat(df.select(*[f"`{c}`" for c in cols]).collect()) == flat(cur.fetchall())
