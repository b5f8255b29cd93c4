"""Mixes of sources with very long documents, and of many sources."""

import random
import time

import pytest
from pyspark.sql import functions as F

from propspark.llm import mixing


@pytest.mark.parametrize("seed", range(4))
def test_gap_after_a_long_document(spark, seed):
    """One document holds a third of a source's words; the short ones still bring it to its target."""
    rows = [(0, "a", 500)] + [(i, "a", 5 + i % 11) for i in range(1, 101)] + [(i, "b", 10) for i in range(101, 201)]
    docs = spark.createDataFrame([(i, str(i), s, n) for i, s, n in rows], "doc_id long, text string, source string, size long")
    weights = lambda s: {"a": 1, "b": 2}
    got = mixing.mixed(docs, F.col("size"), weights=weights, seed=seed).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 15 for r in got)


def test_many_sources(spark):
    """20,000 sources of their own weight, without a row for each on the driver; every one comes near its target."""
    rows = spark.range(20_000).select(
        F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("k"), F.format_string("s%05d", "id").alias("source"), (1 + F.col("id") % 50).alias("size"))
    docs = rows.select(F.monotonically_increasing_id().alias("doc_id"), F.concat("source", F.col("k").cast("string")).alias("text"), "source", "size")
    began = time.perf_counter()
    got = mixing.mixed(docs, F.col("size")).join(docs.select("doc_id", "source"), "doc_id")
    got = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size"), F.first("source_size").alias("own")).toPandas()
    assert time.perf_counter() - began < 120
    assert len(got) == 20_000 and (got["target"] <= 3 * got["own"]).all() and got["target"].sum() == pytest.approx(got["own"].sum())
    assert ((got["taken"] - got["target"]).abs() <= got["size"] / 2 + 1).all()


def test_flow_of_many_patterns():
    """Overlapping patterns by the thousand stay a matter of seconds."""
    rng = random.Random(1)
    names = [f"s{i}" for i in range(500)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 3)))): rng.randint(1, 10**6) for _ in range(8_000)}
    targets = dict.fromkeys({s for p in patterns for s in p}, 12_000_000)
    began = time.perf_counter()
    give = mixing.route(patterns, targets)
    assert time.perf_counter() - began < 60
    assert all(g <= 3 * patterns[p] for p, g in give.items()) and 0.99 * sum(targets.values()) <= sum(give.values()) <= sum(targets.values())
