"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row per node that has an edge: ``node``, ``root`` (the smallest node that it reaches).

    Every step is a grouping with map-side combine and a join that Spark may split at a hot node. The
    edges of a step are stored, so a lost executor costs one step at most. Self edges, repeated edges and
    edges with a null end are ignored; without edges the result is empty.
    """
    keep = Stored(edges.sparkSession)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v"))
    now, path = keep.put(pairs.distinct())
    seen = _checksum(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large, large_path = keep.put(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after, after_path = keep.put(small.distinct())
        keep.drop(path)
        keep.drop(large_path)
        found = _checksum(after)
        now, path = after, after_path
        if found == seen:
            break
        seen = found
    root = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(root)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
