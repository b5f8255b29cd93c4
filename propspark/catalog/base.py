"""Shared helpers of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.session import ensure_checkpoint_dir
from propspark.sources.tables import read_table


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The given tables mark missing values by null and hold no NaN, so scans keep all pushed filters."""
    return read_table(spark, f"{root}/{name}.parquet", nan_as_null=False)


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, so that sums in another order still compare equal."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def scratch(spark: SparkSession) -> str:
    """A new folder for sink round trips below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/propspark-{uuid.uuid4().hex}"


def price_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every lineitem with a truth (its price) and a prediction (quantity times list price)."""
    part = table(spark, root, "part").select("p_partkey", "p_retailprice", "p_brand", "p_type")
    li = table(spark, root, "lineitem")
    return li.join(part, li.l_partkey == part.p_partkey).withColumn("y_pred", F.col("l_quantity") * F.col("p_retailprice")).withColumnRenamed(
        "l_extendedprice", "y_true")


PRICE_PAIRS = """(select l.*, p.p_brand, p.p_type, l_extendedprice as y_true, l_quantity * p_retailprice as y_pred
 from lineitem l join part p on l_partkey = p_partkey)"""


def fold_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Stored out-of-fold predictions: return flag as model, part type as feature set, line number as fold."""
    return price_pairs(spark, root).select(
        F.col("l_returnflag").alias("model"), F.col("p_type").alias("feature_set"), F.col("l_linenumber").alias("outer_fold"), "y_true", "y_pred")


FOLD_PAIRS = f"(select l_returnflag as model, p_type as feature_set, l_linenumber as outer_fold, y_true, y_pred from {PRICE_PAIRS})"
