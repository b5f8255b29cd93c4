"""Shared pieces of the corpus operators: word splitting, stored intermediate tables, ranks without a large window."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propspark.session import ensure_checkpoint_dir

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(col: str | Column = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text that is not null, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def group_key(col: Column) -> Column:
    """A string that is never null and tells a missing value from every text."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


class Stored:
    """Tables below the shared checkpoint folder: every task rereads them, whichever executors are lost.

    ``drop`` removes a table that is no longer read; what remains goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, spark.sparkContext.getCheckpointDir()

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.put(df)[0]

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._fs(path)[0].deleteOnExit(self._fs(path)[1])
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), where


def cell_bits(n_rows: int) -> int:
    """Bits of a uniform key that make about four times the square root of ``n_rows`` cells.

    Both the cells of a group and the rows of a cell then grow with the square root of the input, and
    neither the window over cells nor the one inside a cell holds a share of the data.
    """
    return max(4, math.ceil(math.log2(max(n_rows, 1)) / 2) + 2)


def ranked(df: DataFrame, group: str, key: Column, ties: list[str], n_rows: int, weight: Column | None = None) -> DataFrame:
    """Add, within each ``group`` (a column without nulls) and in the order of an even 63-bit key of at least 0:

    ``_rank`` (from 0), ``_size`` (rows of the group), ``_before`` (the weight of the rows before) and
    ``_total`` (the group's weight). Rows that agree in key and ``ties`` should be alike in all columns.
    A hot group is spread over its cells, so no task sorts a whole group.
    """
    bits = cell_bits(n_rows)
    rows = df.withColumn("_key", key).withColumn("_cell", F.shiftright("_key", 63 - bits).cast("int")).withColumn(
        "_weight", F.lit(1).cast("long") if weight is None else weight)
    cells = rows.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_weight").alias("_w"))
    earlier = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    cells = cells.select(
        group, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
        F.sum("_n").over(whole).alias("_size"), F.sum("_w").over(whole).alias("_total"))
    inside = Window.partitionBy(group, "_cell").orderBy("_key", *ties)
    return rows.join(cells, [group, "_cell"]).select(
        *df.columns, "_size", "_total",
        (F.col("_n0") + F.row_number().over(inside) - 1).alias("_rank"),
        (F.col("_w0") + F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight")).alias("_before"))


def seeded(seed: int, *cols: str | Column) -> Column:
    """An even 63-bit key of a seed and columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)
