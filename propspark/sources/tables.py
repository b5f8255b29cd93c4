"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.session import cut_lineage

# Names under which a row-number column leaks into files that were written with their index.
INDEX_COLUMNS = ("_c0", "Unnamed: 0")


def require_columns(df: DataFrame, *cols: str, label: str = "columns") -> DataFrame:
    """Plan-time check; runs no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing {label}: {missing}")
    return df


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing in every floating column (Spark's avg and max would spread NaN)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_table(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    fmt: str | None = None,
    required: Iterable[str] = (),
    drop_index_columns: bool = True,
    nan_as_null: bool = True,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan a parquet, CSV, JSON or ORC table.

    CSV wants an explicit schema (no inference pass over the data); without one, columns stay text.
    ``nan_as_null`` keeps filters on floating columns from reaching the parquet scan, so switch it off for
    tables that are known to hold no NaN.
    """
    fmt = fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None and drop_index_columns:
            reader = reader.option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if drop_index_columns:
        df = df.drop(*[c for c in INDEX_COLUMNS if c in df.columns])
    require_columns(df, *required)
    return nan_to_null(df) if nan_as_null else df


def spread_scan(df: DataFrame, key: str, *, row_group_bytes: int = 128 << 20) -> DataFrame:
    """Give a CPU-heavy stage enough tasks when the files below it are few and small.

    A row group cannot be split, so a small table may arrive in a single task. Inputs with at least one
    row group of usual size per core are returned as they are: at scale this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(f)
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
    return df if size >= cores * row_group_bytes else df.repartition(cores, key)


def write_table(
    df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite", partition_by: Iterable[str] = ()
) -> str:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by := list(partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_buckets(df: DataFrame, path: str, bucket_col: str, *, fmt: str = "parquet") -> str:
    """One folder per category. Categories without rows show up in the count report, not as empty files."""
    require_columns(df, bucket_col)
    return write_table(df, path, fmt=fmt, partition_by=[bucket_col])


def write_split(df: DataFrame, condition: Column, yes_path: str, no_path: str, *, fmt: str = "parquet") -> None:
    """Write the rows that meet ``condition`` to one sink and all the others to another.

    The frame is stored once with a flag below the checkpoint folder, so its plan runs once, also where executors
    are lost in between; null counts as "not met".
    """
    flagged = cut_lineage(df.withColumn("_met", F.coalesce(condition, F.lit(False))))
    write_table(flagged.filter("_met").drop("_met"), yes_path, fmt=fmt)
    write_table(flagged.filter("NOT _met").drop("_met"), no_path, fmt=fmt)


def lookup_table(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Distinct id to name pairs, missing names as empty text."""
    return df.select(F.col(id_col), F.coalesce(F.col(name_col), F.lit("")).alias(name_col)).distinct()


def write_lookup(df: DataFrame, id_col: str, name_col: str, path: str, *, fmt: str = "csv") -> str:
    return write_table(lookup_table(df, id_col, name_col).orderBy(id_col), path, fmt=fmt)


def write_artifacts(tables: Mapping[str, DataFrame], root: str, *, partition_by: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """Write several named result tables below one folder."""
    parts = dict(partition_by or {})
    return {name: write_table(df, f"{root}/{name}", partition_by=parts.get(name, ())) for name, df in tables.items()}
