"""Session helpers: a tuned local session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(app: str = "propspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings this package relies on; on a cluster the submitted settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local master may fall back to a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="propspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back, so that later plans see fixed rows.

    Parquet keeps the table narrow for plans that need some of its columns. It is removed when the driver
    ends. Rows whose columns share a name, which Parquet cannot hold, go through a reliable checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if len({c.lower() for c in df.columns}) < len(df.columns) or not df.columns:
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _bytes_of(field: T.StructField) -> Column:
    """About how many bytes a value takes in memory."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) * 4 + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20, max_estimate: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the frame is shown to be small in rows and bytes.

    The optimizer's upper estimate decides where it is low, so the plan is not run for that; otherwise rows
    and bytes of at most ``max_rows`` + 1 rows are counted. Beyond the limits the frame is returned as it is
    and Spark picks a shuffled join with AQE skew handling.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= max_estimate:
        return F.broadcast(df)
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0)).cast("long")
    rows, held = df.select(size.alias("_b")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("_b")).first()
    return F.broadcast(df) if rows <= max_rows and (held or 0) <= max_bytes else df
