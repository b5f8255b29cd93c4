"""Sharding by proportional stratified interleaving: every shard holds the sources in the mixture's proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key, ranked, seeded, text_of


def sharded(docs: DataFrame, n_shards: int = 16, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row ``doc_id``, ``source``, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows are shuffled by a seeded hash within their source; the row of rank r among n gets the fraction
    (r + u) / n, where u is a seeded offset of the source below 1, so that many small sources spread over the whole
    order. Rows sorted by fraction are cut into shards whose counts differ by one at most, and
    any run of the order holds each source in proportion. ``size`` is the UTF-8 length plus 1.

    A null source is a source of its own, a null text is empty. The order is by hash, id and checksum, so
    reruns agree; rows that are alike in all of these are interchangeable. An empty table gives an empty
    result.
    """
    keep = Stored(docs.sparkSession)
    text = text_of(text_col)
    rows = keep(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), group_key(F.col(id_col)).alias("_id"), group_key(F.col(source_col)).alias("_source")))
    n = rows.count()
    ties = ["_id", "text_crc32", "size"]
    mixed = ranked(rows, "_source", seeded(seed, "_source", "_id", "text_crc32", "size"), ties, n)
    offset = seeded(seed + 1, "_source") / F.lit(float(1 << 63))
    share = F.least((F.col("_rank") + offset) / F.col("_size"), F.lit(1 - 2.0**-53)).alias("_share")
    mixed = keep(mixed.select(*rows.columns, share, F.lit("all").alias("_all")))
    # 52 bits of the fraction as an even key; the sources' ties go by name, then hash.
    key = F.shiftleft(F.floor(F.col("_share") * F.lit(float(1 << 52))).cast("long"), 11)
    order = ["_share", "_source", *ties]
    placed = ranked(mixed, "_all", key, order, n)
    placed = placed.withColumn("shard", F.expr(f"(_rank * {n_shards}) div {max(n, 1)}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_rank") - first).alias("slot"))
