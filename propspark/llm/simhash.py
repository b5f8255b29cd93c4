"""SimHash fingerprints and near-duplicate classes by ball hashing in the middle.

Two fingerprints within an even radius r share a word at distance r / 2 from both. Each distinct
fingerprint emits its ball of half the radius, the balls are shuffled on their words, and all that meet
at a word lie within r of each other, so a star to the smallest of them keeps every connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key
from propspark.llm.components import connected_components


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``text_hash`` and ``fp``, a 64-bit fingerprint (as a signed long).

    The text is lower-cased (A-Z only) and split at ASCII white space; the shingles are runs of
    ``shingle`` words, repeats included, or all words where there are fewer. A bit is 1 if more than half
    of the shingles' XXH64 have it. Null and empty texts get 0. Very long texts are counted in blocks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd
        from xxhash import xxh64_intdigest

        block = 1 << 15

        def one(text: str | None) -> int:
            words = (text or "").encode().lower().split()
            if not words:
                return 0
            n = max(1, len(words) - shingle + 1)
            ones = np.zeros(64, np.int64)
            for at in range(0, n, block):
                part = words[at : min(at + block, n) + shingle - 1]
                grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
                hashes = np.array([xxh64_intdigest(g, seed) for g in grams], "<u8")
                ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])

        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "fp": [one(t) for t in part["text"]]})

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def ball_masks(half: int) -> list[int]:
    """All words of at most ``half`` bits, as signed longs."""
    found = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``a`` > ``b`` of distinct fingerprints (column ``fp``) within the radius that connect all such pairs.

    Only stars are given, not all pairs of a word. The radius is even; a word has at most as many
    members as a ball has words, however many fingerprints there are.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    masks = F.from_json(F.lit(str(ball_masks(radius // 2))), "array<bigint>")
    balls = nodes.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), "mask")
    if radius == 2:
        # At a word the flipped bits say which fingerprints met there, so a combinable "or" gathers them all.
        met = balls.groupBy("word").agg(F.bit_or("mask").alias("flips"), F.max(F.col("mask") == 0).alias("own"))
        met = met.filter(F.bit_count("flips") + F.col("own").cast("int") > 1)
        there = F.filter(masks, lambda m: F.when(m == 0, F.col("own")).otherwise(m.bitwiseAND(F.col("flips")) != 0))
        met = met.select(F.transform(there, lambda m: m.bitwiseXOR(F.col("word"))).alias("members"))
    else:
        met = balls.groupBy("word").agg(F.collect_set(F.col("word").bitwiseXOR(F.col("mask"))).alias("members")).filter(F.size("members") > 1)
    star = met.select(F.array_min("members").alias("b"), F.explode("members").alias("a"))
    return star.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b").distinct()


def classes(docs: DataFrame, *, radius: int = 2, **options) -> DataFrame:
    """Per row ``doc_id``, ``text_hash``, ``fp``, ``root`` (a fingerprint that names its class) and ``component_id``."""
    keep = Stored(docs.sparkSession)
    rows = keep(fingerprints(docs, **options))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Fingerprints are small but their balls are not, so they are dealt out again before they grow; by a
    # hash, as a second deal by the same key would be left out as redundant.
    spread = nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    roots = connected_components(links(spread, radius), "a", "b").withColumnRenamed("node", "fp")
    placed = keep(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable over links).

    Copies collapse to their fingerprint before any pairs are formed. Rows that repeat come out as often
    as they went in; a null id stays null and is no component's id unless all its ids are null. An empty
    table gives an empty result; other columns are not read. Options: those of ``classes`` and ``fingerprints``.
    """
    return classes(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) without near copies: each class keeps the row of its smallest id.

    ``rows`` has ``doc_id``, ``text_hash`` and ``root`` of every document. A null id counts as the largest.
    Of rows that share the kept id and text one stays, chosen by the hash of its other columns.
    """
    found = Stored(docs.sparkSession)(
        rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
        .select(group_key(F.col("k.doc_id")).alias("_id"), F.col("k.text_hash").alias("_hash")))
    rows = docs.select(
        F.struct("*").alias("_row"), group_key(F.col(id_col)).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    order = Window.partitionBy("_id", "_hash").orderBy("_other")
    return (
        rows.join(found, ["_id", "_hash"]).withColumn("_other", F.xxhash64("_row"))
        .withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") == 1).select("_row.*"))


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies, by the rule of ``one_of_each``. Options: those of ``classes``."""
    return one_of_each(docs, classes(docs, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
