"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, so equal passages are cut alike wherever they
stand. Chunks are deduplicated once over the whole table, and their keys become identifiers only after
contents of one key have been compared. A document is then the ordered list of its identifiers; these short
lists are grouped and joined, the texts themselves are never moved whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import LOWER, UPPER, Stored, group_key
from propspark.sources.tables import is_empty


def _chunker(mean: int, key_bytes: int, seed: int) -> Callable:
    """A function from a text to its chunks as (key, content) in order (it travels with its task).

    Only A-Z are lower-cased. A cut lies behind a byte whose 32-byte rolling hash ends in zeros; chunks
    have a quarter to eight times ``mean`` bytes, the last one may be shorter. An empty text is one empty chunk.
    """
    low, high = max(1, mean // 4), 8 * mean

    def of(text: str | None) -> list[tuple[bytes, bytes]]:
        import numpy as np
        from xxhash import xxh3_128_digest

        def key(chunk: bytes) -> bytes:
            return b"".join(xxh3_128_digest(chunk, seed + i) for i in range((key_bytes + 15) // 16))[:key_bytes]

        data = (text or "").encode().lower()
        ends, last = [], 0
        if len(data) > low:
            gear = np.random.default_rng(seed).integers(0, 1 << 32, 256, "u4")
            rolling, reach = gear[np.frombuffer(data, "u1")], 1
            while reach < 32:
                rolling[reach:] = rolling[reach:] + (rolling[:-reach] << np.uint32(reach))
                reach *= 2
            for end in [*(np.flatnonzero(rolling >> np.uint32(32 - (mean - 1).bit_length()) == 0) + 1).tolist(), len(data)]:
                while end - last > high:
                    last += high
                    ends.append(last)
                if end - last >= low:
                    last = end
                    ends.append(last)
        if last < len(data) or not ends:
            ends.append(len(data))
        chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
        return [(key(c), c) for c in chunks]

    return of


def colliding_keys(docs: DataFrame, *, mean: int = 2048, key_bytes: int = 16, seed: int = 42, text_col: str = "text") -> DataFrame:
    """Keys that more than one chunk content has: ``key``, ``contents``.

    Each content of a partition is moved once, and not again when the contents of a key are counted.
    """
    of = _chunker(mean, key_bytes, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for part in batches:
            yield pd.DataFrame(list({c for text in part["text"] for c in of(text)}), columns=["key", "content"])

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key binary, content binary").distinct()
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")


def verified_key_bytes(docs: DataFrame, *, key_bytes: int = 16, **options) -> int:
    """The key length, doubled until no two chunk contents of the table share a key."""
    while not is_empty(colliding_keys(docs, key_bytes=key_bytes, **options)):
        key_bytes *= 2
    return key_bytes


def recipes(docs: DataFrame, *, mean: int = 2048, key_bytes: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``recipe`` (the keys of its chunks in order) and ``text_sha256`` of the normalised text."""
    of = _chunker(mean, key_bytes, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        import pandas as pd

        for part in batches:
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "recipe": [b"".join(k for k, _ in of(t)) for t in part["text"]],
                "text_sha256": [sha256((t or "").encode().lower()).hexdigest() for t in part["text"]]})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, recipe binary, text_sha256 string")


def exact_duplicates(docs: DataFrame, *, mean: int = 2048, key_bytes: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays; a null id counts as smallest. Of rows that agree in text and
    id one stays. Very long texts are lists of many chunks; an empty table gives an empty result; other
    columns are not read. Keys are lengthened until no two contents share one, so equal lists are equal texts.
    """
    own = {"mean": mean, "seed": seed, "text_col": text_col}
    size = verified_key_bytes(docs, key_bytes=key_bytes, **own)
    keep = Stored(docs.sparkSession)
    # The row's number is fixed once the table is written.
    rows = keep(recipes(docs, key_bytes=size, id_col=id_col, **own).withColumn("_nth", F.monotonically_increasing_id()))
    # Stored, so that the join reads plain shuffles, of which Spark splits a hot group.
    groups = keep(rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_nth")).alias("_last")))
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("_last.doc_id").alias("keep_id"), "group_size", (F.col("_nth") == F.col("_last._nth")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents (all columns) that stay. Of rows that agree in id and text one stays, by the hash of its other columns."""
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    found = Stored(docs.sparkSession)(found.select(group_key(F.col("doc_id")).alias("_id"), F.col("text_sha256").alias("_sha")))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.struct("*").alias("_row"), group_key(F.col(id_col)).alias("_id"), F.sha2(text, 256).alias("_sha"))
    order = Window.partitionBy("_id", "_sha").orderBy("_other")
    return (
        rows.join(found, ["_id", "_sha"]).withColumn("_other", F.xxhash64("_row"))
        .withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("_row.*"))


def sql() -> str:
    """DuckDB SQL of ``exact_duplicates`` where ids are unique."""
    return f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as words from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(words) as text_sha256
from t window same as (partition by words)"""
