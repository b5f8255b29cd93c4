"""Packing by powers of two: every document is cut into pieces of binary length, one piece to a sequence.

A document's length is written in binary, after as many whole windows as it holds. Each piece is a
sequence of its own, pieces of one length share a bucket and are numbered together, so batches of a
bucket need no padding and no sequence crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key, ranked, seeded


def pieces(docs: DataFrame, vocabulary: str, ranks: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Per piece ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, where asked for, ``ids``.

    ``vocabulary`` (a tokenizers file) defines the ids; ``ranks`` is the same vocabulary as byte ranks.
    Texts of Latin letters take the rank encoder, which gives the same ids about five times as fast; texts
    with other scripts or an added token's string take the defining one. Every document ends with
    ``end_id``, so an empty or null text is one piece of one token. Texts are encoded one at a time.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import json
        import re
        import zlib

        import numpy as np
        import pandas as pd
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        # The word pattern of this vocabulary; a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        other = re.compile("[^\\t\\n\\r -~\\u00a1-\\u024f\\u2010-\\u2027\\u20ac]" + "".join("|" + re.escape(t) for t in added))
        exact: list[Tokenizer] = []

        def ids_of(text: str | None) -> np.ndarray:
            if not text:
                return np.array([end_id], "<u4")
            if other.search(text):
                if not exact:
                    exact.append(Tokenizer.from_file(vocabulary))
                ids = exact[0].encode(text, add_special_tokens=False).ids
            else:
                ids = fast.encode_to_numpy(text, disallowed_special=())
            return np.append(np.asarray(ids, "<u4"), np.uint32(end_id)).astype("<u4")

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for part in batches:
            out: list[tuple] = []
            for doc, text in zip(part["doc_id"], part["text"]):
                ids, at = ids_of(text), 0
                rest = len(ids) % window
                for n in [window] * (len(ids) // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]:
                    own = ids[at : at + n]
                    out.append((doc, at, n, zlib.crc32(own.tobytes()), len(ids), *([own.astype("int32")] if with_ids else [])))
                    at += n
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shape = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return src.mapInPandas(run, shape + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, vocabulary: str, ranks: str, **options) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` (0: a piece is a whole sequence).

    Sequences are numbered without gaps, longest bucket first, inside a bucket by a seeded hash. The
    numbers are the same in every run; rows that repeat get numbers of their own. An empty table gives an
    empty result.
    """
    rows = Stored(docs.sparkSession)(pieces(docs, vocabulary, ranks, **options))
    # At most one row for each power of two up to the window.
    sizes = rows.groupBy("length").count().orderBy(F.desc("length")).collect()
    first, starts = 0, F.lit(None).cast("long")
    for r in sizes:
        starts = F.when(F.col("length") == r["length"], F.lit(first)).otherwise(starts)
        first += r["count"]
    keyed = rows.withColumn("_bucket", F.col("length").cast("string")).withColumn("_doc", group_key(F.col("doc_id")))
    key = seeded(17, "_doc", F.col("start"), F.col("ids_crc32"))
    placed = ranked(keyed, "_bucket", key, ["_doc", "start", "ids_crc32", "doc_tokens"], first)
    return placed.select(*rows.columns, (starts + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
