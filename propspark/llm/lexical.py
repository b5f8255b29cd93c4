"""Ranked lexical search over hashed max-sketches.

A term's impact grows with its count in a document and with nothing else there, so a sketch keeps, for each
coordinate that terms are hashed to, the largest count; its impact is the coordinatewise maximum of the
impacts. A batch of documents is a matrix of such maxima; the weights of an item's terms, looked up in it,
give an upper bound of every score. Documents are scored exactly in the order of falling bounds, until the
next bound cannot enter the item's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from propspark.llm.common import LOWER, UPPER, Stored, text_of
from propspark.session import broadcast_if_small

#: What separates terms: ASCII but for digits and letters.
BREAKS = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
#: Item terms of a block of queries that searches the index together; it bounds what a task holds of them.
BLOCK_TERMS = 100_000


def terms_of(text: Column) -> Column:
    """All terms of a text that is not null, A-Z lower-cased, in order."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), f"[{BREAKS}]+"), "")


def indexed(docs: DataFrame, *, width: int = 1 << 14, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n`` (terms with repeats), ``terms`` (distinct ones, by spaces), their ``counts``, ``coords`` and ``peaks``.

    ``coords`` (16 bits each) are the coordinates below ``width`` that the terms are hashed to, ``peaks`` the
    largest count at each. Counts take 8, 16 or 32 bits, as their largest needs (``whole_numbers`` reads them).
    A null or empty text has no terms.
    """
    if not 0 < width <= 1 << 16:
        raise ValueError("the width must lie between 1 and 65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        from xxhash import xxh64_intdigest

        def packed(numbers, n: int) -> bytes:
            m = np.fromiter(numbers, "<u4", n)
            return m.astype(f"<u{1 if m.max(initial=0) < 1 << 8 else 2 if m.max() < 1 << 16 else 4}").tobytes()

        term = re.compile(f"[^{BREAKS}]+")
        place: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, terms, counts, coords, peaks = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    found = Counter(term.findall((text or "").encode().lower().decode()))
                    sketch: dict[int, int] = {}
                    for t, n in found.items():
                        c = place.get(t)
                        if c is None:
                            if len(place) > 500_000:
                                place.clear()
                            c = place[t] = xxh64_intdigest(t, seed) % width
                        if sketch.get(c, 0) < n:
                            sketch[c] = n
                    sizes.append(sum(found.values()))
                    terms.append(" ".join(found))
                    counts.append(packed(found.values(), len(found)))
                    coords.append(np.fromiter(sketch, "<u2", len(sketch)).tobytes())
                    peaks.append(packed(sketch.values(), len(sketch)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.binary()), pa.array(coords, pa.binary()), pa.array(peaks, pa.binary())],
                    ["doc_id", "n", "terms", "counts", "coords", "peaks"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n long, terms string, counts binary, coords binary, peaks binary")


def whole_numbers(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a column of counts or peaks."""
    return np.frombuffer(packed, f"<u{len(packed) // n if n else 1}").astype("i8")


def _searcher(items: list, item_type: pa.DataType, words: list[list[tuple[str, int, int]]], floors: list[int], k: int) -> Callable:
    """A function that finds, in the index rows of a task, the ``k`` best of each item (it travels with its task).

    ``words`` has each item's (term, coordinate, weight), ``floors`` a score that the item's last result reaches for sure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import insort

        used = sorted({c for own in words for _, c, _ in own})
        row_of = np.full(1 << 16, -1)
        row_of[used] = np.arange(len(used))
        lookups = [(row_of[[c for _, c, _ in own]], np.array([w for _, _, w in own], "f8")) for own in words]
        width = 512
        # Whole numbers below 2^53, so the sums are exact.
        maxima = np.zeros((len(used), width))
        best: list[list[tuple]] = [[] for _ in items]
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                rows = part.num_rows
                sizes = part.column("m").to_numpy()
                coords = [np.frombuffer(x, "<u2") for x in part.column("coords").to_pylist()]
                docs = np.repeat(np.arange(rows), [len(c) for c in coords])
                where = row_of[np.concatenate(coords)]
                peak = np.concatenate([whole_numbers(x, len(c)) for x, c in zip(part.column("peaks").to_pylist(), coords)])
                known = where >= 0
                where, docs, peak = where[known], docs[known], peak[known]
                maxima[where, docs] = (1_000_000_000 * peak) // (1000 * peak + 8 * sizes[docs])
                ids = [(x is None, x) for x in part.column("doc_id").to_pylist()]
                nth = np.empty(rows, "i8")
                nth[sorted(range(rows), key=lambda i: (ids[i][0], 0 if ids[i][0] else ids[i][1]))] = np.arange(rows)
                held: dict[int, dict] = {}
                for item, (at_rows, weights) in enumerate(lookups):
                    bounds = weights @ maxima[at_rows, :rows]
                    top, own = best[item], words[item]
                    floor = max(floors[item], 1, -top[-1][0] if len(top) == k else 0)
                    open_ = np.flatnonzero(bounds >= floor)
                    for d in open_[np.lexsort((nth[open_], -bounds[open_]))].tolist():
                        entry = (-int(bounds[d]), *ids[d])
                        if len(top) == k and not entry < top[-1]:
                            break
                        if d not in held:
                            terms = part.column("terms")[d].as_py().split(" ")
                            held[d] = dict(zip(terms, whole_numbers(part.column("counts")[d].as_py(), len(terms)).tolist()))
                        m, has = int(sizes[d]), held[d]
                        score = sum(w * (1_000_000_000 * has[t] // (1000 * has[t] + 8 * m)) for t, _, w in own if t in has)
                        if score >= floor:
                            insort(top, (-score, *ids[d]))
                            del top[k:]
                maxima[where, docs] = 0
        found = [(items[i], e[2], -e[0]) for i, top in enumerate(best) for e in top]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], item_type), pa.array([x[1] for x in found], kind), pa.array([x[2] for x in found], pa.int64())],
                ["item_id", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, width: int = 1 << 14, seed: int = 42, first_share: int = 64, block_terms: int = BLOCK_TERMS,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item its ``k`` best documents with a score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Scores are those of the module's contract: whole numbers from term counts, document lengths and
    document frequencies over all rows. Equal scores go by id, a null id last. Every row is a document,
    also if it repeats; rows of one item id, null included, are one item with the terms of all. Null and
    empty texts have no terms; items without a term of the table, and empty tables, give no rows.

    Items are searched in blocks of about ``block_terms`` terms. A first pass over one in ``first_share``
    documents finds scores that the last results reach, so that the pass over all returns little more
    than ``k`` rows for each item, however many tasks there are.
    """
    spark = docs.sparkSession
    keep = Stored(spark)
    index = keep(indexed(docs, width=width, seed=seed, id_col=id_col, text_col=text_col))
    n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(terms_of(text_of(item_text_col)))).alias("term")).distinct()
    asked = keep(asked)
    held = index.select(F.explode(F.split("terms", " ")).alias("term")).join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
    held = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = keep(asked.join(held, "term").select("item_id", "term", weight.alias("w")))
    n_blocks = max(1, -(-weighted.count() // block_terms))
    m = F.expr(f"10 + (cast(n as decimal(38, 0)) * {90 * n_docs}) div {max(1, n_terms)}").alias("m")
    rows = index.filter("n > 0").select("doc_id", m, "terms", "counts", "coords", "peaks")
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(first_share)) == 0)
    kinds = weighted.schema["item_id"].dataType, rows.schema["doc_id"].dataType
    shape = f"item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score long"
    item_type, out = to_arrow_type(kinds[0]), None
    for block in range(n_blocks):
        # About ``block_terms`` rows reach the driver at a time.
        mine = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        mine = mine.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("all")).collect()
        names, words = [r["item_id"] for r in mine], [_placed(r["all"], width, seed) for r in mine]
        first = _best(sample.mapInArrow(_searcher(names, item_type, words, [0] * len(names), k), shape), k)
        reached = {r["item_id"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}
        found = rows.mapInArrow(_searcher(names, item_type, words, [reached.get(x, 0) for x in names], k), shape)
        out = found if out is None else out.unionByName(found)
    return _best(out, k).select("item_id", "rank", "doc_id", "score")


def _placed(own: list, width: int, seed: int) -> list[tuple[str, int, int]]:
    from xxhash import xxh64_intdigest

    return [(r["term"], xxh64_intdigest(r["term"], seed) % width, r["w"]) for r in own]


def sql(k: int = 10) -> str:
    """DuckDB SQL of ``search`` over ``documents`` and ``benchmark`` by scoring every pair that shares a term."""
    found = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BREAKS}]+'))"
    return rf"""
with t as (select doc_id, term, count(*) as tf from (select doc_id, {found} as term from documents) group by all),
d as (select doc_id, sum(tf)::bigint as n from t group by doc_id),
g as (select count(*) as docs, sum(n)::bigint as terms from d),
q as (select distinct item_id, {found} as term from benchmark),
f as (select term, count(*) as df from t where term in (select term from q) group by term),
w as (select item_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from q join f using (term), g),
m as (select doc_id, 10 + (90 * n * docs) // terms as m from d, g),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from w join t using (term) join m using (doc_id) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify rank <= {k}"""
