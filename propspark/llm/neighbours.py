"""Nearest neighbours by inner product over stable projections in a kd-tree.

Vectors get one more component that makes all lengths equal, so the largest inner product is the
smallest Euclidean distance. A few Gaussian (2-stable) projections of them are cut into blocks by a
kd-tree; a query looks at the blocks, and inside them at the kd-leaves, by their projected distance and
verifies true products until a chi-square test says that what is left is unlikely to be nearer.

The projected distance of two vectors is their distance times a chi-square variable. With the k-th best
distance d so far, a point at projected distance D or more lies within d by a chance of at most
1 - chi2(D^2 / d^2), so a query stops where D^2 > d^2 * quantile(confidence).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import Stored, seeded


def chi2_quantile(p: float, degrees: int) -> float:
    """The quantile of the chi-square distribution with an even number of degrees, by bisection."""
    if degrees % 2 or degrees < 2:
        raise ValueError("the number of projections must be even")

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for k in range(degrees // 2):
            total += term
            term *= x / 2 / (k + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def split_plan(points: np.ndarray, leaves: int) -> list[tuple[int, int, float]]:
    """Cuts (node, axis, value) of a kd-tree: node n has the children 2n + 1 (at most the value) and 2n + 2.

    The widest axis is cut at its median. A node whose points all agree is not cut.
    """
    cuts, open_ = [], [(0, points, leaves)]
    while open_:
        node, own, n = open_.pop()
        if n < 2 or len(own) < 2:
            continue
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        value = float(np.median(own[:, axis]))
        if value >= own[:, axis].max():
            below = own[:, axis][own[:, axis] < value]
            if not len(below):
                continue
            value = float(below.max())
        left = own[:, axis] <= value
        cuts.append((node, axis, value))
        open_ += [(2 * node + 1, own[left], n // 2), (2 * node + 2, own[~left], n - n // 2)]
    return cuts


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part.

    Left out are null, empty and zero vectors, those with a null or non-finite component, and those
    whose length is not the most frequent one (ties: the longest).
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["d"] if size else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, *, projections: int = 8, confidence: float = 0.97, sample: int = 20_000, seed: int = 3,
            queries_per_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest found for each row that ``is_query`` (a column of ``vec_id``) picks.

    Every row is indexed; the tree's cuts come from at most ``sample`` rows, the first by a seeded hash.
    Blocks hold about eight times the square root of the number of rows; rows that no cut tells apart,
    such as copies, are dealt to several blocks by their id. Queries of a block are taken
    ``queries_per_block`` at a time. Round one searches a query's own leaf for a first bound, round
    two all leaves that the test does not rule out. Scores are double sums in a fixed order, so copies
    tie exactly; ties go to the smaller id. Ids should be distinct and not null: rows without an id
    take no part. Fewer candidates than ``k`` give all of them; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    keep = Stored(spark)
    rows = keep(valid_vectors(vectors, id_col, vector_col).filter("vec_id is not null"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top, dim = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    matrix = np.random.default_rng(seed).standard_normal((dim + 1, projections))
    reach = chi2_quantile(confidence, projections)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for part in batches:
            if len(part):
                v = np.stack(part["v"].to_numpy())
                p = v @ matrix[:-1] + np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None] * matrix[-1]
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "p": list(p)})

    placed = rows.mapInPandas(projected, "vec_id long, v array<double>, p array<double>")
    first = placed.select("vec_id", "p", seeded(seed, "vec_id").alias("h")).orderBy("h", "vec_id").limit(sample).select("p").toPandas()
    per_block = max(256, int(8 * math.sqrt(n)))
    cuts = split_plan(np.stack(first["p"].to_numpy()), max(1, min(math.ceil(n / per_block), max(1, len(first) // 16))))
    tree = {node: (axis, value) for node, axis, value in cuts}

    def leaf_of(p: np.ndarray) -> np.ndarray:
        import numpy as np

        out, open_ = np.zeros(len(p), np.int64), [(0, np.arange(len(p)))]
        while open_:
            node, own = open_.pop()
            if node not in tree or not len(own):
                out[own] = node
                continue
            axis, value = tree[node]
            left = p[own, axis] <= value
            open_ += [(2 * node + 1, own[left]), (2 * node + 2, own[~left])]
        return out

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for part in batches:
            if len(part):
                yield part.assign(leaf=leaf_of(np.stack(part["p"].to_numpy())))

    indexed = keep(placed.mapInPandas(leaves, "vec_id long, v array<double>, p array<double>, leaf long"))
    # One row per leaf: its number of rows and the box of its projections.
    box = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for i in range(projections) for name, f in (("low", F.min), ("high", F.max))]
    facts = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *box).orderBy("leaf").toPandas()
    leaf_ids, sizes = facts["leaf"].to_numpy(), facts["n"].to_numpy()
    lows, highs = (facts[[f"{b}{i}" for i in range(projections)]].to_numpy() for b in ("low", "high"))
    parts = np.maximum(1, np.ceil(sizes / (1.5 * per_block)).astype(np.int64))
    salts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(leaf_ids, parts)], "leaf long, parts long")
    blocks = keep(indexed.join(F.broadcast(salts), "leaf").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts"))
    wanted = keep(indexed.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v"))
    n_queries = wanted.count()
    slices = max(1, math.ceil(n_queries / queries_per_block))

    def routed(source: DataFrame, shut: bool) -> DataFrame:
        """A row per query and block that it has to see: its own leaf first, later the leaves within its bound."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np
            import pandas as pd

            for part in batches:
                if not len(part):
                    continue
                q = np.stack(part["v"].to_numpy())
                p = q @ matrix[:-1]
                limit = part["bound"].to_numpy() * reach
                for at in range(0, len(part), 256):
                    own = p[at : at + 256]
                    gap = np.maximum(np.maximum(lows[None] - own[:, None], own[:, None] - highs[None]), 0)
                    far = (gap * gap).sum(axis=2)
                    home = far.argmin(axis=1)
                    see = np.zeros(far.shape, bool) if not shut else far <= limit[at : at + 256, None]
                    see[np.arange(len(own)), home] = not shut
                    row, leaf = np.nonzero(see)
                    if not len(row):
                        continue
                    many = parts[leaf]
                    row, leaf = np.repeat(row, many), np.repeat(leaf, many)
                    salt = np.concatenate([np.arange(m) for m in many])
                    ids = part["query_id"].to_numpy()[at : at + 256]
                    yield pd.DataFrame({"query_id": ids[row], "q": [q[at + r] for r in row], "bound": part["bound"].to_numpy()[at + row], "leaf": leaf_ids[leaf], "salt": salt})

        out = source.mapInPandas(run, "query_id long, q array<double>, bound double, leaf long, salt long")
        return out.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))

    def search(key: tuple, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, v, p = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), np.stack(block["p"].to_numpy())
        qid, q, bound = asked["query_id"].to_numpy(), np.stack(asked["q"].to_numpy()), asked["bound"].to_numpy().copy()
        lengths = (q * q).sum(axis=1) + top
        # A kd-tree inside the block, down to about 128 rows.
        leaf, open_ = [], [np.arange(len(ids))]
        while open_:
            own = open_.pop()
            width = p[own].max(axis=0) - p[own].min(axis=0)
            axis = int(width.argmax())
            if len(own) <= 128 or width[axis] == 0:
                leaf += [own[i : i + 128] for i in range(0, len(own), 128)]
                continue
            order = own[np.argsort(p[own, axis], kind="stable")]
            open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
        low, high = np.stack([p[x].min(axis=0) for x in leaf]), np.stack([p[x].max(axis=0) for x in leaf])
        own = q @ matrix[:-1]
        gap = np.stack([(np.maximum(np.maximum(a - own, own - b), 0) ** 2).sum(axis=1) for a, b in zip(low, high)], axis=1)
        turn = np.argsort(gap, axis=1, kind="stable")
        best, name = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for step in range(len(leaf)):
            here = turn[:, step]
            live = np.nonzero(gap[np.arange(len(qid)), here] <= bound * reach)[0]
            if not len(live):
                break
            for x in np.unique(here[live]):
                rows_of = leaf[x]
                for at in range(0, (mine := live[here[live] == x]).size, 64):
                    m = mine[at : at + 64]
                    score = (q[m][:, None, :] * v[rows_of][None, :, :]).sum(axis=2)
                    score[qid[m][:, None] == ids[rows_of][None, :]] = -np.inf
                    score = np.concatenate([best[m], score], axis=1)
                    names = np.concatenate([name[m], np.broadcast_to(ids[rows_of], (len(m), len(rows_of)))], axis=1)
                    names = np.where(np.isneginf(score), np.iinfo(np.int64).max, names)
                    order = np.lexsort((names, -score), axis=1)[:, :k]
                    best[m], name[m] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
                    bound[m] = np.minimum(bound[m], np.maximum(lengths[m] - 2 * best[m, k - 1], 0) * (1 + 1e-9) + 1e-12)
        found = ~np.isneginf(best)
        return pd.DataFrame({"query_id": np.repeat(qid, k)[found.ravel()], "vec_id": name[found], "score": best[found]})

    def searched(asked: DataFrame) -> DataFrame:
        there = blocks.select("leaf", "salt", "vec_id", "v", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
        on = ["leaf", "salt", "slice"]
        return asked.groupBy(*on).cogroup(there.groupBy(*on)).applyInPandas(search, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    one = keep(ranked(searched(routed(wanted.withColumn("bound", F.lit(float("inf"))), shut=False))).drop("rank"))
    kth = one.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    bound = F.when(F.col("n") >= k, F.greatest(square + top - 2 * F.col("kth"), F.lit(0.0)) * (1 + 1e-9) + 1e-12).otherwise(float("inf"))
    more = wanted.join(kth, "query_id", "left").select("query_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    both = one.union(searched(routed(more, shut=True)))
    return ranked(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
