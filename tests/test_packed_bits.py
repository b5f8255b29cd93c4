"""Comparisons of packed bits against plain numpy, and the work that they leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import propspark.operators.similarity as S
from propspark.operators.similarity import Block, block_similarity, pack_bits, train_neighbours


def drawn(rng, n, width, most):
    """Lists of on-bits of very different lengths; some are empty and some are copies."""
    rows = [sorted(rng.choice(width, rng.integers(0, most), replace=False).tolist()) for _ in range(n)]
    rows[n // 2] = rows[0]
    rows[1] = []
    return rows


def plain(a, b):
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(map(set, a)):
        for j, y in enumerate(map(set, b)):
            out[i, j] = len(x & y) / len(x | y) if x | y else 0
    return out


@pytest.mark.parametrize("width", [40, 512, 1024, 2048, 4032, 4096])
def test_all_widths(width):
    """Also where all bits are on, which makes the largest sums."""
    rng = np.random.default_rng(width)
    a, b = drawn(rng, 9, width, width), drawn(rng, 14, width, width) + [list(range(width))]
    a[3] = list(range(width))
    want = plain(a, b)
    got = block_similarity(pack_bits(a, width), pack_bits(b, width), "binary")
    assert got.tolist() == want.tolist()
    for n in (0, 1, 2):
        assert block_similarity(pack_bits(a, width), pack_bits(b[:n], width), "binary").tolist() == want[:, :n].tolist()
    assert block_similarity(pack_bits([], width), pack_bits(b, width), "binary").shape == (0, len(b))


@pytest.mark.parametrize("k, n_flagged", [(1, None), (3, None), (2, 70)])
def test_counts_leave_out_tiles(monkeypatch, k, n_flagged):
    """Rows of far counts are not compared, and the best values are those of all pairs."""
    monkeypatch.setattr(S, "TILE", (8, 16))
    rng, width, n = np.random.default_rng(5), 1024, 400
    bases = [rng.choice(width, size, replace=False) for size in (20, 90, 300, 900)]
    rows = [sorted(x for x in bases[i % 4].tolist() if rng.random() > 0.05) for i in range(n)]
    rows[5], rows[9] = [], rows[1]
    ids = np.arange(n, dtype=np.int32)
    ids[13] = ids[17]
    m, seen, compare = pack_bits(rows, width), [], S._tanimoto
    monkeypatch.setattr(S, "_tanimoto", lambda a, b, need: seen.append(len(a) * len(b)) or compare(a, b, need))
    scopes = ["all"] if n_flagged is None else ["all", "finetune"]
    best = S._Best(n, k, [("bits", s) for s in scopes])
    S._score(best, {"bits": m}, {"bits": m}, [Block("bits", "bits", "binary", width)], {"bits": ["bits"]}, n_flagged, (ids, ids))
    want = np.where(ids[:, None] == ids, -np.inf, plain(rows, rows))
    for scope in scopes:
        among = want if scope == "all" else want[:, :n_flagged]
        assert np.sort(best.top["bits", scope], axis=1).tolist() == np.sort(among, axis=1)[:, -k:].tolist()
    assert sum(seen) < 0.6 * n * n


def test_train_neighbours_reads_named_blocks_only(spark):
    """A block that no feature set names is neither read nor compared, and each fingerprint is made once."""
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<int>")
    def bits(v):
        made.add(len(v))
        return v.map(lambda x: [x % 7, 7 + x % 5])

    train = spark.createDataFrame([(i,) for i in range(60)], "id long").repartition(3).withColumn("bits", bits("id"))
    got = train_neighbours(train, (Block("bits", "bits", "binary", 16), Block("other", "other", "dense", 4)), {"bits": ["bits"]})
    assert {r["id"]: r["nn_sim"] for r in got.collect()} == {i: 1.0 if i < 25 or i >= 35 else pytest.approx(1 / 3) for i in range(60)}
    assert made.value == 60
