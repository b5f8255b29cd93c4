import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import domain as D
from propspark.operators.fingerprints import SubstructureConfig, substructure_bits
from propspark.operators.similarity import Block, block_similarity, choose_pivots, nearest, pack_bits, summarize_top, train_neighbours, upper_bounds

BLOCKS = (Block("bits", "bits", "binary", 40), Block("vec", "vec", "dense", 6))
SETS = {"bits": ["bits"], "both": ["bits", "vec"]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(90):
        bits = sorted(set(rng.integers(0, 40, rng.integers(0, 12)).tolist()))
        data.append((i, bits, rng.normal(size=6).tolist() if i != 7 else [0.0] * 6, i % 4 == 0))
    data[1] = (1, data[0][1], data[0][2], False)
    return spark.createDataFrame(data, "id long, bits array<int>, vec array<double>, is_finetune boolean").cache()


def _sims(pdf_a, pdf_b):
    dense = lambda p: np.array([[1.0 if j in b else 0.0 for j in range(40)] for b in p.bits.map(set)])
    a, b = dense(pdf_a), dense(pdf_b)
    inter = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None] - inter
    tan = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    va, vb = np.stack(pdf_a.vec), np.stack(pdf_b.vec)
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    dot = va @ vb.T
    cos = np.divide(dot, np.outer(na, nb), out=np.zeros_like(dot), where=np.outer(na, nb) > 0)
    return tan, cos


@pytest.mark.parametrize("sizes", [{}, {"broadcast_cells": 8 * 30}, {"broadcast_cells": 1, "chunk_cells": 6 * 20}])
def test_routes_match_brute_force(rows, sizes):
    test, train = rows.filter("id < 25"), rows.filter("id >= 25")
    top = summarize_top(nearest(test, train, BLOCKS, SETS, k=5, finetune_col="is_finetune", **sizes)).collect()
    a, b = test.toPandas(), train.toPandas()
    tan, cos = _sims(a, b)
    ft = b.is_finetune.to_numpy()
    for r in top:
        i = int(np.flatnonzero(a.id == r["id"])[0])
        sim = tan[i] if r["feature_set"] == "bits" else (tan[i] + cos[i]) / 2
        sim = sim[ft] if r["scope"] == "finetune" else sim
        assert r["max_sim"] == pytest.approx(sim.max())
        assert r["mean_topk"] == pytest.approx(np.sort(sim)[-5:].mean())
    assert len(top) == 25 * 2 * 2


@pytest.mark.parametrize("sizes", [{}, {"broadcast_cells": 1, "chunk_cells": 6 * 20}])
def test_train_neighbours(rows, sizes):
    """Self is left out by row, duplicates give 1, blocks are averaged after their own maximum."""
    got = {(r["id"], r["feature_set"], r["scope"]): r["nn_sim"] for r in
           train_neighbours(rows, BLOCKS, SETS, finetune_col="is_finetune", **sizes).collect()}
    pdf = rows.toPandas()
    tan, cos = _sims(pdf, pdf)
    np.fill_diagonal(tan, -np.inf)
    np.fill_diagonal(cos, -np.inf)
    for i in range(90):
        assert got[i, "bits", "all"] == pytest.approx(tan[i].max())
        assert got[i, "both", "all"] == pytest.approx((tan[i].max() + cos[i].max()) / 2)
    ft = pdf.is_finetune.to_numpy()
    sub = tan[np.ix_(ft, ft)].max(axis=1)
    assert [got[i, "bits", "finetune"] for i in pdf.id[ft]] == pytest.approx(sub.tolist())
    assert got[0, "both", "all"] == pytest.approx(1.0)


def test_chunk_pruning_is_exact(spark):
    """Very different on-bit counts: far chunks are skipped and the result stays the same."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(240):
        size = [4, 12, 60, 200][i % 4]
        base = rng.choice(256, size, replace=False) if i < 8 else np.array(data[i % 8][1])
        keep = base if i < 8 else base[rng.random(len(base)) > 0.05]
        data.append((i, sorted(set(keep.tolist()))))
    df = spark.createDataFrame(data, "id long, bits array<int>")
    blocks, sets = [Block("bits", "bits", "binary", 256)], {"bits": ["bits"]}
    run = lambda **kw: {(r["id"]): (r["max_sim"], r["mean_topk"]) for r in summarize_top(
        nearest(df, df, blocks, sets, k=3, exclude_self=True, **kw)).collect()}
    whole, pruned = run(), run(broadcast_cells=1, chunk_cells=8 * 20)
    assert len(whole) == len(pruned) == 240
    assert all(pruned[i] == pytest.approx(whole[i]) for i in whole)


def test_lonely_row_does_not_open_all_chunks(spark, monkeypatch):
    """Groups of like rows, and one row like none: only that row is sent on to further chunks."""
    import propspark.operators.similarity as S

    data = [(g * 40 + i, list(range(g * 100, g * 100 + 10 * (g + 1) + i % 2))) for g in range(6) for i in range(40)]
    data.append((999, [7000, 7001, 7002, 7003]))
    df = spark.createDataFrame(data, "id long, bits array<int>")
    sent, multiply = [], S._multiply
    monkeypatch.setattr(S, "_multiply", lambda lx, *a: sent.append(lx) or multiply(lx, *a))
    args = ([Block("bits", "bits", "binary", 8000)], {"bits": ["bits"]})
    got = {r["id"]: r["max_sim"] for r in summarize_top(nearest(df, df, *args, exclude_self=True, broadcast_cells=1, chunk_cells=250 * 20)).collect()}
    assert len(sent) == 2 and {r["id"] for r in sent[1].select("id").distinct().collect()} == {999}
    whole = {r["id"]: r["max_sim"] for r in summarize_top(nearest(df, df, *args, exclude_self=True)).collect()}
    assert got == pytest.approx(whole)


def test_bounds_hold():
    """No similarity of a row to a member of a box is above its bound; counts alone give the exact ratio."""
    lo, hi = np.array([[1.0], [10.0], [50.0], [0.0]]), np.array([[9.0], [40.0], [90.0], [0.0]])
    assert upper_bounds(np.array([[20.0], [0.0]]), lo, hi, "binary") == pytest.approx(np.array([[9 / 20, 1, 20 / 50, 0], [0, 0, 0, 0]]), abs=1e-8)
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, boxes = unit(rng.normal(size=(50, 5))), [unit(rng.normal(size=(20, 5)) * 0.3 + rng.normal(size=5)) for _ in range(12)]
    boxes[3][4] = 0
    x[7] = 0
    pivots = choose_pivots(np.concatenate(boxes), 6)
    assert len(pivots) == 6 and np.linalg.norm(pivots, axis=1) == pytest.approx(np.ones(6))
    angles = lambda m: np.arccos(np.clip(m @ pivots.T, -1, 1))
    ends = [np.stack([f(angles(b), axis=0) for b in boxes]) for f in (np.min, np.max)]
    bound = upper_bounds(angles(x), *ends, "dense")
    for j, b in enumerate(boxes):
        assert (bound[:, j] >= (x @ b.T).max(axis=1)).all()
    assert choose_pivots(np.zeros((3, 2)), 4).tolist() == [[0, 0]] and len(choose_pivots(np.ones((9, 2)), 4)) == 1


def clustered(spark, clusters, each, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    rows = [(c * each + i, (centres[c] + 0.15 * rng.normal(size=width)).tolist()) for c in range(clusters) for i in range(each)]
    rows[5] = (5, [0.0] * width)
    rows[6] = (6, None)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, vec array<double>")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_pruning(spark, monkeypatch, exclude_self):
    """On clustered vectors few of all chunk pairs are multiplied, and the result is that of all pairs."""
    import propspark.operators.similarity as S

    df = clustered(spark, 24, 50, 16, 1)
    blocks, sets = [Block("vec", "vec", "dense", 16)], {"vec": ["vec"]}
    run = lambda **kw: {r["id"]: (r["max_sim"], r["mean_topk"]) for r in summarize_top(
        nearest(df, df, blocks, sets, k=4, exclude_self=exclude_self, **kw)).collect()}
    whole = run()
    sent, multiply = [], S._multiply
    monkeypatch.setattr(S, "_multiply", lambda lx, *a: sent.append(lx) or multiply(lx, *a))
    monkeypatch.setattr(S, "_by_chunks", None)
    pruned = run(broadcast_cells=1, chunk_cells=16 * 30)
    assert len(whole) == len(pruned) == 1200
    assert all(pruned[i] == pytest.approx(whole[i], abs=1e-12) for i in whole)
    pairs = {(r["_lc"], r["_rc"]) for lx in sent for r in lx.select("_lc", "_rc").distinct().collect()}
    rows = sum(lx.count() for lx in sent)
    assert len(pairs) < 0.3 * 40 * 40 and rows < 0.3 * 1200 * 40


def test_regions_of_many_chunks(spark, monkeypatch):
    """More chunks than regions: rows are bounded against runs of chunks."""
    import propspark.operators.similarity as S

    monkeypatch.setattr(S, "REGIONS", 5)
    df = clustered(spark, 6, 40, 8, 2)
    args = ([Block("vec", "vec", "dense", 8)], {"vec": ["vec"]})
    run = lambda **kw: {r["id"]: r["max_sim"] for r in summarize_top(nearest(df, df, *args, k=2, exclude_self=True, **kw)).collect()}
    assert run(broadcast_cells=1, chunk_cells=8 * 10) == pytest.approx(run(), abs=1e-12)


def test_packed_bits():
    m = pack_bits([[0, 63, 64], None, [], [129]], 130)
    assert m.shape == (4, 3) and m.tolist() == [[1 | 1 << 63, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 2]]
    assert Block("x", "x", "binary", 1024).cells == 32 and Block("x", "x", "dense", 64).cells == 64


def test_lone_and_empty_train(rows):
    one = rows.filter("id = 3")
    assert train_neighbours(one, BLOCKS, SETS).agg(F.min("nn_sim")).first()[0] == 1.0
    with pytest.raises(ValueError):
        nearest(rows, rows.filter("id < 0"), BLOCKS, SETS)


def test_block_similarity_edges():
    a = pack_bits([[], [0, 1]], 2)
    assert block_similarity(a, a, "binary").tolist() == [[0, 0], [0, 1]]
    with pytest.raises(ValueError):
        Block("x", "x", "fuzzy", 3)


def test_user_cutoff():
    blocks = [Block("a", "a", "binary", 1), Block("b", "b", "binary", 1), Block("c", "c", "dense", 1)]
    assert D.user_cutoff(blocks, ["a", "b"], 0.4, 0.8) == 0.4
    assert D.user_cutoff(blocks, ["a", "c"], 0.4, 0.8) == pytest.approx(0.6)
    assert D.user_cutoff(blocks, ["a", "c"], 0.4, None) is None


def test_ad_batches(spark):
    docs = spark.createDataFrame([(1, "CCO", False), (2, "CCN", False), (3, "c1ccccc1", True)], "id int, smiles string, is_finetune boolean")
    test = spark.createDataFrame([(10, "CCO"), (11, "ClCCCl")], "id int, smiles string")
    bits = lambda df: df.withColumn("fp", substructure_bits(F.col("smiles"), SubstructureConfig(2, 256)))
    blocks, sets = [Block("fp", "fp", "binary", 256)], {"fp": ["fp"]}
    table, summary = D.run_dual_ad_batch(bits(docs), bits(test), blocks, sets, tanimoto_cutoff=0.5)
    got = {r["id"]: r for r in table.collect()}
    assert got[10]["max_similarity_to_train_all"] == 1.0
    assert got[10]["delta_similarity_finetune_minus_all"] == got[10]["max_similarity_to_train_finetune"] - 1.0
    assert got[10]["inside_ad_train_all_user_cutoff"] and not got[10]["inside_ad_train_finetune_user_cutoff"]
    s = summary.collect()
    assert len(s) == 1 and s[0]["is_best"] and s[0]["fine_tuning_preferred"] is False
    assert (s[0]["n_train_other"], s[0]["n_train_finetune"], s[0]["n_test"]) == (2, 1, 2)
    _, single = D.run_ad_batch(bits(docs), bits(test), blocks, sets, best_by="train_p5")
    assert single.first()["is_best"]
    _, unranked = D.run_ad_batch(bits(docs), bits(test), blocks, sets, best_by="user_cutoff")
    assert unranked.first()["is_best"] is False
    with pytest.raises(ValueError, match="fine-tune"):
        D.dual_ad_table(bits(docs).withColumn("is_finetune", F.lit(False)), bits(test), blocks, sets)
    with pytest.raises(ValueError, match="best_by"):
        D.run_ad_batch(bits(docs), bits(test), blocks, sets, best_by="nope")


def test_copies_do_not_grow_with_chunks(spark, monkeypatch):
    """Rows without any order, so that all chunks must be met: a row is copied once for each block, not for each small chunk."""
    import propspark.operators.similarity as S

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=12).tolist(), i % 3 == 0) for i in range(400)], "id long, vec array<double>, is_finetune boolean")
    blocks, sets = [Block("vec", "vec", "dense", 12)], {"vec": ["vec"]}
    run = lambda **kw: {(r["id"], r["scope"]): (r["max_sim"], r["mean_topk"]) for r in summarize_top(
        nearest(df, df, blocks, sets, k=3, exclude_self=True, finetune_col="is_finetune", **kw)).collect()}
    whole = run()
    sent, multiply = [], S._multiply
    monkeypatch.setattr(S, "_multiply", lambda lx, *a: sent.append(lx) or multiply(lx, *a))
    pruned = run(broadcast_cells=1, chunk_cells=12 * 5)
    assert len(whole) == len(pruned) == 800 and all(pruned[i] == pytest.approx(whole[i], abs=1e-12) for i in whole)
    assert sum(lx.count() for lx in sent) <= 400 * (S.MIN_BLOCKS + 2)


def test_one_file_is_dealt_out(spark, tmp_path):
    """A table of one file is not searched in a single task."""
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "id long, vec array<double>").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    args = ([Block("vec", "vec", "dense", 2)], {"vec": ["vec"]})
    tasks = lambda **kw: nearest(df, df.limit(100), *args, **kw).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks() > 8
