"""Similarity and applicability-domain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import r6, scratch, table
from propspark.catalog.text import chars_sql, path_sql
from propspark.operators import domain as D
from propspark.operators.fingerprints import PathConfig, SubstructureConfig, path_bits, substructure_bits
from propspark.operators.similarity import Block, nearest, summarize_top, train_neighbours
from propspark.sources.tables import spread_scan

BLOCKS = (Block("emb", "embedding", "dense", 64), Block("pos", "bits", "binary", 64))
SETS = {"emb": ["emb"], "pos": ["pos"], "emb+pos": ["emb", "pos"]}
CUTS = {"tanimoto_cutoff": 0.4, "cosine_cutoff": 0.3}
COLUMNS = ("max_similarity_to_train", "mean_topk_similarity_to_train", "user_cutoff", "train_p5_cutoff")


def _vectors(spark, root):
    """Dense vectors with a binary block of their clearly positive positions. Labels 8 and 9 are the test
    rows, labels below 4 the fine-tune subset."""
    e = table(spark, root, "embeddings")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", i) > 0.1)
    return e.select("vec_id", "label", "embedding", bits.alias("bits"), (F.col("label") < 4).alias("is_finetune"))


def _sides(spark, root):
    v = _vectors(spark, root)
    return v.filter("label < 8"), v.filter("label >= 8").drop("is_finetune")


def nearest_cosine(spark, root):
    train, test = _sides(spark, root)
    return summarize_top(nearest(test, train, BLOCKS, {"emb": ["emb"]}, k=5, id_col="vec_id")).select(
        F.col("id").alias("vec_id"), r6("max_sim"), r6("mean_topk"))


def nearest_cosine_chunked(spark, root):
    """The route for two large sides, with small chunks."""
    train, test = _sides(spark, root)
    top = nearest(test, train, BLOCKS, {"emb": ["emb"]}, k=5, id_col="vec_id", broadcast_cells=1, chunk_cells=64 * 120)
    return summarize_top(top).select(F.col("id").alias("vec_id"), r6("max_sim"), r6("mean_topk"))


def nearest_all_vectors(spark, root):
    """Every vector against every other one."""
    v = _vectors(spark, root)
    top = nearest(v, v, BLOCKS, {"emb": ["emb"]}, k=3, id_col="vec_id", exclude_self=True)
    return summarize_top(top).select(F.col("id").alias("vec_id"), r6("max_sim"), r6("mean_topk"))


def dense_pruned(spark, root):
    """The same for a table too large for a broadcast: rows bounded by their angles to pivots, small chunks."""
    v = _vectors(spark, root)
    top = nearest(v, v, BLOCKS, {"emb": ["emb"]}, k=3, id_col="vec_id", exclude_self=True, broadcast_cells=1, chunk_cells=64 * 250)
    return summarize_top(top).select(F.col("id").alias("vec_id"), r6("max_sim"), r6("mean_topk"))


def _documents(spark, root):
    bits = lambda t, i: spread_scan(table(spark, root, t), i).select(
        F.col(i).alias("id"), path_bits(F.col("text"), PathConfig(1, 3, 2048)).alias("path"), substructure_bits(F.col("text"), SubstructureConfig(3, 1024)).alias("chars"))
    return bits("documents", "doc_id"), bits("benchmark", "item_id")


TEXT_BLOCKS = (Block("path", "path", "binary", 2048), Block("chars", "chars", "binary", 1024))


def tanimoto_documents(spark, root):
    """Every document against all benchmark passages."""
    docs, bench = _documents(spark, root)
    return summarize_top(nearest(docs, bench, TEXT_BLOCKS, {"path": ["path"]}, k=5)).select(
        F.col("id").alias("doc_id"), r6("max_sim"), r6("mean_topk"))


def multi_block_texts(spark, root):
    """Benchmark passages against all documents, mean over two fingerprint blocks."""
    docs, bench = _documents(spark, root)
    top = nearest(bench, docs, TEXT_BLOCKS, {"path": ["path"], "path+chars": ["path", "chars"]}, k=5)
    return summarize_top(top).select(F.col("id").alias("item_id"), "feature_set", r6("max_sim"), r6("mean_topk"))


def train_neighbour(spark, root):
    train, _ = _sides(spark, root)
    nn = train_neighbours(train, BLOCKS, SETS, id_col="vec_id", finetune_col="is_finetune")
    return nn.select(F.col("id").alias("vec_id"), "feature_set", "scope", r6("nn_sim"))


def document_neighbour(spark, root):
    """Nearest other document of every document; copies find each other at 1."""
    docs, _ = _documents(spark, root)
    nn = train_neighbours(docs, TEXT_BLOCKS, {"chars": ["chars"]})
    return nn.select(F.col("id").alias("doc_id"), r6("nn_sim"))


def ad_table(spark, root):
    train, test = _sides(spark, root)
    out = D.ad_table(train, test, BLOCKS, SETS, id_col="vec_id", **CUTS)
    flags = [f"{s}_ad_{r}" for r in ("user_cutoff", "train_p5") for s in ("inside", "outside")]
    return out.select("vec_id", "label", "feature_set", *[r6(c) for c in COLUMNS], *flags)


DUAL_FLAGS = [f"{s}_ad_train_{t}_{r}" for r in ("user_cutoff", "p5") for t in ("all", "finetune") for s in ("inside", "outside")]
DUAL_COLUMNS = [f"{m}_similarity_to_train_{t}" for m in ("max", "mean_topk") for t in ("all", "finetune")]


def dual_ad_table(spark, root):
    train, test = _sides(spark, root)
    out = D.dual_ad_table(train, test, BLOCKS, SETS, id_col="vec_id", **CUTS)
    return out.select("vec_id", "label", "feature_set", *[r6(c) for c in DUAL_COLUMNS], r6("delta_similarity_finetune_minus_all"), *DUAL_FLAGS)


def ad_summary(spark, root):
    train, test = _sides(spark, root)
    _, s = D.run_ad_batch(train, test, BLOCKS, SETS, id_col="vec_id", best_by="train_p5", **CUTS)
    num = ("user_cutoff", "train_p5_cutoff", "median_similarity_to_train", "pct_outside_ad_user_cutoff", "pct_outside_ad_train_p5")
    return s.select("feature_set", "n_train", "n_test", "n_outside_ad_user_cutoff", "n_outside_ad_train_p5", *[r6(c) for c in num], "is_best")


def dual_ad_summary(spark, root):
    train, test = _sides(spark, root)
    _, s = D.run_dual_ad_batch(train, test, BLOCKS, SETS, id_col="vec_id", label="low labels", **CUTS)
    num = ["train_all_p5_cutoff", "train_finetune_p5_cutoff", "median_similarity_to_train_all", "median_similarity_to_train_finetune",
           "mean_topk_similarity_to_train_all", "mean_topk_similarity_to_train_finetune", "delta_mean_topk_finetune_minus_all", "pct_outside_ad_train_finetune_p5"]
    counts = [f"n_outside_ad_{n}" for n in ("user_cutoff_all", "user_cutoff_finetune", "train_all_p5", "train_finetune_p5")]
    return s.select("feature_set", "n_train_other", "n_train_finetune", "n_test", "finetune_subset_label", *counts, *[r6(c) for c in num],
                    "fine_tuning_preferred", "is_best")


def pca_variance(spark, root):
    """The sign of an axis is arbitrary, so the variance along each is reported."""
    pcs = D.pca_coordinates(table(spark, root, "embeddings"), "embedding", id_col="vec_id")
    return pcs.agg(r6(F.var_samp("pc1"), "var1"), r6(F.var_samp("pc2"), "var2"), r6(F.abs(F.avg("pc1")), "mean1"))


def tanimoto_pruned(spark, root):
    """The same as ``tanimoto_documents`` for two large sides: chunks by on-bit count, rows bounded one by one."""
    docs, bench = _documents(spark, root)
    return summarize_top(nearest(docs, bench, TEXT_BLOCKS, {"path": ["path"]}, k=5, broadcast_cells=1, chunk_cells=TEXT_BLOCKS[0].cells * 500)).select(
        F.col("id").alias("doc_id"), r6("max_sim"), r6("mean_topk"))


def nearest_broadcast_left(spark, root):
    """Only the left side is small enough to be broadcast."""
    train, test = _sides(spark, root)
    top = nearest(test, train, BLOCKS, {"emb": ["emb"]}, k=5, id_col="vec_id", broadcast_cells=64 * test.count())
    return summarize_top(top).select(F.col("id").alias("vec_id"), r6("max_sim"), r6("mean_topk"))


def ad_sink(spark, root):
    """A batch's table written by feature set and read back."""
    train, test = _sides(spark, root)
    table_, summary = D.run_ad_batch(train, test, BLOCKS, SETS, id_col="vec_id", **CUTS)
    path = scratch(spark)
    D.write_ad_batch(table_, summary, path)
    back = spark.read.parquet(f"{path}/table")
    counts = spark.read.parquet(f"{path}/summary").select(F.col("feature_set").alias("_fs"), "n_test")
    flags = [f"{s}_ad_{r}" for r in ("user_cutoff", "train_p5") for s in ("inside", "outside")]
    out = back.join(F.broadcast(counts), F.col("feature_set") == F.col("_fs"))
    return out.select("vec_id", "label", "feature_set", *[r6(c) for c in COLUMNS], *flags)


def pca_blocks(spark, root):
    """Both blocks of a set, training and test rows together: centred, uncorrelated axes, the wider first."""
    train, test = _sides(spark, root)
    at = D.pca_blocks(train, test, BLOCKS, id_col="vec_id")
    whole = at.agg((F.abs(F.avg("pc1")) < 1e-6).alias("centred"), (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
                   (F.var_samp("pc1") >= F.var_samp("pc2")).alias("wider_first"))
    return at.groupBy("role").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(whole))


QUERIES = {f.__name__: f for f in (
    nearest_cosine, nearest_cosine_chunked, nearest_all_vectors, dense_pruned, tanimoto_documents, multi_block_texts, train_neighbour, document_neighbour,
    ad_table, dual_ad_table, ad_summary, dual_ad_summary, pca_variance, tanimoto_pruned, nearest_broadcast_left, ad_sink, pca_blocks,
)}

_V = """v as (select vec_id, label, embedding::double[] as e, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.1::float) as bits, label < 4 as ft from embeddings)"""
_COS = "list_cosine_similarity(a.e, b.e)"
_TAN = """coalesce(len(list_intersect(a.bits, b.bits)) / nullif(len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)), 0), 0)"""
_TOP = "select vec_id, round(max(s), 6) as max_sim, round(avg(s), 6) as mean_topk from (select *, row_number() over (partition by vec_id order by s desc) as rn from p) where rn <= {k} group by 1"
_NEAREST = f"""with {_V}, p as (select a.vec_id, {_COS} as s from v a, v b where a.label >= 8 and b.label < 8) {_TOP.format(k=5)}"""

_PAIRS = f"""{_V}, q as (select a.vec_id, a.label, b.ft, {_COS} as c, {_TAN} as t from v a, v b where a.label >= 8 and b.label < 8),
 p as (select vec_id, label, ft, unnest(['emb', 'pos', 'emb+pos']) as feature_set, unnest([c, t, (c + t) / 2]) as s from q),
 sims as (select vec_id, label, feature_set, 'all' as scope, s, row_number() over (partition by vec_id, feature_set order by s desc) as rn from p
   union all select vec_id, label, feature_set, 'finetune', s, row_number() over (partition by vec_id, feature_set order by s desc) from p where ft),
 best as (select vec_id, label, feature_set, scope, max(s) as mx, avg(s) as tk from sims where rn <= 5 group by all),
 w as (select a.vec_id, max({_COS}) as c, max({_TAN}) as t, 'all' as scope from v a, v b where a.label < 8 and b.label < 8 and a.vec_id <> b.vec_id group by 1
   union all select a.vec_id, max({_COS}), max({_TAN}), 'finetune' from v a, v b where a.ft and b.ft and a.vec_id <> b.vec_id group by 1),
 nn as (select vec_id, scope, unnest(['emb', 'pos', 'emb+pos']) as feature_set, unnest([c, t, (c + t) / 2]) as s from w),
 cut as (select feature_set, scope, quantile_cont(s, 0.05) as p5 from nn group by 1, 2),
 usr as (select * from (values ('emb', 0.3::double), ('pos', 0.4::double), ('emb+pos', 0.35::double)) u(feature_set, uc)),
 single as (select vec_id, label, feature_set, mx, tk, uc, p5, mx >= uc as iu, mx >= p5 as ip from best join cut using (feature_set, scope) join usr using (feature_set) where scope = 'all'),
 dual as (select a.vec_id, a.label, a.feature_set, a.mx as am, f.mx as fm, a.tk as atk, f.tk as ftk, f.mx - a.mx as d, a.mx >= uc as aiu, f.mx >= uc as fiu,
   a.mx >= ca.p5 as aip, f.mx >= cf.p5 as fip, ca.p5 as ap5, cf.p5 as fp5 from best a join best f on a.vec_id = f.vec_id and a.feature_set = f.feature_set and f.scope = 'finetune'
   join cut ca on ca.feature_set = a.feature_set and ca.scope = 'all' join cut cf on cf.feature_set = a.feature_set and cf.scope = 'finetune'
   join usr on usr.feature_set = a.feature_set where a.scope = 'all')"""


def _text_pairs(left, lkey, right, rkey, bits):
    """Tanimoto of all pairs, with pairs that share no bit at zero."""
    lb, rb = bits(left, lkey), bits(right, rkey)
    return f"""select i.l, i.r, coalesce(n / nullif(coalesce(na, 0) + coalesce(nb, 0) - n, 0), 0) as s from
        (select x.{lkey} as l, y.{rkey} as r, coalesce(n, 0) as n from {left} x cross join {right} y left join
        (select a.{lkey} as l, b.{rkey} as r, count(*) as n from {lb} a join {rb} b on a.b = b.b group by 1, 2) j on j.l = x.{lkey} and j.r = y.{rkey}) i
        left join (select {lkey} as l, count(*) as na from {lb} group by 1) ca on ca.l = i.l left join (select {rkey} as r, count(*) as nb from {rb} group by 1) cb on cb.r = i.r"""


def _path(t, k):
    return path_sql(t, k, 1, 3, 2048)


def _chars(t, k):
    return chars_sql(t, k, 1024)


ORACLES = {
    "nearest_cosine": _NEAREST,
    "nearest_cosine_chunked": _NEAREST,
    "nearest_all_vectors": f"with {_V}, p as (select a.vec_id, {_COS} as s from v a, v b where a.vec_id <> b.vec_id) {_TOP.format(k=3)}",
    "dense_pruned": f"with {_V}, p as (select a.vec_id, {_COS} as s from v a, v b where a.vec_id <> b.vec_id) {_TOP.format(k=3)}",
    "tanimoto_documents": f"""with p as ({_text_pairs('documents', 'doc_id', 'benchmark', 'item_id', _path)})
        select l as doc_id, round(max(s), 6) as max_sim, round(avg(s), 6) as mean_topk from
        (select *, row_number() over (partition by l order by s desc) as rn from p) where rn <= 5 group by 1""",
    "multi_block_texts": f"""with a as materialized ({_text_pairs('benchmark', 'item_id', 'documents', 'doc_id', _path)}),
        b as materialized ({_text_pairs('benchmark', 'item_id', 'documents', 'doc_id', _chars)}),
        p as (select l, r, 'path' as feature_set, s from a union all select a.l, a.r, 'path+chars', (a.s + b.s) / 2 from a join b on a.l = b.l and a.r = b.r)
        select l as item_id, feature_set, round(max(s), 6) as max_sim, round(avg(s), 6) as mean_topk from
        (select *, row_number() over (partition by l, feature_set order by s desc) as rn from p) where rn <= 5 group by 1, 2""",
    "train_neighbour": f"with {_PAIRS} select vec_id, feature_set, scope, round(s, 6) as nn_sim from nn",
    "document_neighbour": f"""with x as materialized (select doc_id, list_sort(list(b)) as bits from {_chars('documents', 'doc_id')} group by 1),
        m as (select doc_id, bitstring_agg(b, 0, 1023) as k, count(*) as n from (select doc_id, unnest(bits) as b from x) group by 1)
        select a.doc_id, round(max(bit_count(a.k & b.k) / (a.n + b.n - bit_count(a.k & b.k))), 6) as nn_sim from m a, m b where a.doc_id <> b.doc_id group by 1""",
    "ad_table": f"""with {_PAIRS} select vec_id, label, feature_set, round(mx, 6) as max_similarity_to_train, round(tk, 6) as mean_topk_similarity_to_train,
        round(uc, 6) as user_cutoff, round(p5, 6) as train_p5_cutoff, iu as inside_ad_user_cutoff, not iu as outside_ad_user_cutoff, ip as inside_ad_train_p5, not ip as outside_ad_train_p5 from single""",
    "dual_ad_table": f"""with {_PAIRS} select vec_id, label, feature_set, round(am, 6) as max_similarity_to_train_all, round(fm, 6) as max_similarity_to_train_finetune,
        round(atk, 6) as mean_topk_similarity_to_train_all, round(ftk, 6) as mean_topk_similarity_to_train_finetune, round(d, 6) as delta_similarity_finetune_minus_all,
        aiu as inside_ad_train_all_user_cutoff, not aiu as outside_ad_train_all_user_cutoff, fiu as inside_ad_train_finetune_user_cutoff,
        not fiu as outside_ad_train_finetune_user_cutoff, aip as inside_ad_train_all_p5, not aip as outside_ad_train_all_p5,
        fip as inside_ad_train_finetune_p5, not fip as outside_ad_train_finetune_p5 from dual""",
    "ad_summary": f"""with {_PAIRS}, s as (select feature_set, count(*) as n_test, count(*) filter (where not iu) as nu, count(*) filter (where not ip) as np, max(uc) as uc, max(p5) as p5,
        median(mx) as med from single group by 1) select feature_set, (select count(*) from v where label < 8) as n_train, n_test, nu as n_outside_ad_user_cutoff,
        np as n_outside_ad_train_p5, round(uc, 6) as user_cutoff, round(p5, 6) as train_p5_cutoff, round(med, 6) as median_similarity_to_train,
        round(100.0 * nu / n_test, 6)::double as pct_outside_ad_user_cutoff, round(100.0 * np / n_test, 6)::double as pct_outside_ad_train_p5,
        row_number() over (order by np, med desc, feature_set) = 1 as is_best from s""",
    "dual_ad_summary": f"""with {_PAIRS}, s as (select feature_set, count(*) as n_test, count(*) filter (where not aiu) as nua, count(*) filter (where not fiu) as nuf,
        count(*) filter (where not aip) as npa, count(*) filter (where not fip) as npf, max(ap5) as ap5, max(fp5) as fp5, median(am) as ma, median(fm) as mf, avg(atk) as ta, avg(ftk) as tf
        from dual group by 1) select feature_set, (select count(*) from v where label < 8 and not ft) as n_train_other, (select count(*) from v where ft) as n_train_finetune, n_test,
        'low labels' as finetune_subset_label, nua as n_outside_ad_user_cutoff_all, nuf as n_outside_ad_user_cutoff_finetune, npa as n_outside_ad_train_all_p5,
        npf as n_outside_ad_train_finetune_p5, round(ap5, 6) as train_all_p5_cutoff, round(fp5, 6) as train_finetune_p5_cutoff, round(ma, 6) as median_similarity_to_train_all,
        round(mf, 6) as median_similarity_to_train_finetune, round(ta, 6) as mean_topk_similarity_to_train_all, round(tf, 6) as mean_topk_similarity_to_train_finetune,
        round(tf - ta, 6) as delta_mean_topk_finetune_minus_all, round(100.0 * npf / n_test, 6)::double as pct_outside_ad_train_finetune_p5, tf > ta as fine_tuning_preferred,
        row_number() over (order by npf, mf desc, feature_set) = 1 as is_best from s""",
}
ORACLES["tanimoto_pruned"] = ORACLES["tanimoto_documents"]
ORACLES["nearest_broadcast_left"] = ORACLES["nearest_cosine_chunked"]
ORACLES["ad_sink"] = ORACLES["ad_table"]
ORACLES["pca_blocks"] = "select case when label < 8 then 'train' else 'test' end as role, count(*) as n, true as centred, true as uncorrelated, true as wider_first from embeddings group by 1"
_STEP = "list_transform({m}, lambda row: list_dot_product(row, v))"
_UNIT = "list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"


def _leading(name: str, matrix: str) -> str:
    """Power iteration: the largest eigenvalue and its vector of a symmetric matrix, given as a list of rows."""
    step = _STEP.format(m="m")
    return f"""{name}_r as (select 0 as it, list_transform(range(1, 65), lambda i: 1.0 / i) as v, 0::double as size union all
        select it + 1, list_transform(w, lambda y: y / sqrt(list_dot_product(w, w))), sqrt(list_dot_product(w, w)) from (select it, {step} as w from {name}_r, {matrix} where it < 4000)),
        {name} as (select v, size from {name}_r where it = 4000)"""


ORACLES["pca_variance"] = f"""with recursive e as (select unnest(range(1, 65)) as i, embedding::double[] as x from embeddings),
    c as (select i, j, covar_samp(x[i], x[j]) as c from e, range(1, 65) r(j) group by all), mat as materialized (select list(row order by i) as m from (select i, list(c order by j) as row from c group by i)),
    {_leading('one', 'mat')}, rest as materialized (select list_transform(m, lambda row, i: list_transform(row, lambda y, j: y - size * v[i] * v[j])) as m from mat, one), {_leading('two', 'rest')}
    select round(one.size, 6) as var1, round(two.size, 6) as var2, 0.0::double as mean1 from one, two"""
