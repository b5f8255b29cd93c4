"""Applicability domain: how close test rows are to the training rows, per feature set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.functions.scalars import inside_flag
from propspark.operators.ordered import quantiles
from propspark.operators.similarity import Block, nearest, summarize_top, train_neighbours
from propspark.session import cut_lineage
from propspark.sources.tables import is_empty

# How a batch is ranked, and the count column each rule looks at.
SINGLE_RULES = {"user_cutoff": "n_outside_ad_user_cutoff", "train_p5": "n_outside_ad_train_p5"}
DUAL_RULES = {
    "all_train_p5": "n_outside_ad_train_all_p5",
    "finetune_p5": "n_outside_ad_train_finetune_p5",
    "user_cutoff_all": "n_outside_ad_user_cutoff_all",
    "user_cutoff_finetune": "n_outside_ad_user_cutoff_finetune",
}
CUTOFF_QUANTILE = 0.05


def user_cutoff(blocks: Sequence[Block], names: Sequence[str], tanimoto: float | None, cosine: float | None) -> float | None:
    """Mean of the cut-offs of a set's blocks; none when one of them is not given."""
    family = {b.name: b.family for b in blocks}
    cuts = [tanimoto if family[n] == "binary" else cosine for n in names]
    return None if not cuts or None in cuts else sum(cuts) / len(cuts)


def _per_set(values: Mapping[str, float | None]) -> Column:
    """A literal per feature set, chosen by the feature_set column."""
    out = F.lit(None).cast("double")
    for fs, v in values.items():
        out = F.when(F.col("feature_set") == fs, F.lit(v).cast("double")).otherwise(out)
    return out


def _flags(df: DataFrame, sim: str, cutoff: str, suffix: str) -> DataFrame:
    inside = inside_flag(sim, F.col(cutoff))
    return df.withColumn(f"inside_ad_{suffix}", inside).withColumn(f"outside_ad_{suffix}", ~F.col(f"inside_ad_{suffix}"))


def _p5(train: DataFrame, blocks, feature_sets, id_col: str, finetune_col: str | None, sizes: dict) -> dict[tuple[str, str], float]:
    """5th percentile of train neighbour similarity per (feature set, scope): one number each."""
    nn = train_neighbours(train, blocks, feature_sets, id_col=id_col, finetune_col=finetune_col, **sizes)
    cut = quantiles(cut_lineage(nn), "nn_sim", {"p5": CUTOFF_QUANTILE}, ["feature_set", "scope"])
    return {(r["feature_set"], r["scope"]): r["p5"] for r in cut.collect()}


def ad_table(
    train: DataFrame,
    test: DataFrame,
    blocks: Sequence[Block],
    feature_sets: Mapping[str, Sequence[str]],
    *,
    id_col: str = "id",
    top_k: int = 5,
    tanimoto_cutoff: float | None = None,
    cosine_cutoff: float | None = None,
    use_train_p5: bool = True,
    **sizes,
) -> DataFrame:
    """Test rows per feature set with similarity to the training rows, cut-offs and inside/outside flags."""
    top = summarize_top(nearest(test, train, blocks, feature_sets, k=top_k, id_col=id_col, **sizes))
    sims = top.select(
        F.col("id").alias(id_col), "feature_set",
        F.col("max_sim").alias("max_similarity_to_train"), F.col("mean_topk").alias("mean_topk_similarity_to_train"),
    )
    drop = {b.column for b in blocks}
    out = test.drop(*drop).join(sims, id_col)
    user = {fs: user_cutoff(blocks, n, tanimoto_cutoff, cosine_cutoff) for fs, n in feature_sets.items()}
    out = out.withColumn("user_cutoff", _per_set(user))
    if any(v is not None for v in user.values()):
        out = _flags(out, "max_similarity_to_train", "user_cutoff", "user_cutoff")
    if use_train_p5:
        p5 = _p5(train, blocks, feature_sets, id_col, None, sizes)
        out = out.withColumn("train_p5_cutoff", _per_set({fs: p5[fs, "all"] for fs in feature_sets}))
        out = _flags(out, "max_similarity_to_train", "train_p5_cutoff", "train_p5")
    return out


def dual_ad_table(
    train: DataFrame,
    test: DataFrame,
    blocks: Sequence[Block],
    feature_sets: Mapping[str, Sequence[str]],
    *,
    finetune_col: str = "is_finetune",
    id_col: str = "id",
    top_k: int = 5,
    tanimoto_cutoff: float | None = None,
    cosine_cutoff: float | None = None,
    use_train_p5: bool = True,
    **sizes,
) -> DataFrame:
    """The same against all training rows and against the fine-tune subset, in one pass over the pairs."""
    if is_empty(train.filter(F.col(finetune_col))):
        raise ValueError("the fine-tune subset has no rows")
    top = nearest(test, train, blocks, feature_sets, k=top_k, id_col=id_col, finetune_col=finetune_col, **sizes)
    scoped = lambda s: F.when(F.col("scope") == s, F.col("sim"))
    sims = top.groupBy(F.col("id").alias(id_col), "feature_set").agg(
        F.max(scoped("all")).alias("max_similarity_to_train_all"),
        F.avg(scoped("all")).alias("mean_topk_similarity_to_train_all"),
        F.max(scoped("finetune")).alias("max_similarity_to_train_finetune"),
        F.avg(scoped("finetune")).alias("mean_topk_similarity_to_train_finetune"),
    )
    out = test.drop(*{b.column for b in blocks}).join(sims, id_col)
    out = out.withColumn(
        "delta_similarity_finetune_minus_all",
        F.col("max_similarity_to_train_finetune") - F.col("max_similarity_to_train_all"),
    )
    user = {fs: user_cutoff(blocks, n, tanimoto_cutoff, cosine_cutoff) for fs, n in feature_sets.items()}
    out = out.withColumn("user_cutoff", _per_set(user))
    if any(v is not None for v in user.values()):
        for s in ("all", "finetune"):
            out = _flags(out, f"max_similarity_to_train_{s}", "user_cutoff", f"train_{s}_user_cutoff")
    if use_train_p5:
        p5 = _p5(train, blocks, feature_sets, id_col, finetune_col, sizes)
        for s in ("all", "finetune"):
            out = out.withColumn(f"train_{s}_p5_cutoff", _per_set({fs: p5[fs, s] for fs in feature_sets}))
            out = _flags(out, f"max_similarity_to_train_{s}", f"train_{s}_p5_cutoff", f"train_{s}_p5")
    return out


def _outside(table: DataFrame, flag: str, name: str) -> list[Column]:
    if f"outside_ad_{flag}" not in table.columns:
        return []
    n = F.count_if(F.col(f"outside_ad_{flag}"))
    return [n.alias(f"n_outside_ad_{name}"), (n * 100.0 / F.count(F.lit(1))).alias(f"pct_outside_ad_{name}")]


def _best_first(summary: DataFrame, rank_col: str, tie: str) -> DataFrame:
    """Flag the winner; one row per feature set, so the ranking window is tiny."""
    if rank_col not in summary.columns:
        return summary.withColumn("is_best", F.lit(False))
    w = Window.orderBy(F.col(rank_col).asc_nulls_last(), F.col(tie).desc(), "feature_set")
    return summary.withColumn("is_best", (F.row_number().over(w) == 1) & F.col(rank_col).isNotNull())


def ad_summary(table: DataFrame, n_train: int, *, best_by: str = "user_cutoff") -> DataFrame:
    """One row per feature set of an ``ad_table``; the best set is flagged."""
    if best_by not in SINGLE_RULES:
        raise ValueError(f"best_by must be one of {sorted(SINGLE_RULES)}")
    first = [F.first(c).alias(c) for c in ("user_cutoff", "train_p5_cutoff") if c in table.columns]
    stats = table.groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("n_test"), *first,
        *_outside(table, "user_cutoff", "user_cutoff"), *_outside(table, "train_p5", "train_p5"),
    )
    med = quantiles(table, "max_similarity_to_train", {"median_similarity_to_train": 0.5}, ["feature_set"])
    out = stats.join(med, "feature_set").withColumn("n_train", F.lit(n_train).cast("bigint"))
    return _best_first(out, SINGLE_RULES[best_by], "median_similarity_to_train")


def dual_ad_summary(table: DataFrame, n_other: int, n_finetune: int, *, best_by: str = "finetune_p5", label: str | None = None) -> DataFrame:
    """One row per feature set of a ``dual_ad_table``; the best set is flagged."""
    if best_by not in DUAL_RULES:
        raise ValueError(f"best_by must be one of {sorted(DUAL_RULES)}")
    cuts = ("user_cutoff", "train_all_p5_cutoff", "train_finetune_p5_cutoff")
    aggs = [F.count(F.lit(1)).alias("n_test"), *[F.first(c).alias(c) for c in cuts if c in table.columns]]
    for s in ("all", "finetune"):
        aggs.append(F.avg(f"mean_topk_similarity_to_train_{s}").alias(f"mean_topk_similarity_to_train_{s}"))
        aggs += _outside(table, f"train_{s}_user_cutoff", f"user_cutoff_{s}") + _outside(table, f"train_{s}_p5", f"train_{s}_p5")
    out = table.groupBy("feature_set").agg(*aggs)
    for s in ("all", "finetune"):
        out = out.join(
            quantiles(table, f"max_similarity_to_train_{s}", {f"median_similarity_to_train_{s}": 0.5}, ["feature_set"]), "feature_set")
    gain = F.col("mean_topk_similarity_to_train_finetune") - F.col("mean_topk_similarity_to_train_all")
    out = out.withColumns({
        "n_train_other": F.lit(n_other).cast("bigint"),
        "n_train_finetune": F.lit(n_finetune).cast("bigint"),
        "finetune_subset_label": F.lit(label).cast("string"),
        "delta_mean_topk_finetune_minus_all": gain,
        "fine_tuning_preferred": gain > 0,
    })
    tie = "median_similarity_to_train_finetune" if "finetune" in best_by else "median_similarity_to_train_all"
    return _best_first(out, DUAL_RULES[best_by], tie)


def run_ad_batch(train: DataFrame, test: DataFrame, blocks, feature_sets, *, best_by: str = "user_cutoff", **options) -> tuple[DataFrame, DataFrame]:
    """Table and summary over many feature sets at once; the table is stored before it is summarised."""
    table = cut_lineage(ad_table(train, test, blocks, feature_sets, **options))
    return table, ad_summary(table, train.count(), best_by=best_by)


def run_dual_ad_batch(train: DataFrame, test: DataFrame, blocks, feature_sets, *, finetune_col: str = "is_finetune",
                      best_by: str = "finetune_p5", label: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    table = cut_lineage(dual_ad_table(train, test, blocks, feature_sets, finetune_col=finetune_col, **options))
    sizes = train.agg(F.count_if(~F.col(finetune_col)).alias("o"), F.count_if(F.col(finetune_col)).alias("f")).first()
    return table, dual_ad_summary(table, sizes["o"], sizes["f"], best_by=best_by, label=label)


def write_ad_batch(table: DataFrame, summary: DataFrame, path: str) -> None:
    """A batch's table, partitioned by feature set, and its summary beside it, as Parquet."""
    table.write.mode("overwrite").partitionBy("feature_set").parquet(f"{path}/table")
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def stacked(df: DataFrame, blocks: Sequence[Block], out: str = "stacked") -> DataFrame:
    """All blocks of a feature set as one dense array, the on-bits of binary blocks as ones."""

    def part(b: Block) -> Column:
        if b.family == "binary":
            return F.transform(F.sequence(F.lit(0), F.lit(b.width - 1)), lambda i: F.array_contains(b.column, i).cast("double"))
        return F.col(b.column).cast("array<double>")

    return df.withColumn(out, F.concat(*[part(b) for b in blocks]))


def pca_blocks(train: DataFrame, test: DataFrame, blocks: Sequence[Block], *, id_col: str = "id", dims: int = 2) -> DataFrame:
    """Principal coordinates of training and test rows together over all blocks of a feature set, with ``role``."""
    both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")), allowMissingColumns=True)
    rows = stacked(both, blocks).select(F.struct(id_col, "role").alias("_who"), "stacked")
    return pca_coordinates(rows, "stacked", id_col="_who", dims=dims).select("_who.*", *[f"pc{i + 1}" for i in range(dims)])


def pca_coordinates(df: DataFrame, vector_col: str, *, id_col: str = "id", dims: int = 2) -> DataFrame:
    """First principal coordinates of a dense array column. MLlib does not centre when it projects, so a
    mean-only scaler comes first; the sign of an axis is arbitrary."""
    data = df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data)
    centred = scaler.transform(data)
    model = PCA(k=dims, inputCol="_c", outputCol="_p").fit(centred)
    at = vector_to_array(F.col("_p"))
    return model.transform(centred).select(id_col, *[at[i].alias(f"pc{i + 1}") for i in range(dims)])
