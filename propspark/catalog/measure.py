"""Replicate collapse, summaries, histograms, selectors and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import price_pairs, r6, table
from propspark.operators import selectors as X
from propspark.operators import summaries as M
from propspark.operators.dedup import deduplicate, first_nonnull, prefer_rows
from propspark.operators.lookups import duplicate_keys
from propspark.operators.ordered import average_ranks, quantiles

KEYS = ["l_partkey", "l_suppkey"]
TARGET = "l_extendedprice"


def _rounded(df, *keep):
    return df.select(*keep, *[r6(c) for c in ("l_extendedprice_deduplicated", "y_std") if c in df.columns], "n_reps", "y_min", "y_max")


def dedup_mean(spark, root):
    return _rounded(deduplicate(table(spark, root, "lineitem"), key_cols=KEYS, target_col=TARGET), *KEYS)


def dedup_prefer(spark, root):
    """One clean value per key: keep the preferred replicates where a key has both kinds."""
    out = deduplicate(table(spark, root, "lineitem"), key_cols=KEYS, target_col=TARGET, prefer_col="l_returnflag", prefer_value="N")
    return _rounded(out, *KEYS)


def dedup_prefer_text(spark, root):
    """Text never equals a boolean: preferring the boolean false over a text column that says "False" changes nothing."""
    rows = table(spark, root, "lineitem").withColumn("scaled", F.when(F.col("l_returnflag") == "N", "False").when(F.col("l_returnflag") == "A", "x").otherwise("True"))
    out = deduplicate(rows, key_cols=KEYS, target_col=TARGET, prefer_col="scaled", prefer_value="False")
    return _rounded(out, *KEYS)


def dedup_median(spark, root):
    out = deduplicate(table(spark, root, "lineitem"), key_cols=["l_partkey"], target_col=TARGET, method="median", prefer_col="l_returnflag", prefer_value="N")
    return _rounded(out, "l_partkey")


def dedup_min_keep(spark, root):
    """Kept columns take the first non-missing value in row order."""
    e = table(spark, root, "events").withColumn("props", F.when(F.col("event_type") != "error", F.col("props")))
    out = deduplicate(e, key_cols=["user_id"], target_col="value", method="min", keep_cols=["props", "event_type", "absent"], order_cols=["event_id"])
    return out.select("user_id", "props", "event_type", "value_deduplicated", "n_reps", r6("y_std"), "y_min", "y_max")


def first_present(spark, root):
    e = table(spark, root, "events").withColumn("props", F.when(~F.col("event_type").isin("error", "click"), F.col("props")))
    return e.groupBy("user_id").agg(first_nonnull("props", ["event_id"]).alias("props"))


def preferred_rows(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", *KEYS, "l_returnflag", TARGET)
    return prefer_rows(li, key_cols=KEYS, prefer_col="l_returnflag", prefer_value="N")


def category_counts(spark, root):
    return M.counts_with_zeros(table(spark, root, "documents"), "lang", ["en", "de", "fr", "es", "it", "pt"])


def column_summary(spark, root):
    s = M.column_summary(table(spark, root, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.select("l_returnflag", "n", *[r6(c) for c in ("mean", "sd", "min", "max", "median", "mad")])


def column_summary_all(spark, root):
    s = M.column_summary(table(spark, root, "orders"), "o_totalprice")
    return s.select("n", *[r6(c) for c in ("mean", "sd", "min", "max", "median", "mad")])


def histogram(spark, root):
    return M.histogram(table(spark, root, "events"), "value", 30).select("bin", r6("left_edge"), "n")


def duplicated_keys(spark, root):
    d = duplicate_keys(table(spark, root, "documents").select(F.md5("text").alias("key")), "key")
    return d.select("key", F.col("count").alias("n"))


def column_stats(spark, root):
    s = X.column_stats(_gappy_items(spark, root), NUMBERS)
    return s.select("feature", r6("null_fraction"), F.round("variance", 3).alias("variance"))


NUMBERS = ["l_quantity", "l_discount", "l_tax", "gappy", "constant"]


def _gappy_items(spark, root):
    return table(spark, root, "lineitem").withColumns({
        "gappy": F.when(F.col("l_linenumber") > 2, F.col("l_quantity")), "constant": F.lit(1.0)})


GAPPY_ITEMS = "(select *, case when l_linenumber > 2 then l_quantity end as gappy, 1.0::double as constant from lineitem)"
LONG = " union all ".join(f"select '{c}' as feature, {c} as value from {GAPPY_ITEMS}" for c in NUMBERS)


def kept_columns(spark, root):
    return X.kept_columns(_gappy_items(spark, root), NUMBERS).select("feature")


def median_impute(spark, root):
    cols = ["gappy", "l_tax"]
    out = X.median_impute(_gappy_items(spark, root), cols)
    return out.groupBy("l_linenumber").agg(r6(F.sum("gappy"), "gappy"), r6(F.sum("l_tax"), "l_tax"))


def percentile_cutoff(spark, root):
    return quantiles(table(spark, root, "lineitem"), TARGET, {"p5": 0.05, "median": 0.5}, ["l_returnflag"]).select("l_returnflag", r6("p5"), r6("median"))


def percentile_cutoff_sorted(spark, root):
    """The distributed form used for groups too large for one task, forced here."""
    q = quantiles(table(spark, root, "lineitem"), TARGET, {"p5": 0.05, "median": 0.5}, ["l_returnflag"], group_rows=1)
    return q.select("l_returnflag", r6("p5"), r6("median"))


def tied_ranks(spark, root):
    li = table(spark, root, "lineitem").withColumn("_w", F.lit(1))
    return average_ranks(li, "l_quantity", "_w", ["l_returnflag"]).select("l_returnflag", "l_quantity", r6("rank"), "ties")


def _folds(spark, root):
    """Per (model, feature set, fold) scores derived from the rows: brand as model, type as feature set."""
    p = price_pairs(spark, root)
    return p.groupBy(F.col("l_returnflag").alias("model"), F.col("p_type").alias("feature_set"), F.col("l_linenumber").alias("outer_fold")).agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


FOLDS = """(select l_returnflag as model, p_type as feature_set, l_linenumber as outer_fold, avg(abs(y_true - y_pred)) as mae
 from (select l.*, p_type, l_extendedprice as y_true, l_quantity * p_retailprice as y_pred from lineitem l join part p on l_partkey = p_partkey) group by all)"""


def fold_summary(spark, root):
    one = _folds(spark, root).filter("feature_set <> 'PROMO' or outer_fold = 1")
    return M.fold_summary(one, ["mae"]).select("model", "feature_set", r6("mae_mean"), r6("mae_std"))


def best_combination(spark, root):
    s = M.fold_summary(_folds(spark, root), ["mae"])
    return M.best_combination(s, "mae").select("model", "feature_set", r6("mae_mean"), r6("mae_std"))


def pivot_macro(spark, root):
    long = _folds(spark, root).select(
        F.col("feature_set").alias("Endpoint"), F.concat(F.lit("M"), F.col("model")).alias("Metric"), F.col("mae").alias("Value"))
    wide = M.with_macro_average(M.pivot_metrics(long, ["MA", "MN", "MR"]))
    return wide.select("Endpoint", *[r6(c) for c in wide.columns if c != "Endpoint"])


def ranked_models(spark, root):
    s = _folds(spark, root).groupBy("model").agg(F.avg("mae").alias("mean_MAE"))
    return M.rank_rows(s, "mean_MAE", "model").select(F.col("Rank").cast("bigint").alias("Rank"), "model", r6("mean_MAE"))


QUERIES = {f.__name__: f for f in (
    dedup_mean, dedup_prefer, dedup_prefer_text, dedup_median, dedup_min_keep, first_present, preferred_rows, category_counts, column_summary,
    column_summary_all, histogram, duplicated_keys, column_stats, kept_columns, median_impute, percentile_cutoff,
    percentile_cutoff_sorted, tied_ranks, fold_summary, best_combination, pivot_macro, ranked_models,
)}

_STATS = """count(l_extendedprice) as n_reps, round(stddev_samp(l_extendedprice), 6) as y_std, min(l_extendedprice) as y_min, max(l_extendedprice) as y_max"""
_PREFER = """(select * from (select *, bool_or(l_returnflag = 'N') over (partition by {k}) as has_n from lineitem)
 where l_returnflag = 'N' or not has_n)"""
_P5 = """select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) as p5, round(quantile_cont(l_extendedprice, 0.5), 6) as median
 from lineitem group by 1"""

ORACLES = {
    "dedup_mean": f"select l_partkey, l_suppkey, round(avg(l_extendedprice), 6) as l_extendedprice_deduplicated, {_STATS} from lineitem group by 1, 2",
    "dedup_prefer": f"""select l_partkey, l_suppkey, round(avg(l_extendedprice), 6) as l_extendedprice_deduplicated, {_STATS}
        from {_PREFER.format(k='l_partkey, l_suppkey')} group by 1, 2""",
    "dedup_prefer_text": f"select l_partkey, l_suppkey, round(avg(l_extendedprice), 6) as l_extendedprice_deduplicated, {_STATS} from lineitem group by 1, 2",
    "dedup_median": f"""select l_partkey, round(median(l_extendedprice), 6) as l_extendedprice_deduplicated, {_STATS}
        from {_PREFER.format(k='l_partkey')} group by 1""",
    "dedup_min_keep": """select user_id, arg_min(props, event_id) filter (where event_type <> 'error') as props, arg_min(event_type, event_id) as event_type,
        min(value) as value_deduplicated, count(value) as n_reps, round(stddev_samp(value), 6) as y_std, min(value) as y_min, max(value) as y_max
        from events group by 1""",
    "first_present": "select user_id, arg_min(props, event_id) filter (where event_type not in ('error', 'click')) as props from events group by 1",
    "preferred_rows": f"select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_extendedprice from {_PREFER.format(k='l_partkey, l_suppkey')}",
    "category_counts": """select v.lang, count(d.doc_id) as n from (values ('en'), ('de'), ('fr'), ('es'), ('it'), ('pt')) v(lang)
        left join documents d on d.lang = v.lang group by 1""",
    "column_summary": """with m as (select l_returnflag as g, median(l_quantity) as med from lineitem group by 1)
        select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, min(l_quantity) as min,
        max(l_quantity) as max, median(l_quantity) as median, median(abs(l_quantity - med)) as mad from lineitem join m on g = l_returnflag group by 1""",
    "column_summary_all": """select count(*) as n, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as sd,
        round(min(o_totalprice), 6) as min, round(max(o_totalprice), 6) as max, round(median(o_totalprice), 6) as median,
        round(median(abs(o_totalprice - (select median(o_totalprice) from orders))), 6) as mad from orders""",
    "histogram": """with b as (select min(value) as lo, max(value) as hi from events),
        c as (select cast(least(floor((value - lo) / ((hi - lo) / 30)), 29) as int) as bin, count(*) as n from events, b group by 1)
        select cast(i as int) as bin, round(lo + i * ((hi - lo) / 30), 6) as left_edge, coalesce(n, 0) as n
        from b, range(30) r(i) left join c on bin = i""",
    "duplicated_keys": "select md5(text) as key, count(*) as n from documents group by 1 having count(*) > 1",
    "column_stats": f"""select feature, round(avg((value is null)::int), 6) as null_fraction, round(var_pop(value), 3) as variance
        from ({LONG}) group by 1""",
    "kept_columns": f"select feature from ({LONG}) group by 1 having avg((value is null)::int) <= 0.2 and var_pop(value) > 0",
    "median_impute": f"""select l_linenumber, round(sum(coalesce(gappy, (select median(gappy) from {GAPPY_ITEMS}))), 6) as gappy, round(sum(l_tax), 6) as l_tax
        from {GAPPY_ITEMS} group by 1""",
    "percentile_cutoff": _P5,
    "percentile_cutoff_sorted": _P5,
    "tied_ranks": """with d as (select l_returnflag, l_quantity, count(*) as ties from lineitem group by 1, 2)
        select l_returnflag, l_quantity, round(sum(ties) over (partition by l_returnflag order by l_quantity) - (ties - 1) / 2.0, 6) as rank, ties from d""",
    "fold_summary": f"""select model, feature_set, round(avg(mae), 6) as mae_mean, round(coalesce(stddev_samp(mae), 0), 6) as mae_std
        from {FOLDS} where feature_set <> 'PROMO' or outer_fold = 1 group by 1, 2""",
    "best_combination": f"""select model, feature_set, round(avg(mae), 6) as mae_mean, round(coalesce(stddev_samp(mae), 0), 6) as mae_std
        from {FOLDS} group by 1, 2 order by avg(mae), model, feature_set limit 1""",
    "pivot_macro": f"""with w as (select feature_set as "Endpoint", {', '.join(f"avg(mae) filter (where model = '{m}') as mean_M{m}" for m in 'ANR')},
        {', '.join(f"stddev_samp(mae) filter (where model = '{m}') as std_M{m}" for m in 'ANR')} from {FOLDS} group by 1),
        u as (select * from w union all select 'Macro Average', avg(mean_MA), avg(mean_MN), avg(mean_MR), avg(std_MA), avg(std_MN), avg(std_MR) from w)
        select "Endpoint", {', '.join(f'round({s}_M{m}, 6) as "{s}_M{m}"' for s in ('mean', 'std') for m in 'ANR')} from u""",
    "ranked_models": f"""select row_number() over (order by m, model) as "Rank", model, round(m, 6) as "mean_MAE"
        from (select model, avg(mae) as m from {FOLDS} group by 1)""",
}
