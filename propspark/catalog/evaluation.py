"""Metric, bootstrap and model-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import PRICE_PAIRS, price_pairs, r6, table
from propspark.functions.scalars import abs_error, squared_error
from propspark.operators.lookups import missing_keys, pair_predictions
from propspark.operators.metrics import metric_table
from propspark.operators.resample import _POISSON_CDF, REPORT_METRICS, bootstrap_metrics, split_metrics, split_weights
from propspark.plans import evaluate as E
from propspark.session import cut_lineage

SAMPLES = 1000


def row_errors(spark, root):
    p = price_pairs(spark, root).groupBy("l_orderkey").agg(F.sum("y_true").alias("t"), F.sum("y_pred").alias("p"))
    return p.select("l_orderkey", r6(abs_error("t", "p"), "abs_error"), F.round(squared_error("t", "p") / 1e6, 3).alias("squared_error"))


def error_metrics(spark, root):
    m = metric_table(price_pairs(spark, root), "y_true", "y_pred", metrics=["rmse", "mae", "r2", "rae"], by=["p_brand"])
    return m.select("p_brand", "n", *[r6(c) for c in ("rmse", "mae", "r2", "rae")])


def constant_target(spark, root):
    """Both rules for a constant target: 0 when scoring models, missing when evaluating."""
    p = price_pairs(spark, root).withColumn("y_true", F.when(F.col("l_returnflag") != "A", F.col("y_true")).otherwise(F.lit(1.0)))
    kw = dict(metrics=["r2", "spearman_rho", "kendall_tau"], by=["l_returnflag"])
    p = p.withColumn("y_pred", F.col("l_quantity")).withColumn("y_true", F.floor(F.col("y_true") / 5000))
    a = metric_table(p, "y_true", "y_pred", **kw)
    b = metric_table(p, "y_true", "y_pred", undefined_as_zero=False, **kw)
    cols = kw["metrics"]
    return a.select("l_returnflag", *[r6(c, f"{c}_model") for c in cols]).join(b.select("l_returnflag", *[r6(c, f"{c}_eval") for c in cols]), "l_returnflag")


def spearman(spark, root):
    m = metric_table(price_pairs(spark, root), "y_true", "y_pred", metrics=["spearman_rho"], by=["l_returnflag", "l_linenumber"])
    return m.select("l_returnflag", "l_linenumber", "n", r6("spearman_rho"))


def spearman_sorted(spark, root):
    """The distributed form for groups too large for one task, forced here."""
    m = metric_table(price_pairs(spark, root), "y_true", "y_pred", metrics=["spearman_rho"], by=["l_returnflag"], leaf=1000)
    return m.select("l_returnflag", "n", r6("spearman_rho"))


def kendall(spark, root):
    return metric_table(table(spark, root, "orders"), "o_totalprice", "o_custkey", metrics=["kendall_tau"]).select("n", F.round("kendall_tau", 9).alias("kendall_tau"))


def kendall_tied(spark, root):
    m = metric_table(table(spark, root, "lineitem"), "l_quantity", "l_discount", metrics=["kendall_tau"], by=["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("kendall_tau", 9).alias("kendall_tau"))


def rank_pvalues(spark, root):
    m = metric_table(table(spark, root, "events"), "value", "user_id", metrics=["spearman_pvalue", "kendall_tau_pvalue"], by=["event_type"])
    return m.select("event_type", "n", r6("spearman_pvalue"), r6("kendall_tau_pvalue"))


def _suppliers(spark, root):
    """Truth and predictions per supplier: mean price, and mean quantity times a mean list price."""
    means = price_pairs(spark, root).groupBy(F.col("l_suppkey").alias("key")).agg(
        F.avg("y_true").alias("price"), F.avg("y_pred").alias("price_hat"), F.avg("l_quantity").alias("qty"),
        (F.avg("y_pred") / F.avg("p_retailprice")).alias("qty_hat"))
    return cut_lineage(means)


def prediction_pairs(spark, root):
    s = _suppliers(spark, root)
    out = pair_predictions(s.select("key", F.col("price_hat").alias("HLM")), s.select("key", F.col("price").alias("HLM")), "key", "HLM").orderBy("key")
    return out.select("key", r6("HLM_pred"), r6("HLM_true"))


def unpredicted_keys(spark, root):
    pred = table(spark, root, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("key"))
    return missing_keys(pred, table(spark, root, "part").select(F.col("p_partkey").alias("key")), "key")


def _log_pairs(spark, root):
    s = _suppliers(spark, root)
    pred = s.select("key", F.col("price_hat").alias("PRICE"), F.col("qty_hat").cast("string").alias("QTY"))
    true = s.select("key", F.col("price").alias("PRICE"), F.col("qty").alias("QTY"))
    return E.scored_pairs(pred, true, "key", ["PRICE", "QTY"])


def bootstrap(spark, root):
    """Long table of every resample and metric."""
    m = bootstrap_metrics(_log_pairs(spark, root), "y_true", "y_pred", by=["Endpoint"], key="key", samples=SAMPLES)
    return m.select("Endpoint", "Sample", "Metric", r6("Value"))


def bootstrap_poisson(spark, root):
    """Approximate form for very large tables."""
    m = bootstrap_metrics(_log_pairs(spark, root), "y_true", "y_pred", by=["Endpoint"], key="key", samples=SAMPLES, method="poisson")
    return m.groupBy("Endpoint", "Metric").agg(r6(F.avg("Value"), "mean"))


def bootstrap_weights(spark, root):
    """Resamples by splitting: every one draws as many rows as its endpoint has, none below 0."""
    w = split_weights(_log_pairs(spark, root), ["Endpoint"], "key", samples=SAMPLES, block_rows=16)
    return w.groupBy("Endpoint", "Sample").agg(F.sum("_weight").alias("n"), F.min("_weight").alias("least"))


def bootstrap_split(spark, root):
    """Over the resamples by splitting, the mean error lies around that of all rows, and spreads as a mean of n rows does."""
    pairs = _log_pairs(spark, root)
    err = F.abs(F.col("y_true") - F.col("y_pred"))
    plain = pairs.groupBy("Endpoint").agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), (F.stddev_pop(err) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    boot = split_metrics(pairs, "y_true", "y_pred", by=["Endpoint"], key="key", samples=SAMPLES, block_rows=16)
    boot = boot.groupBy("Endpoint").agg(F.count(F.lit(1)).alias("samples"), F.avg("mae").alias("m"), F.stddev("mae").alias("s"), F.max("r2").alias("r2"), F.min("rae").alias("rae"))
    near = F.abs(F.col("m") - F.col("mae")) <= 6 * F.col("se") / F.sqrt(F.lit(SAMPLES))
    spread = F.col("s").between(0.8 * F.col("se"), 1.25 * F.col("se"))
    return plain.join(boot, "Endpoint").select("Endpoint", "n", "samples", r6("mae"), near.alias("mean_near"), spread.alias("spread_near"), ((F.col("r2") <= 1) & (F.col("rae") >= 0)).alias("bounded"))


def evaluation(spark, root):
    out = E.evaluation_table(_log_pairs(spark, root), "key", samples=SAMPLES)
    return out.select("Endpoint", *[r6(F.col(f"`{c}`"), c) for c in out.columns if c != "Endpoint"])


def model_comparison(spark, root):
    """Three models, each the mean price under one return flag, against the overall mean price."""
    flag = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("y_true"))).alias(f)
    means = price_pairs(spark, root).groupBy(F.col("l_suppkey").alias("key")).agg(F.avg("y_true").alias("value_true"), flag("A"), flag("N"), flag("R"))
    true = cut_lineage(means)
    models = {"flag_A": true.select("key", F.log1p("A").cast("string").alias("y_pred_log1p")),
              "flag_N": true.select("key", F.col("N").alias("y_pred_normal")),
              "flag_R": true.select("key", F.log1p("R").alias("y_pred_log1p"))}
    out = E.compare_models(models, true, "key", "value_true", samples=SAMPLES)
    return out.select(F.col("Rank").cast("bigint").alias("Rank"), "Name", "Endpoint", *[r6(F.col(f"`{c}`"), c) for c in out.columns[3:]])


def scatter(spark, root):
    s = _suppliers(spark, root).select("key", "price", F.log1p("price_hat").alias("y_pred_log1p"), F.when(F.col("qty") > 25.5, " True").otherwise("no").alias("outside"))
    out = E.scatter_table(s, "price", flag_col="outside")
    return out.select("key", *[r6(c) for c in ("measured", "predicted", "line_min", "line_max")], "outside_ad")


def domain_errors(spark, root):
    """Errors inside and outside a domain flag, and for rows without one."""
    p = price_pairs(spark, root)
    flags = table(spark, root, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("outside"))
    m = E.errors_by_domain(p.drop("outside"), flags, "l_partkey", "outside", "y_true", "y_pred", metrics=["rmse", "mae"])
    return m.select("outside", "n", r6("rmse"), r6("mae"))


QUERIES = {f.__name__: f for f in (
    row_errors, error_metrics, constant_target, spearman, spearman_sorted, kendall, kendall_tied, rank_pvalues, prediction_pairs, unpredicted_keys,
    bootstrap, bootstrap_poisson, bootstrap_weights, bootstrap_split, evaluation, model_comparison, scatter, domain_errors,
)}


def tau_sql(rows: str, keys: str, on: str) -> str:
    """tau-b by pairs of distinct weighted rows: table with keys, x, y, w."""
    k = f"{keys}, " if keys else ""
    grp = f"group by {keys}" if keys else ""
    return f"""with d as materialized (select {k}x, y, count(*) as w from {rows} group by all),
        s as (select {', '.join('a.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 as s from d a join d b on {on} group by all),
        n as (select {k}sum(w) as n from d {grp}), tx as (select {k}sum(t * (t - 1) / 2) as tx from (select {k}x, sum(w) as t from d group by all) {grp}),
        ty as (select {k}sum(t * (t - 1) / 2) as ty from (select {k}y, sum(w) as t from d group by all) {grp})"""


_TAU = "s / nullif(sqrt(n * (n - 1) / 2 - tx) * sqrt(n * (n - 1) / 2 - ty), 0)"


def rho_sql(rows: str, keys: str) -> str:
    return f"""(select {keys}, count(*) as n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as rho from (select {keys},
        rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0 as rx,
        rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0 as ry from {rows}) group by {keys})"""


_SUP = f"""(select l_suppkey as key, avg(y_true) as price, avg(y_pred) as price_hat, avg(l_quantity) as qty, avg(y_pred) / avg(p_retailprice) as qty_hat
 from (select a.*, p_retailprice from {PRICE_PAIRS} a join part on p_partkey = l_partkey) group by 1)"""


def poisson_sql(samples: int) -> str:
    """Rows repeated by their Poisson(1) weight."""
    u = "('0x' || substr(md5('0:' || Sample || ':' || key), 1, 15))::bigint / 1152921504606846976::double"
    weight = " + ".join(f"(u >= {c!r}::double)::int" for c in _POISSON_CDF)
    return f"""w as (select *, {u} as u from p, range({samples}) r(Sample)),
        b as materialized (select Endpoint, Sample, x, y from (select *, unnest(range({weight})) from w))"""


def boot_sql(pairs: str, keys: str, draws: str | None = None) -> str:
    """Resamples of (keys, key, x, y) in log scale and their metrics in long form."""
    ks = [c.strip() for c in keys.split(",")]
    on = " and ".join(f"a.{c} = b.{c}" for c in [*ks, "Sample"])
    draws = draws or f"""draw as (select {keys}, Sample, ('0x' || substr(md5('0:' || Sample || ':' || pos), 1, 15))::bigint % size as pos from p, range({SAMPLES}) r(Sample)),
        b as materialized (select {', '.join('p.' + c for c in ks)}, Sample, x, y from draw join p on p.pos = draw.pos and {' and '.join(f'p.{c} = draw.{c}' for c in ks)})"""
    return f"""with p as materialized (select {keys}, key, log10(greatest(x, 0) + 1) as x, log10(greatest(y, 0) + 1) as y,
          row_number() over (partition by {keys} order by key) - 1 as pos, count(*) over (partition by {keys}) as size from ({pairs}) where x is not null and y is not null),
        {draws},
        m as (select {keys}, Sample, avg(x) as mx from b group by all),
        e as (select {', '.join('b.' + c for c in ks)}, b.Sample, avg(abs(x - y)) as mae, avg(abs(x - y)) / nullif(avg(abs(x - mx)), 0) as rae,
          1 - sum(pow(x - y, 2)) / nullif(sum(pow(x - mx, 2)), 0) as r2 from b join m on {' and '.join(f'b.{c} = m.{c}' for c in [*ks, 'Sample'])} group by all),
        sp as {rho_sql('b', keys + ', Sample')},
        d as (select {keys}, Sample, x, y, count(*) as w from b group by all),
        s as (select {', '.join('a.' + c for c in ks)}, a.Sample, sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 as s from d a join d b on {on} group by all),
        tx as (select {keys}, Sample, sum(t) as n, sum(t * (t - 1) / 2) as tx from (select {keys}, Sample, x, sum(w) as t from d group by all) group by all),
        ty as (select {keys}, Sample, sum(t * (t - 1) / 2) as ty from (select {keys}, Sample, y, sum(w) as t from d group by all) group by all),
        a as (select * from e join sp using ({keys}, Sample) join s using ({keys}, Sample) join tx using ({keys}, Sample) join ty using ({keys}, Sample)),
        long as (select {keys}, Sample, unnest(['MAE', 'RAE', 'R2', 'Spearman R', 'Kendall''s Tau']) as Metric,
          unnest([mae, rae, r2, rho, s / nullif(sqrt(tx.n * (tx.n - 1) / 2 - tx) * sqrt(tx.n * (tx.n - 1) / 2 - ty), 0)]) as Value from a)""".replace("tx.n", "cnt").replace(
        "sum(t) as n, sum(t * (t - 1) / 2) as tx", "sum(t)::double as cnt, sum(t * (t - 1) / 2) as tx")


_M = list(REPORT_METRICS)


def _quoted(m: str) -> str:
    return m.replace("'", "''")


def _wide(keys: str) -> str:
    cols = [f"avg(Value) filter (where Metric = '{_quoted(m)}') as \"mean_{m}\"" for m in _M] + [
        f"stddev_samp(Value) filter (where Metric = '{_quoted(m)}') as \"std_{m}\"" for m in _M]
    return f"select {keys}, {', '.join(cols)} from long group by all"


_NAMES = [f"{s}_{m}" for s in ("mean", "std") for m in _M]
_ROUNDED = ", ".join(f'round("{c}", 6) as "{c}"' for c in _NAMES)
_ENDS = f"select 'PRICE' as Endpoint, key, price as x, price_hat as y from {_SUP} union all select 'QTY', key, qty, qty_hat from {_SUP}"
_FLAG = f"""select 'flag_' || l_returnflag as Name, l_suppkey as key, t as x, avg(y_true) as y from {PRICE_PAIRS} join
 (select l_suppkey as sk, avg(l_extendedprice) as t from lineitem group by 1) on sk = l_suppkey group by all"""
_CONST = f"""(select l_returnflag, floor(case when l_returnflag <> 'A' then y_true else 1.0 end / 5000) as x, l_quantity as y from {PRICE_PAIRS})"""

_SIMPSON = "list_sum(list_transform(range(0, 8001), lambda i: (case when i in (0, 8000) then 1 when i % 2 = 1 then 4 else 2 end) * {f})) * ({b} - ({a})) / 8000 / 3"


def pvalues_sql() -> str:
    """Both tails by Simpson's rule: Student's as an integral of powers of the cosine, the normal one as it stands."""
    rows = "(select event_type, value as x, user_id as y from events)"
    ties = lambda c: f"""t{c}_ as (select event_type, sum(t * (t - 1) * (2 * t + 5))::double as {c}1, sum(t * (t - 1) * (t - 2))::double as {c}0
        from (select event_type, {c}, sum(w) as t from d group by all) group by 1)"""  # noqa: E731
    step = lambda a, b: f"({a} + i * ({b} - ({a})) / 8000)"
    student = _SIMPSON.format(f=f"pow(cos({step('th', 'top')}), df - 1)", a="th", b="top")
    normal = _SIMPSON.format(f=f"exp(-pow({step('z', '(z + 8)')}, 2))", a="z", b="(z + 8)")
    return tau_sql(rows, "event_type", "a.event_type = b.event_type") + f""", {ties('x')}, {ties('y')}, r as {rho_sql(rows, 'event_type')},
        v as (select event_type, s, n::double as n, n * (n - 1)::double as m, tx.tx::double as xt, ty.ty::double as yt, x1, x0, y1, y0 from s join n using (event_type) join tx using (event_type)
          join ty using (event_type) join tx2 using (event_type) join ty2 using (event_type)),
        k as (select event_type, n, abs(s) / sqrt((m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + x0 * y0 / (9 * m * (n - 2))) / sqrt(2) as z from v),
        q as (select event_type, n - 2 as df, atan(abs(rho) / sqrt(1 - rho * rho)) as th from r), u as (select *, least(pi() / 2, th + 14 / sqrt(df)) as top from q)
        select event_type, n::bigint as n, round(2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * {student}, 6) as spearman_pvalue,
          round(2 / sqrt(pi()) * {normal}, 6) as kendall_tau_pvalue from k join u using (event_type)""".replace("tx2", "tx_").replace("ty2", "ty_")


ORACLES = {
    "rank_pvalues": pvalues_sql(),
    "row_errors": f"""select l_orderkey, round(abs(sum(y_true) - sum(y_pred)), 6) as abs_error, round(pow(sum(y_true) - sum(y_pred), 2) / 1e6::double, 3) as squared_error
        from {PRICE_PAIRS} group by 1""",
    "error_metrics": f"""with p as {PRICE_PAIRS}, m as (select p_brand as b, avg(y_true) as mu from p group by 1)
        select p_brand, count(*) as n, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae,
        round(1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - mu, 2)), 6) as r2, round(avg(abs(y_true - y_pred)) / avg(abs(y_true - mu)), 6) as rae
        from p join m on b = p_brand group by 1""",
    "constant_target": tau_sql(_CONST, "l_returnflag", "a.l_returnflag = b.l_returnflag") + f""", t as (select l_returnflag, {_TAU} as tau from s join n using (l_returnflag)
        join tx using (l_returnflag) join ty using (l_returnflag)), r as {rho_sql(_CONST, 'l_returnflag')},
        q as (select l_returnflag, 1 - sum(pow(x - y, 2)) / nullif(sum(pow(x - mu, 2)), 0) as r2 from {_CONST} join (select l_returnflag as f, avg(x) as mu from {_CONST} group by 1) on f = l_returnflag group by 1)
        select l_returnflag, round(coalesce(r2, 0), 6) as r2_model, round(coalesce(rho, 0), 6) as spearman_rho_model, round(coalesce(tau, 0), 6) as kendall_tau_model,
        round(r2, 6) as r2_eval, round(rho, 6) as spearman_rho_eval, round(tau, 6) as kendall_tau_eval from q join r using (l_returnflag) join t using (l_returnflag)""",
    "spearman": f"""select l_returnflag, l_linenumber, n, round(rho, 6) as spearman_rho from {rho_sql(f'(select l_returnflag, l_linenumber, y_true as x, y_pred as y from {PRICE_PAIRS})', 'l_returnflag, l_linenumber')}""",
    "spearman_sorted": f"""select l_returnflag, n, round(rho, 6) as spearman_rho from {rho_sql(f'(select l_returnflag, y_true as x, y_pred as y from {PRICE_PAIRS})', 'l_returnflag')}""",
    "kendall": tau_sql("(select o_totalprice as x, o_custkey as y from orders)", "", "a.x < b.x or a.x > b.x") + f" select n::bigint as n, round({_TAU}, 9) as kendall_tau from s, n, tx, ty",
    "kendall_tied": tau_sql("(select l_returnflag, l_quantity as x, l_discount as y from lineitem)", "l_returnflag", "a.l_returnflag = b.l_returnflag")
    + f" select l_returnflag, n::bigint as n, round({_TAU}, 9) as kendall_tau from s join n using (l_returnflag) join tx using (l_returnflag) join ty using (l_returnflag)",
    "prediction_pairs": f"select key, round(price_hat, 6) as \"HLM_pred\", round(price, 6) as \"HLM_true\" from {_SUP}",
    "unpredicted_keys": "select p_partkey as key from part except select l_partkey from lineitem where l_quantity > 49",
    "bootstrap": boot_sql(_ENDS, "Endpoint") + ' select Endpoint as "Endpoint", Sample as "Sample", Metric as "Metric", round(Value, 6) as "Value" from long',
    "bootstrap_poisson": boot_sql(_ENDS, "Endpoint", poisson_sql(SAMPLES))
    + ' select Endpoint as "Endpoint", Metric as "Metric", round(avg(Value), 6) as mean from long group by 1, 2',
    "bootstrap_weights": f'select Endpoint as "Endpoint", r.Sample::int as "Sample", count(*) as n, 1::bigint as least from ({_ENDS}), range({SAMPLES}) r(Sample) where x is not null and y is not null group by all',
    "bootstrap_split": f"""with p as (select Endpoint, abs(log10(greatest(x, 0) + 1) - log10(greatest(y, 0) + 1)) as e from ({_ENDS}) where x is not null and y is not null)
        select Endpoint as "Endpoint", count(*) as n, {SAMPLES}::bigint as samples, round(avg(e), 6) as mae, true as mean_near, true as spread_near, true as bounded from p group by 1""",
    "evaluation": boot_sql(_ENDS, "Endpoint") + f""", w as ({_wide('Endpoint')}), u as (select * from w union all select 'Macro Average',
        {', '.join(f'avg("{c}")' for c in _NAMES)} from w) select Endpoint as "Endpoint", {_ROUNDED} from u""",
    "model_comparison": boot_sql(_FLAG, "Name") + f""", w as ({_wide('Name')}) select row_number() over (order by "mean_MAE", Name) as "Rank", Name as "Name", 'HLM' as "Endpoint", {_ROUNDED} from w""",
    "scatter": f"""with p as (select key, log10(price + 1) as m, log10(price_hat + 1) as h, qty > 25.5 as o from {_SUP}) select key, round(m, 6) as measured, round(h, 6) as predicted,
        round((select min(least(m, h)) from p), 6) as line_min, round((select max(greatest(m, h)) from p), 6) as line_max, o as outside_ad from p""",
    "domain_errors": f"""select outside, count(*) as n, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae
        from {PRICE_PAIRS} left join (select p_partkey, p_size > 25 as outside from part where p_type <> 'PROMO') on p_partkey = l_partkey group by 1""",
}
