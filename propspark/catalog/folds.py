"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import table
from propspark.operators import folds as S


def random_folds(spark, root):
    return S.random_folds(table(spark, root, "orders").select("o_orderkey"), "o_orderkey", 7, seed=3)


def group_folds(spark, root):
    out = S.group_folds(table(spark, root, "lineitem").select("l_suppkey", "l_linenumber"), "l_suppkey", 5)
    return out.groupBy("l_suppkey", "fold").agg(F.count(F.lit(1)).alias("n"))


def group_fold_sizes(spark, root):
    out = S.group_folds(table(spark, root, "lineitem").select("l_partkey"), "l_partkey", 5)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_groups"))


def derived_key_folds(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang", "source")
    key = F.when(F.col("source") != "src5", F.concat_ws("/", "lang", "source"))
    return S.derived_group_folds(d, key, 5, order_col="doc_id").select("doc_id", "fold")


def time_splits(spark, root):
    out = S.time_splits(table(spark, root, "events"), "ts", "event_id", 4)
    return out.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.sum("event_id").alias("total"))


def holdout_random(spark, root):
    return S.holdout(table(spark, root, "orders").select("o_orderkey"), "o_orderkey", S.SplitConfig("random", random_state=5), 0.1)


def holdout_time(spark, root):
    cfg = S.SplitConfig("time_series", time_column="ts")
    return S.holdout(table(spark, root, "events").select("event_id", "ts"), "event_id", cfg, 0.2).select("event_id", "is_valid")


def holdout_group(spark, root):
    """Whole groups are held out: fold 1 of five."""
    cfg = S.SplitConfig("group", group_column="l_suppkey")
    out = S.holdout(table(spark, root, "lineitem").select("l_suppkey", "l_linenumber"), "l_linenumber", cfg, 0.2)
    return out.groupBy("l_suppkey", "is_valid").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (random_folds, group_folds, group_fold_sizes, derived_key_folds, time_splits, holdout_random, holdout_time, holdout_group)}


def greedy_sql(sizes: str, order: str, k: int) -> str:
    """Group by group: the next largest group goes to the lightest fold, lowest number first."""
    return f"""with recursive g as materialized (select *, row_number() over (order by {order}) as i from ({sizes})),
        r as (select 0::bigint as i, null::varchar as key, 0::bigint as fold, [{', '.join('0' * k)}]::bigint[] as loads union all
        select g.i, g.key, list_position(loads, list_min(loads)), list_transform(loads, lambda x, j: case when j = list_position(loads, list_min(loads)) then x + g.n else x end)
        from r join g on g.i = r.i + 1)"""


ORACLES = {
    "random_folds": "select o_orderkey, ntile(7) over (order by md5('3:' || o_orderkey), o_orderkey) as fold from orders",
    "group_folds": greedy_sql("select l_suppkey::varchar as key, count(*) as n from lineitem group by 1", "n desc, key desc", 5)
    + " select l_suppkey, fold, count(*) as n from lineitem join r on key = l_suppkey::varchar group by 1, 2",
    "holdout_group": greedy_sql("select l_suppkey::varchar as key, count(*) as n from lineitem group by 1", "n desc, key desc", 5)
    + " select l_suppkey, fold = 1 as is_valid, count(*) as n from lineitem join r on key = l_suppkey::varchar group by 1, 2",
    "group_fold_sizes": greedy_sql("select l_partkey::varchar as key, count(*) as n from lineitem group by 1", "n desc, key desc", 5)
    + " select fold, count(*) as n, count(distinct l_partkey) as n_groups from lineitem join r on key = l_partkey::varchar group by 1",
    "derived_key_folds": greedy_sql("""select case when source <> 'src5' then lang || '/' || source else '' end as key, count(*) as n, min(doc_id) as f
        from documents group by 1""", "n desc, f, key", 5)
    + " select doc_id, fold from documents join r on key = case when source <> 'src5' then lang || '/' || source else '' end",
    "time_splits": """with e as (select event_id, row_number() over (order by ts, event_id) - 1 as i, (select count(*) from events) as n from events),
        s as (select event_id, i, split, n // 5 as size, n - 4 * (n // 5) + (split - 1) * (n // 5) as start from e, range(1, 5) r(split))
        select split, case when i < start then 'train' else 'test' end as role, count(*) as n, min(event_id) as lo, max(event_id) as hi, sum(event_id)::bigint as total
        from s where i < start + size group by 1, 2""",
    "holdout_random": """select o_orderkey, row_number() over (order by md5('5:' || o_orderkey), o_orderkey) <= (select ceil(count(*) * 0.1) from orders) as is_valid from orders""",
    "holdout_time": """select event_id, row_number() over (order by ts, event_id) > (select count(*) - ceil(count(*) * 0.2) from events) as is_valid from events""",
}
