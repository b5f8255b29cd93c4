"""Scans, sinks, projections, filters, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import r6, scratch, table
from propspark.functions import scalars as S
from propspark.functions.text import contains_all, contains_any
from propspark.operators import lookups as L
from propspark.operators import rows as R
from propspark.operators.ordered import sequential_ids, time_sorted
from propspark.operators.summaries import sorted_distinct
from propspark.sources import tables as io


def scan_required_columns(spark, root):
    df = io.read_table(spark, f"{root}/lineitem.parquet", required=["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def sink_csv_roundtrip(spark, root):
    """Written with a leaked index column, read back with a schema and without that column."""
    path = scratch(spark) + "/orders.csv"
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("Unnamed: 0"), "o_orderkey", "o_orderstatus", "o_totalprice")
    io.write_table(orders, path, fmt="csv")
    schema = "`Unnamed: 0` bigint, o_orderkey bigint, o_orderstatus string, o_totalprice double"
    return io.read_table(spark, path, schema=schema, required=["o_orderkey"])


def sink_buckets(spark, root):
    path = scratch(spark) + "/buckets"
    io.write_buckets(table(spark, root, "lineitem").select("l_returnflag", "l_quantity"), path, "l_returnflag")
    return io.read_table(spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def sink_split(spark, root):
    path = scratch(spark)
    df = table(spark, root, "events").select("event_id", "event_type", "value")
    io.write_split(df, F.col("event_type") == "purchase", f"{path}/yes", f"{path}/no")
    parts = [io.read_table(spark, f"{path}/{s}").withColumn("side", F.lit(s)) for s in ("yes", "no")]
    return R.union_all(parts).groupBy("side", "event_type").agg(F.count(F.lit(1)).alias("n"))


def lookup_export(spark, root):
    df = table(spark, root, "nation").withColumn("n_name", F.when(F.col("n_regionkey") != 2, F.col("n_name")))
    return io.lookup_table(df, "n_nationkey", "n_name")


def _gappy_events(spark, root):
    e = table(spark, root, "events")
    return e.withColumns({
        "props": F.when(F.col("event_type") != "error", F.col("props")),
        "value": F.when(F.col("event_type") != "view", F.col("value")),
    })


GAPPY = """(select event_id, ts, user_id, event_type, case when event_type <> 'view' then value end as value,
 case when event_type <> 'error' then props end as props from events)"""


def complete_rows(spark, root):
    return R.complete_rows(_gappy_events(spark, root), ["event_id", "props", "value"])


def present_renamed(spark, root):
    return R.present_and_renamed(_gappy_events(spark, root).select("event_id", "value"), "value", "hlm_value_true")


def exclude_values(spark, root):
    """A missing key is in no list and stays."""
    part = table(spark, root, "part").withColumn("p_type", F.when(F.col("p_size") != 7, F.col("p_type")))
    return R.exclude_values(part, "p_type", ["ECONOMY", "PROMO"], value_col="p_retailprice").select("p_partkey", "p_type")


def allow_values(spark, root):
    return R.allow_values(table(spark, root, "events"), "event_type", ["click", "signup"]).select("event_id", "event_type")


def unflagged_rows(spark, root):
    return R.without_flag(_gappy_events(spark, root), "props").select("event_id", "event_type")


def exact_relation(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", S.mapped("o_orderstatus", {"F": "=", "O": ">"}).alias("relation"))
    return R.exact_values(o, "relation")


def value_and_id(spark, root):
    e = table(spark, root, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("value").cast("int").cast("string")).alias("val"),
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("mol"))
    return R.with_value_and_id(e, "val", "mol")


def keyword_predicate(spark, root):
    t = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", contains_all(t, ["the", "ing", "er"]).alias("has_all"), contains_any(t, ["qui", "der", "licen"]).alias("has_any"))


def unscaled_subset(spark, root):
    """The flag is text for some rows and missing for others."""
    e = table(spark, root, "events").select(
        "event_id", S.mapped("event_type", {"click": " False", "view": "TRUE", "error": "false"}).alias("scaling_was_applied"))
    return R.unscaled_rows(e)


def source_subset(spark, root):
    return table(spark, root, "documents").filter(F.col("source") == "src7").select("doc_id", "source")


def membership_split(spark, root):
    df = table(spark, root, "embeddings").select("vec_id", F.when(F.col("label") != 9, F.col("label")).alias("label"))
    return R.membership_split(df, "label", [0, 1, 2, 3, 4])


def drop_missing(spark, root):
    return R.drop_missing(_gappy_events(spark, root), keys=["props"], target="value").select("event_id", "props", "value")


def provenance(spark, root):
    df = R.with_provenance(table(spark, root, "supplier").select("s_suppkey"), dataset="source_a", data_year="2023")
    return R.renamed(df, {"s_suppkey": "mol_id"})


def align_columns(spark, root):
    return R.align_columns(table(spark, root, "orders"), ["o_totalprice", "f_missing"], keep=["o_orderkey"])


def lookup_join(spark, root):
    """Lookup tables hold several rows per key in write order; the last one counts."""
    part, sup = table(spark, root, "part"), table(spark, root, "supplier")
    old = part.select("p_partkey", F.lit("old").alias("p_name"), F.lit(0).alias("v"))
    names = L.last_written(old.unionByName(part.select("p_partkey", "p_name", F.lit(1).alias("v"))), "p_partkey", ["v"])
    li = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    out = L.lookup(li, names.filter("p_name <> 'small ring'"), "l_partkey", "p_partkey", {"p_name": "name"}, hit="found")
    out = L.lookup(out, sup, "l_suppkey", "s_suppkey", {"s_nationkey": "nation"})
    return out.groupBy("name", "nation", "found").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def last_written(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", "event_type", "value")
    return L.last_written(e, "user_id", ["event_id"])


def semi_join(spark, root):
    o = table(spark, root, "orders").filter(F.lower("o_orderpriority").contains("urgent"))
    li = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return L.having_match(li, o, "l_orderkey", "o_orderkey", F.col("l_returnflag") == "R")


def anti_join(spark, root):
    li = table(spark, root, "lineitem").filter("l_quantity >= 45")
    return L.without_match(table(spark, root, "orders"), li, "o_orderkey", "l_orderkey").select("o_orderkey", "o_orderstatus")


def union_schemas(spark, root):
    a = table(spark, root, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_name").alias("name"), F.lit("part").alias("dataset"))
    b = table(spark, root, "supplier").select(F.col("s_suppkey").alias("mol_id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("dataset"))
    return R.union_all([a, b])


def set_difference(spark, root):
    li = table(spark, root, "lineitem").filter("l_discount = 0.05").select(F.col("l_partkey").alias("id"))
    return R.ids_missing_from(table(spark, root, "part").select(F.col("p_partkey").alias("id")), li, "id")


def distinct_ids(spark, root):
    return sorted_distinct(table(spark, root, "lineitem"), "l_suppkey")


def numbered_ids(spark, root):
    return sequential_ids(table(spark, root, "part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], "part_")


def time_order(spark, root):
    return time_sorted(table(spark, root, "events").select("event_id", "ts"), "ts", "event_id", ascending=False)


def scalar_transforms(spark, root):
    v = F.col("value")
    return table(spark, root, "events").select(
        "event_id", r6(F.log1p(v), "log1p"), r6(S.from_log10(v / 100), "from_log10"), r6(F.expm1(v / 50), "expm1"),
        r6(S.clip_log10(v - 10), "clipped_log10"),
        r6(S.clip_log10(F.when(F.col("event_type") != "view", v)), "clipped_gappy"))


def unit_scaling(spark, root):
    unit = S.mapped("event_type", {"click": "mL.min-1.g-1", "view": "mL.min-1.kg-1"}, "other")
    e = table(spark, root, "events").select("event_id", "value", unit.alias("unit"))
    return e.select("event_id", "unit", r6(S.scale_where("value", "unit", "mL.min-1.g-1", 1.028), "scaled"),
                    S.mapped("unit", {"mL.min-1.kg-1": False, "mL.min-1.g-1": True}).alias("scaling_was_applied"))


def structure_status(spark, root):
    labels = table(spark, root, "labels")
    docs = table(spark, root, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("text")).otherwise(F.lit(" ")).alias("text"))
    out = L.lookup(docs, labels, "doc_id", "doc_id", {"quality": "quality"}, hit="returned")
    return out.groupBy(S.structure_status("returned", "text").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def numeric_coercion(spark, root):
    mixed = F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") == "view", F.lit("NaN")).otherwise(F.col("user_id").cast("string"))
    return table(spark, root, "events").select("event_id", S.to_number(mixed).alias("number"))


def loose_boolean(spark, root):
    word = S.mapped("event_type", {"click": "Yes", "view": " off", "error": "1", "signup": "FALSE"})
    return table(spark, root, "events").select(
        "event_id", S.to_bool(word, True).alias("strict"), S.to_bool_lenient(word).alias("lenient"), S.says_false(word).alias("is_false"))


def parse_time(spark, root):
    return table(spark, root, "orders").select("o_orderkey", S.to_time(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("at"))


QUERIES = {f.__name__: f for f in (
    scan_required_columns, sink_csv_roundtrip, sink_buckets, sink_split, lookup_export, complete_rows, present_renamed, exclude_values,
    allow_values, unflagged_rows, exact_relation, value_and_id, keyword_predicate, unscaled_subset, source_subset, membership_split,
    drop_missing, provenance, align_columns, lookup_join, last_written, semi_join, anti_join, union_schemas, set_difference,
    distinct_ids, numbered_ids, time_order, scalar_transforms, unit_scaling, structure_status, numeric_coercion, loose_boolean, parse_time,
)}

ORACLES = {
    "scan_required_columns": "select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1",
    "sink_csv_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "sink_buckets": "select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1",
    "sink_split": """select case when event_type = 'purchase' then 'yes' else 'no' end as side, event_type, count(*) as n
        from events group by 1, 2""",
    "lookup_export": "select distinct n_nationkey, case when n_regionkey <> 2 then n_name else '' end as n_name from nation",
    "complete_rows": f"select event_id, props, value from {GAPPY} where props is not null and value is not null",
    "present_renamed": f"select event_id, value as hlm_value_true from {GAPPY} where value is not null",
    "exclude_values": """select p_partkey, p_type from (select p_partkey, p_retailprice, case when p_size <> 7 then p_type end as p_type from part)
        where coalesce(p_type not in ('ECONOMY', 'PROMO'), true) and p_retailprice is not null""",
    "allow_values": "select event_id, event_type from events where event_type in ('click', 'signup')",
    "unflagged_rows": f"select event_id, event_type from {GAPPY} where props is null",
    "exact_relation": """select * from (select o_orderkey, case o_orderstatus when 'F' then '=' when 'O' then '>' end as relation from orders)
        where relation is null or relation = '='""",
    "value_and_id": """select * from (select event_id,
        case when event_type = 'view' then '  ' else cast(cast(trunc(value) as int) as varchar) end as val,
        case when event_type <> 'signup' then cast(user_id as varchar) end as mol from events)
        where nullif(trim(val), '') is not null and nullif(trim(mol), '') is not null""",
    "keyword_predicate": """select doc_id, contains(lower(text), 'the') and contains(lower(text), 'ing') and contains(lower(text), 'er') as has_all,
        contains(lower(text), 'qui') or contains(lower(text), 'der') or contains(lower(text), 'licen') as has_any from documents""",
    "unscaled_subset": """select * from (select event_id, case event_type when 'click' then ' False' when 'view' then 'TRUE' when 'error' then 'false' end
        as scaling_was_applied from events) where lower(trim(scaling_was_applied)) = 'false'""",
    "source_subset": "select doc_id, source from documents where source = 'src7'",
    "membership_split": """select vec_id, case when label <> 9 then label end as label,
        coalesce(case when label <> 9 then label end in (0, 1, 2, 3, 4), false) as is_finetune from embeddings""",
    "drop_missing": f"select event_id, props, value from {GAPPY} where props is not null and value is not null",
    "provenance": "select s_suppkey as mol_id, 'source_a' as dataset, '2023' as data_year from supplier",
    "align_columns": "select o_orderkey, o_totalprice, cast(null as double) as f_missing from orders",
    "lookup_join": """select p.p_name as name, s_nationkey as nation, p.p_partkey is not null as found, count(*) as n, sum(l_quantity) as quantity
        from lineitem left join (select * from part where p_name <> 'small ring') p on l_partkey = p_partkey
        left join supplier on l_suppkey = s_suppkey group by 1, 2, 3""",
    "last_written": """select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value
        from events group by 1""",
    "semi_join": """select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag from lineitem where l_returnflag = 'R'
        and l_orderkey in (select o_orderkey from orders where contains(lower(o_orderpriority), 'urgent'))""",
    "anti_join": """select o_orderkey, o_orderstatus from orders where not exists
        (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 45)""",
    "union_schemas": """select p_partkey as mol_id, p_name as name, 'part' as dataset, cast(null as double) as balance from part
        union all select s_suppkey, null, 'supplier', s_acctbal from supplier""",
    "set_difference": "select p_partkey as id from part except select l_partkey from lineitem where l_discount = 0.05",
    "distinct_ids": "select distinct l_suppkey from lineitem order by 1",
    "numbered_ids": "select p_partkey, p_size, 'part_' || row_number() over (order by p_size, p_partkey) as mol_id from part",
    "time_order": "select event_id, ts from events order by ts desc, event_id",
    "scalar_transforms": """select event_id, round(ln(1 + value), 6) as log1p, round(pow(10, value / 100), 6) as from_log10,
        round(exp(value / 50) - 1, 6) as expm1, round(log10(greatest(value - 10, 0) + 1), 6) as clipped_log10,
        case when event_type <> 'view' then round(log10(greatest(value, 0) + 1), 6) end as clipped_gappy from events""",
    "unit_scaling": """select event_id, unit, round(case when unit = 'mL.min-1.g-1' then value * 1.028::double else value end, 6) as scaled,
        case unit when 'mL.min-1.kg-1' then false when 'mL.min-1.g-1' then true end as scaling_was_applied from
        (select event_id, value, case event_type when 'click' then 'mL.min-1.g-1' when 'view' then 'mL.min-1.kg-1' else 'other' end as unit from events)""",
    "structure_status": """select case when l.doc_id is null then 'molecule_not_returned' when lang = 'de' or trim(text) = '' then 'blank_smiles'
        else 'smiles_found' end as status, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1""",
    "numeric_coercion": """select event_id, case when event_type in ('error', 'view') then null else cast(user_id as double) end as number from events""",
    "loose_boolean": """select event_id, case event_type when 'view' then false when 'signup' then false else true end as strict,
        coalesce(event_type in ('click', 'error'), false) as lenient, event_type = 'signup' as is_false from events""",
    "parse_time": "select o_orderkey, date_trunc('second', o_orderdate) as at from orders",
}
