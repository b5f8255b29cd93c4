"""Assay harvest, per-source preparation and combination into training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from propspark.catalog.base import r6, table
from propspark.operators.lookups import last_written
from propspark.operators.ordered import sequential_ids
from propspark.plans import curate as C


def _assays(spark, root):
    """Orders as assays: the priority and status make the description; two writes per id."""
    o = table(spark, root, "orders")
    word = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("Human LIVER microsomes")).when(
        F.col("o_orderpriority") == "3-MEDIUM", F.lit("hlm of human livers")).otherwise(F.lit("rat liver microsomes"))
    new = o.select(F.col("o_orderkey").alias("assay_id"), F.concat_ws(" ", word, "o_orderstatus").alias("description"), F.lit(1).alias("v"))
    old = new.withColumn("description", F.concat(F.lit("human liver microsomal draft "), "description")).withColumn("v", F.lit(0))
    return old.unionByName(new)


def _activities(spark, root):
    li = table(spark, root, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("assay_id"), F.col("l_partkey").alias("molecule_id"), F.col("l_suppkey").alias("target_id"),
        F.when(F.col("l_returnflag") != "A", F.lit("CL")).otherwise(F.lit("T1/2")).alias("standard_type"),
        F.when(F.col("l_linestatus") == "O", F.lit("=")).when(F.col("l_linenumber") > 5, F.lit(">")).alias("standard_relation"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.lit("")).alias("standard_value"))


def _molecules(spark, root):
    p = table(spark, root, "part").filter("p_type <> 'PROMO'")
    return p.select(F.col("p_partkey").alias("molecule_id"), F.when(F.col("p_brand") != "Brand#2", F.col("p_name")).alias("smiles"))


def candidate_assays(spark, root):
    return C.candidate_assays(_assays(spark, root), order_cols=["v"]).select("assay_id", "description")


def harvested(spark, root):
    assays = C.candidate_assays(_assays(spark, root), order_cols=["v"])
    targets = table(spark, root, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("target_name"))
    out = C.harvest(_activities(spark, root), assays, _molecules(spark, root), targets, kind="CL", assay_cols={"description": "assay_description"})
    return out.groupBy("assay_description", "smiles", "target_name", "structure_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("standard_value").cast("bigint")).alias("value"))


SOURCES = {
    "a": C.SourceConfig("source_a", ("p_name", "log_value"), "log_value", is_log10=True, year="2023", renames={"p_name": "SMILES"}),
    "b": C.SourceConfig("source_b", ("CXSMILES", "HLM", "mol"), "HLM", excluded=("CXSMILES", ("Supplier#000000003", "Supplier#000000008")), factor=1.028,
                        renames={"CXSMILES": "SMILES", "mol": "mol_id"}),
    "c": C.SourceConfig("source_c", ("smiles", "standard_value", "mol"), "standard_value", flag_col="remark", unit_col="unit",
                        units=("mL.min-1.kg-1", "mL.min-1.g-1"), scaled_unit="mL.min-1.g-1", factor=1.028, renames={"smiles": "SMILES", "mol": "mol_id"}),
}


def _raw(spark, root, which):
    if which == "a":
        return table(spark, root, "part").select(
            "p_partkey", "p_name", F.when(F.col("p_size") > 3, F.col("p_size") / 20.0).alias("log_value"))
    if which == "b":
        return table(spark, root, "supplier").select(
            F.col("s_name").alias("CXSMILES"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("HLM"), F.concat(F.lit("b_"), F.col("s_suppkey").cast("string")).alias("mol"))
    return table(spark, root, "events").select(
        F.col("event_type").alias("smiles"), F.col("value").alias("standard_value"), F.concat(F.lit("c_"), F.col("event_id").cast("string")).alias("mol"),
        F.when(F.col("user_id") < 20, F.lit("outside range")).alias("remark"),
        F.when(F.col("event_type") == "click", F.lit("mL.min-1.g-1")).when(F.col("event_type") != "error", F.lit("mL.min-1.kg-1")).otherwise(F.lit("ml/min.mg")).alias("unit"))


def _prepared(spark, root):
    a = C.prepare_source(_raw(spark, root, "a").select("p_partkey", "p_name", "log_value"), C.SourceConfig(
        "source_a", ("p_partkey", "p_name", "log_value"), "log_value", is_log10=True, renames={"p_name": "SMILES"}))
    a = sequential_ids(a, ["p_partkey"], "a_").withColumn("scaling_was_applied", F.lit("False"))
    b = C.prepare_source(_raw(spark, root, "b"), SOURCES["b"]).withColumn("scaling_was_applied", F.lit("True"))
    c = C.prepare_source(_raw(spark, root, "c"), SOURCES["c"])
    c = c.withColumn("scaling_was_applied", F.when(F.col("unit") == "mL.min-1.g-1", True).when(F.col("unit") == "mL.min-1.kg-1", False))
    return {"a": a, "b": b, "c": c}


VALUES = ("hlm_value_unscaled", "hlm_value_unscaled_log1p", "hlm_value_scaled", "hlm_value_scaled_log1p")


def prepared_log_source(spark, root):
    out = C.prepare_source(_raw(spark, root, "a"), SOURCES["a"])
    return out.groupBy("SMILES", "dataset", "data_year").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(v), v) for v in VALUES])


def prepared_unit_source(spark, root):
    out = C.prepare_source(_raw(spark, root, "c"), SOURCES["c"])
    return out.select("mol_id", "SMILES", "unit", *[r6(v) for v in VALUES], "dataset")


def combined_table(spark, root):
    out = C.combine(_prepared(spark, root).values())
    return out.select("mol_id", "SMILES", *[r6(v) for v in VALUES], "dataset", "scaling_was_applied")


def training_sets(spark, root):
    src = _prepared(spark, root)
    predicted = src["a"].withColumn("dataset", F.lit("predicted"))
    sets = C.training_sets(src, single="source_b", predicted=predicted)
    parts = [df.select(F.lit(n).alias("training_set"), "dataset", "hlm_value_scaled") for n, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("training_set", "dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hlm_value_scaled"), "mean_scaled"))


QUERIES = {f.__name__: f for f in (candidate_assays, harvested, prepared_log_source, prepared_unit_source, combined_table, training_sets)}

_ASSAYS = """(select o_orderkey as assay_id, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Human LIVER microsomes'
 when o_orderpriority = '3-MEDIUM' then 'hlm of human livers' else 'rat liver microsomes' end || ' ' || o_orderstatus as description from orders)"""
_CANDIDATES = f"""(select assay_id, case when contains(lower(description), 'human') and contains(lower(description), 'microsom') then description
 else 'human liver microsomal draft ' || description end as description from {_ASSAYS})"""


def _source(key, smiles, raw, scaled, name, flag, src, where):
    return f"""select {key} as mol_id, {smiles} as SMILES, {raw} as u, {scaled} as s, '{name}' as dataset, {flag} as scaling_was_applied from {src} where {where}"""


_A = _source("'a_' || row_number() over (order by p_partkey)", "p_name", "pow(10, p_size / 20)", "pow(10, p_size / 20)", "source_a", "false", "part", "p_size > 3")
_B = _source("'b_' || s_suppkey", "s_name", "s_acctbal", "s_acctbal * 1.028::double", "source_b", "true", "supplier",
             "s_acctbal > 0 and s_name not in ('Supplier#000000003', 'Supplier#000000008')")
_C = _source("'c_' || event_id", "event_type", "value", "case when event_type = 'click' then value * 1.028::double else value end", "source_c",
             "event_type = 'click'", "events", "user_id >= 20 and event_type <> 'error'")
_OUT = """round(u, 6) as hlm_value_unscaled, round(ln(1 + u), 6) as hlm_value_unscaled_log1p, round(s, 6) as hlm_value_scaled, round(ln(1 + s), 6) as hlm_value_scaled_log1p"""
_ALL = f"({_A} union all {_B} union all {_C})"

ORACLES = {
    "candidate_assays": f"select assay_id, description from {_CANDIDATES}",
    "harvested": f"""with h as (select a.description as assay_description, m.p_name, m.p_brand, m.p_partkey, s_name as target_name, l_quantity
        from lineitem join {_CANDIDATES} a on a.assay_id = l_orderkey
        left join (select * from part where p_type <> 'PROMO') m on m.p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey
        where l_returnflag <> 'A' and l_tax > 0 and (l_linestatus = 'O' or l_linenumber <= 5))
        select assay_description, case when p_brand <> 'Brand#2' then p_name end as smiles, target_name,
        case when p_partkey is null then 'molecule_not_returned' when p_brand = 'Brand#2' then 'blank_smiles' else 'smiles_found' end as structure_status,
        count(*) as n, sum(l_quantity)::bigint as value from h group by all""",
    "prepared_log_source": """select p_name as "SMILES", 'source_a' as dataset, '2023' as data_year, count(*) as n, round(avg(v), 6) as hlm_value_unscaled,
        round(avg(ln(1 + v)), 6) as hlm_value_unscaled_log1p, round(avg(v), 6) as hlm_value_scaled, round(avg(ln(1 + v)), 6) as hlm_value_scaled_log1p
        from (select p_name, pow(10, p_size / 20) as v from part where p_size > 3) group by 1""",
    "prepared_unit_source": f"""select mol_id, SMILES as "SMILES", case when scaling_was_applied then 'mL.min-1.g-1' else 'mL.min-1.kg-1' end as unit, {_OUT}, dataset from ({_C})""",
    "combined_table": f"""select mol_id, SMILES as "SMILES", {_OUT}, dataset, scaling_was_applied from {_ALL}""",
    "training_sets": f"""with t as (select 'all' as training_set, * from {_ALL} union all select 'no_scaling', * from {_ALL} where not scaling_was_applied
        union all select 'single', * from ({_B}) union all select 'all_predicted', * from {_ALL}
        union all select 'all_predicted', * replace ('predicted' as dataset) from ({_A}))
        select training_set, dataset, count(*) as n, round(avg(s), 6) as mean_scaled from t group by 1, 2""",
}
