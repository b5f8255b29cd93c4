"""Tool-call linking: calls and results are joined by identifier, ordered by what they need, checked and written as canonical JSON.

All of it is joins, groupings and column functions; no conversation is gathered in one row or task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key

KINDS = {"string": "STRING", "call": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``key`` and ``level`` of every node: 0 if it needs none, else one more than the highest that it needs.

    ``nodes`` holds distinct ``key``; ``edges`` distinct pairs of ``key`` and ``needs``, both nodes. Nodes on a cycle, or
    that need one, get null. Chains are halved in each round; after that only nodes with several needs are
    settled step by step, so a long chain costs the logarithm of its length.
    """
    keep = Stored(nodes.sparkSession)
    need = keep(edges.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("first")))
    many = F.coalesce(F.col("n"), F.lit(0)) > 1
    start = nodes.join(need, "key", "left").select(
        "key", F.when(F.col("n") == 1, F.col("first")).otherwise(F.col("key")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("d"),
        F.coalesce(F.col("n") != 1, F.lit(True)).alias("settled"), many.alias("joint"))
    state, path = keep.put(start)
    total = state.count()
    for _ in range(math.ceil(math.log2(max(total, 2))) + 2):
        if state.filter("not settled").isEmpty():
            break
        seen = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("settled").alias("s2"))
        moved = state.filter("not settled").join(seen, "up").select(
            "key", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("s2").alias("settled"), "joint")
        after, after_path = keep.put(state.filter("settled").unionByName(moved))
        keep.drop(path)
        state, path = after, after_path
    known = state.filter("settled and not joint and up = key").select(F.col("key").alias("up"), F.lit(0).cast("long").alias("base"))
    joints = state.filter("joint").select("key")
    if not joints.isEmpty():
        known, path = keep.put(known)
        at = state.select(F.col("key").alias("needs"), "up", "d", "settled")
        open_, open_path = keep.put(edges.join(joints, "key", "left_semi").join(at, "needs").select("key", F.when(F.col("settled"), F.col("up")).alias("up"), "d"))
        while True:
            # A node is settled once every end it needs is.
            found, found_path = keep.put(open_.join(known, "up", "left").groupBy("key").agg(
                F.max(F.col("base") + F.col("d") + 1).alias("base"), F.bool_and(F.col("base").isNotNull()).alias("all")).filter("all").select(F.col("key").alias("up"), "base"))
            if found.isEmpty():
                break
            known, path_now = keep.put(known.union(found))
            rest, rest_path = keep.put(open_.join(found.select(F.col("up").alias("key")), "key", "left_anti"))
            for old in (path, open_path, found_path):
                keep.drop(old)
            path, open_, open_path = path_now, rest, rest_path
    return state.join(known, "up", "left").select("key", F.when(F.col("settled"), F.col("base") + F.col("d")).alias("level"))


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Messages, in the order of fields, of what breaks the schema of the tool; empty if nothing does.

    A schema lists each field's ``type`` and, optionally, ``required``, ``enum``, ``min`` and ``max`` (of a
    number, or of a string's length). Fields that the schema does not list are errors.
    """
    value = F.try_parse_json(arguments)
    ok = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, rule in fields.items():
            got = F.try_variant_get(value, f"$.{field}", "variant")
            kind = F.schema_of_variant(got)
            missing = got.isNull() | F.coalesce(kind == "VOID", F.lit(False))
            tests = [(~kind.rlike(f"^({KINDS[rule['type']]})$"), f"{field}: not of type {rule['type']}")]
            text = rule["type"] in ("string", "call")
            plain = F.try_variant_get(got, "$", "string" if text else "double")
            measure = F.char_length(plain) if text else plain
            if "min" in rule:
                tests.append((measure < rule["min"], f"{field}: below {rule['min']}"))
            if "max" in rule:
                tests.append((measure > rule["max"], f"{field}: above {rule['max']}"))
            if "enum" in rule:
                tests.append((~plain.isin(list(rule["enum"])), f"{field}: not among the values"))
            test = F.when(missing, F.lit(f"{field}: missing") if rule.get("required") else F.lit(None))
            for broken, message in tests:
                test = test.when(broken, F.lit(message))
            checks.append(test)
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields])))
        found = F.concat(F.array_compact(F.array(*checks)), F.transform(extra, lambda k: F.concat(k, F.lit(": not in the schema"))))
        out = F.when(name == tool, F.when(ok, found).otherwise(F.array(F.lit("arguments: not an object")))).otherwise(out)
    return F.coalesce(out, F.array(F.lit("unknown tool")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per call and per result that no call asked for.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text); ``results``: conv_id, call_id, turn, content.
    Columns: conv_id, call_id, turn, name, ``status`` (linked, unanswered, orphan, cycle), ``level``,
    ``n_results``, ``valid``, ``errors`` and ``json``. Ordered by level, turn and id, a conversation's calls come after
    all that they need. A field of type ``call`` holds the id of a call in the same conversation that has to
    come first; ids of no call are an error. ``json`` has sorted keys, no white space and no missing fields.

    Of several results of one call the earliest (then the smallest) counts; rows that share an id are
    linked alike. A null id links to nothing and has level 0. Arguments that are no JSON are kept as text.
    Other columns are not read; empty tables give an empty result.
    """
    keep = Stored(calls.sparkSession)
    key = F.concat(group_key(F.col("conv_id")), F.lit("\u0001"), F.col("call_id"))
    errors = schema_errors(F.col("name"), F.col("arguments"), schemas)
    refs = sorted({f for fields in schemas.values() for f, rule in fields.items() if rule["type"] == "call"})
    value = F.try_parse_json(F.col("arguments"))
    needs = F.array_distinct(F.array_compact(F.array(*[F.try_variant_get(value, f"$.{f}", "string") for f in refs]))) if refs else F.array().cast("array<string>")
    asked = calls.select("conv_id", "call_id", "turn", "name", "arguments", key.alias("key"), errors.alias("found"), needs.alias("needs"))
    nodes = keep(asked.filter("key is not null").select("key").distinct())
    wanted = asked.filter("key is not null").select("key", F.explode("needs").alias("id"), F.concat(group_key(F.col("conv_id")), F.lit("\u0001"), F.col("id")).alias("needs")).distinct()
    wanted = keep(wanted.join(nodes.select(F.col("key").alias("needs"), F.lit(True).alias("there")), "needs", "left"))
    order = levels(nodes, wanted.filter("there").select("key", "needs"))
    lost = wanted.filter("there is null").groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
    first = results.select(key.alias("key"), "turn", "content").filter("key is not null").groupBy("key").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    facts = keep(order.join(lost, "key", "left"))
    rows = asked.join(facts, "key", "left").join(first, "key", "left")
    rows = rows.withColumn("errors", F.when(F.col("lost") > 0, F.array_append("found", F.lit("needs a call that is not there"))).otherwise(F.col("found")))
    cycle = F.col("key").isNotNull() & F.col("level").isNull()
    own = F.struct(value.alias("arguments"), F.col("call_id").alias("call_id"), F.col("r.content").alias("content"), F.col("name").alias("name"),
                   F.when(value.isNull(), F.col("arguments")).alias("text"))
    out = rows.select(
        "conv_id", "call_id", "turn", "name",
        F.when(cycle, "cycle").when(F.col("n_results") > 0, "linked").otherwise("unanswered").alias("status"),
        F.when(F.col("key").isNull(), 0).otherwise(F.col("level")).cast("int").alias("level"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), F.to_json(own).alias("json"))
    orphan = results.select("conv_id", "call_id", "turn", "content", key.alias("key")).join(nodes, "key", "left_anti").select(
        "conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"), F.lit(None).cast("int").alias("level"),
        F.lit(1).cast("long").alias("n_results"), F.lit(False).alias("valid"), F.lit("").alias("errors"),
        F.to_json(F.struct("call_id", "content")).alias("json"))
    return out.unionByName(orphan)
