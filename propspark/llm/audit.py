"""Interaction of filters: what each removes in every order, counted on the lattice of filter subsets.

A state is the set of filters applied so far, an edge adds one filter and removes the documents that fail
it and nothing before it. Forward counts say how many orders reach a state, backward counts how many
leave it; their product weighs an edge in the sum over all orders. Documents enter as counts by failure mask.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored, text_of, words_of

#: More filters would make the lattice (2^n states, n! orders) larger than what it sums up.
MAX_FILTERS = 8


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Per state of the lattice over n filters: orders that reach it from none, and orders that lead from it to all."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for bit in (1 << i for i in range(n)):
            if not state & bit:
                reach[state | bit] += reach[state]
    for state in range(full, -1, -1):
        for bit in (1 << i for i in range(n)):
            if not state & bit:
                leave[state] += leave[state | bit]
    return reach, leave


def failures(docs: DataFrame, filters: Mapping[str, Column], same: str | None = None, *, labels: DataFrame | None = None,
             part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by ``part`` and ``mask``: ``n``, ``good``, ``toxic`` documents.

    ``filters`` names conditions under which a document fails, ``same`` one more filter: the text is
    identical to that of a smaller id. Bit i of the mask is the i-th filter, ``same`` the last. Texts are
    told apart by SHA-256. A null text is empty; a null id is compared with none, so it
    neither fails ``same`` nor makes others fail it; a null part is the empty string, a condition that is null does not fail. ``labels``
    (``doc_id``, ``quality``, ``toxic``) may repeat an id: one row that says 1 is enough.
    """
    failing = F.lit(0)
    for i, condition in enumerate(filters.values()):
        failing = failing + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce((F.lit("") if part is None else part).cast("string"), F.lit("")).alias("part"),
        failing.alias("mask"), F.unhex(F.sha2(text_of(text_col), 256)).alias("same"))
    if same is not None:
        rows = Stored(docs.sparkSession)(rows)
        # Joined by text and id together, so rows of one text do not meet in one task.
        first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("_first", F.lit(True))
        later = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
        rows = rows.join(first, ["same", "doc_id"], "left").withColumn("mask", F.col("mask") + later)
    good = toxic = F.lit(0)
    if labels is not None:
        says = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
        rows = rows.join(says, "doc_id", "left")
        good, toxic = (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("_good", "_toxic"))
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(good).cast("long").alias("good"), F.sum(toxic).cast("long").alias("toxic"))


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """Per ``part``, ``filter_order`` (all permutations of the letters ``names``) and ``step`` (from 1), in documents of the part:

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier),
    ``unique_fails`` (fail its filter only), ``good_lost``, ``toxic_lost`` and ``shapley``, the filter's
    removals summed over all orders. ``counts`` come from ``failures``. A part is one row of 2^n sums while
    it is worked on; nothing depends on the number of documents. No counts give no rows.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS or len(set(names)) < n:
        raise ValueError(f"1 to {MAX_FILTERS} filters with different letters are needed")
    reach, leave = path_counts(n)
    states = range(1 << n)
    # Documents that pass all filters of a state, for every state: the nodes of the lattice.
    alive = counts.groupBy("part").agg(*(
        F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in states)).alias(c) for c in ("n", "good", "toxic")))

    def lost(c: str, state: Column, bit: Column) -> Column:
        return F.col(c)[state] - F.col(c)[state.bitwiseOR(bit)]

    weighted = (sum(F.lit(reach[s] * leave[s | 1 << i]) * lost("n", F.lit(s), F.lit(1 << i)) for s in states if not s >> i & 1) for i in range(n))
    # The edges that each order walks, the same for every part.
    steps = [{"filter_order": "".join(names[i] for i in p), "step": k + 1, "_state": sum(1 << i for i in p[:k]), "_filter": p[k]}
             for p in permutations(range(n)) for k in range(n)]
    walked = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, _state: int, _filter: int>>")
    rows = alive.select("*", F.array(*weighted).alias("_shapley"), F.explode(walked).alias("_at"))
    rows = rows.select("part", "n", "good", "toxic", "_shapley", "_at.*").withColumn("_bit", F.expr("shiftleft(1, _filter)"))
    state, bit = F.col("_state"), F.col("_bit")
    others = F.lit((1 << n) - 1).bitwiseXOR(bit)
    removed = lost("n", state, bit)
    return rows.select(
        "part", "filter_order", "step", F.col("n")[state.bitwiseOR(bit)].alias("kept"), removed.alias("removed"),
        (lost("n", F.lit(0), bit) - removed).alias("redundant"), lost("n", others, bit).alias("unique_fails"),
        lost("good", state, bit).alias("good_lost"), lost("toxic", state, bit).alias("toxic_lost"),
        F.col("_shapley")[F.col("_filter")].alias("shapley"))


def text_filters(text_col: str = "text") -> dict[str, Column]:
    """Few words, repeated words, many capitals, special characters; each true where a text fails."""
    text = text_of(text_col)
    words = words_of(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def audited(docs: DataFrame, labels: DataFrame | None = None, *, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``interactions`` of the ``text_filters`` and, as E, of texts that a smaller id has. An empty table gives an empty result."""
    counts = failures(docs, text_filters(text_col), "E", labels=labels, part=F.col(part_col), id_col=id_col, text_col=text_col)
    return interactions(Stored(docs.sparkSession)(counts), "ABCDE")


def sql() -> str:
    """DuckDB SQL of the same counts, from every document and order, without the lattice."""
    return r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(words) < 100 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
    || case when 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where length(a.x || b.x || c.x || d.x || e.x) = len(list_distinct([a.x, b.x, c.x, d.x, e.x]))),
s as (select filter_order, step, left(filter_order, step - 1) as earlier, filter_order[step] as letter from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, step::int as step, letter,
    coalesce(sum(n) filter (len(list_intersect(split(fails, ''), split(left(filter_order, step), ''))) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (contains(fails, letter) and (earlier = '' or len(list_intersect(split(fails, ''), split(earlier, ''))) = 0)), 0)::bigint as removed,
    coalesce(sum(n) filter (contains(fails, letter) and earlier <> '' and len(list_intersect(split(fails, ''), split(earlier, ''))) > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = letter), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (contains(fails, letter) and (earlier = '' or len(list_intersect(split(fails, ''), split(earlier, ''))) = 0)), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (contains(fails, letter) and (earlier = '' or len(list_intersect(split(fails, ''), split(earlier, ''))) = 0)), 0)::bigint as toxic_lost
  from c, s group by all)
select * exclude (letter, shapley), (sum(removed) over (partition by part, letter))::bigint as shapley
from (select *, 0 as shapley from r)"""
