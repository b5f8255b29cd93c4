"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that list them. A flow routes each pattern's words to the quotas
of its sources; another repetition of a pattern costs more than the one before, so repeats go where they are
needed only. A pattern that is the only one of its only source is a component of its own, whose flow can be
read off its quota; only patterns that share sources go through the network on the driver. Inside a pattern
whole documents are chosen in a seeded order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key, ranked, seeded
from propspark.operators.ordered import global_index
from propspark.session import broadcast_if_small
from propspark.sources.tables import is_empty

#: Weights dealt in turn to the sources by code point, a missing source last.
CYCLE = (1, 2, 3)


def weighed(sources: DataFrame, weights: Callable[[list], dict] | None, max_sources: int) -> DataFrame:
    """Add ``weight`` (a whole number of at least 0): dealt from ``CYCLE``, or by a function from the sources to their weights."""
    if weights is None:
        at = global_index(sources, [F.col("source").isNull(), "source"], "_nth")
        return at.withColumn("weight", F.get(F.array(*map(F.lit, CYCLE)), F.pmod("_nth", F.lit(len(CYCLE))).cast("int")).cast("long")).drop("_nth")
    names = [r["source"] for r in sources.select("source").limit(max_sources + 1).collect()]
    if len(names) > max_sources:
        raise ValueError(f"more than {max_sources} sources for a weight function")
    table = sources.sparkSession.createDataFrame([(n, w) for n, w in weights(names).items()], f"_of {sources.schema['source'].dataType.simpleString()}, weight long")
    return sources.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def quotas(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Add ``target`` and its whole number ``quota``: all words shared by ``weight``, no source above ``max_repeats`` times its ``own``.

    What a stopped source cannot give is shared among the others by weight until none is above. A round finds
    the sources above the present level, a fraction of whole numbers; the level only rises, so the rounds end.
    A source of weight 0 gets nothing.
    """
    whole = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(38,0)")
    most = whole("own") * F.lit(max_repeats).cast("decimal(10,0)")
    total, share = (int(v or 0) for v in sources.agg(F.sum(whole("own")), F.sum(whole("weight"))).first())
    words = total
    while True:
        # The level is words / share for a unit of weight.
        above = F.expr(f"cast(own as decimal(30,0)) * {max_repeats} * {max(share, 1)}BD < cast(weight as decimal(30,0)) * {words}BD")
        held, open_ = (int(v or 0) for v in sources.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, whole("weight")))).first())
        if (total - held, open_) == (words, share) or not open_:
            break
        words, share = total - held, open_
    level = F.expr(f"cast(weight as decimal(30,0)) * {words}BD")
    share = max(share, 1)
    return sources.withColumn("target", F.when(above, most.cast("double")).otherwise(level.cast("double") / F.lit(float(share)))).withColumn(
        "quota", F.when(above, most).otherwise(F.floor((level * 2 + share) / F.lit(2 * share).cast("decimal(30,0)"))).cast("long"))


def route(patterns: dict[tuple, int], targets: dict, max_repeats: int = 3) -> dict[tuple, int]:
    """Words that each pattern gives in all, at most ``max_repeats`` times its own, for quotas in whole words.

    Costs lie on the repetitions of the patterns alone, so a shortest path costs what the next repetition of its
    first pattern costs: a largest flow with every pattern once, then with twice its room, and so on, is
    cheapest. Each largest flow goes by layers of the network of sources and patterns.
    """
    names, shapes = list(targets), list(patterns)
    at = {s: 1 + len(shapes) + i for i, s in enumerate(names)}
    sink = 1 + len(shapes) + len(names)
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room = [], []

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, r in ((a, b, capacity), (b, a, 0)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    entry = [arc(0, 1 + i, 0) for i in range(len(shapes))]
    for i, p in enumerate(shapes):
        for s in p:
            arc(1 + i, at[s], max_repeats * patterns[p])
    for s in names:
        arc(at[s], sink, round(targets[s]))

    def layers() -> list[int]:
        level, now = [-1] * (sink + 1), [0]
        level[0] = 0
        while now and level[sink] < 0:
            after = []
            for x in now:
                for e in head[x]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        after.append(to[e])
            now = after
        return level

    for _ in range(max_repeats):
        for i, p in enumerate(shapes):
            room[entry[i]] += patterns[p]
        while (level := layers())[sink] >= 0:
            tried = [0] * (sink + 1)
            path: list[int] = []
            x = 0
            while True:
                if x == sink:
                    pushed = min(room[e] for e in path)
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    # Back to where the path is full now.
                    full = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[full] ^ 1]
                    del path[full:]
                elif tried[x] < len(head[x]):
                    e = head[x][tried[x]]
                    if room[e] and level[to[e]] == level[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        tried[x] += 1
                elif path:
                    x = to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break
    return {p: room[entry[i] + 1] for i, p in enumerate(shapes)}


def _given(patterns: DataFrame, sources: DataFrame, max_repeats: int, max_patterns: int) -> DataFrame:
    """Per pattern ``_p`` the words that it gives: ``_give`` (patterns of no source are left out)."""
    single = patterns.filter(F.size("pattern") == 1).withColumn("_s", group_key(F.get("pattern", F.lit(0))))
    shared = patterns.filter(F.size("pattern") > 1)
    keyed = sources.withColumn("_s", group_key(F.col("source"))).select("_s", "quota")
    closed = lambda part: part.join(broadcast_if_small(keyed), "_s").select("_p", F.col("quota").alias("_give"))
    if is_empty(shared):
        return closed(single)
    tangled = shared.select(F.explode("pattern").alias("source")).select(group_key(F.col("source")).alias("_s")).distinct()
    tangled = broadcast_if_small(tangled)
    met = shared.select("_p", "words").unionByName(single.join(tangled, "_s", "left_semi").select("_p", "words"))
    found = {tuple(json.loads(r["_p"])): r for r in met.limit(max_patterns + 1).collect()}
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns that share sources")
    names = {s for p in found for s in p}
    target = {r["source"]: r["quota"] for r in sources.withColumn("_s", group_key(F.col("source"))).join(tangled, "_s", "left_semi").collect()}
    give = route({p: r["words"] for p, r in found.items()}, {s: target[s] for s in names}, max_repeats)
    routed = patterns.sparkSession.createDataFrame([(r["_p"], give[p]) for p, r in found.items()], "_p string, _give long")
    return closed(single.join(tangled, "_s", "left_anti")).unionByName(routed)


def taken(docs: DataFrame, size: Column, member_of: Column, *, weights: Callable[[list], dict] | None = None, max_repeats: int = 3, seed: int = 11,
          max_patterns: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id``, ``pattern`` (its sources), ``text_hash``, ``size`` and ``taken``; and per ``source`` its ``own``, ``weight``, ``target``, ``quota``.

    ``member_of`` is the array of sources that list a document (elements may be null), ``weights`` a
    function from the sources to their weights, by default ``CYCLE``. A document is taken whole, ``max_repeats`` times at most:
    every document of a pattern as often as the pattern's words fit as a whole, and of the rest a
    seeded run of documents; where it stops, runs in the same order of documents of at most half the gap, until
    none of that size are left; then the one document that comes nearest to what is missing, if it comes nearer.

    Sources and patterns are tables of any size. Only patterns whose sources overlap reach the driver; more than
    ``max_patterns`` of these raise an error, as overlaps are stated for a catalogue of sources. Null texts, ids
    and sources are kept; documents without words are taken 0 times; an empty table gives an empty result.
    Reruns agree; rows that repeat are interchangeable.
    """
    keep = Stored(docs.sparkSession)
    rows, rows_path = keep.put(docs.select(
        F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(member_of)).alias("pattern"), F.xxhash64(text_col).alias("text_hash"),
        size.cast("long").alias("size")).withColumn("_p", F.coalesce(F.to_json("pattern"), F.lit(""))))
    patterns = keep(rows.groupBy("_p").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("pattern").alias("pattern")))
    n_rows = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sources = keep(patterns.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("own")))
    sources = keep(quotas(keep(weighed(sources, weights, max_patterns)), max_repeats))
    words = F.greatest("words", F.lit(1))
    plan = patterns.join(_given(patterns, sources, max_repeats, max_patterns), "_p", "left").withColumn("_give", F.coalesce("_give", F.lit(0).cast("long")))
    plan = keep(plan.select("_p", F.expr("_give div greatest(words, 1)").alias("_whole"), (F.col("_give") % words).alias("_rest")))
    keyed = rows.withColumn("_id", group_key(F.col("doc_id")))
    order = ranked(keyed, "_p", seeded(seed, "_p", "_id", "text_hash", "size"), ["_id", "text_hash", "size"], n_rows, F.col("size"))
    order, order_path = keep.put(order.join(broadcast_if_small(plan), "_p").withColumn("_more", F.col("_before") + F.col("size") <= F.col("_rest")))
    keep.drop(rows_path)
    got = F.sum(F.when(F.col("_more"), F.col("size")).otherwise(0))
    gap = keep(order.groupBy("_p", "_rest").agg(got.alias("_got")).select("_p", (F.col("_rest") - F.col("_got")).alias("_gap")))
    # A pass takes the next documents of at most half of what is missing: it halves the gap, or none of that size are left.
    open_ = order.filter(~F.col("_more")).select("_p", "_id", "text_hash", "size", F.col("_rank").alias("_at"))
    filled, paths = open_.select("_p", "_at").limit(0), []
    while True:
        open_ = open_.join(broadcast_if_small(gap), "_p").filter((F.col("size") > 0) & (2 * F.col("size") <= F.col("_gap")))
        tried = ranked(open_, "_p", seeded(seed, "_p", "_id", "text_hash", "size"), ["_id", "text_hash", "size", "_at"], n_rows, F.col("size"))
        tried, path = keep.put(tried.select(*open_.columns, (F.col("_before") + F.col("size") <= F.col("_gap")).alias("_fits")))
        paths.append(path)
        if is_empty(tried):
            break
        filled = filled.unionByName(tried.filter("_fits").select("_p", "_at"))
        more = tried.filter("_fits").groupBy("_p").agg(F.sum("size").alias("_got"))
        gap = keep(gap.join(more, "_p", "left").select("_p", (F.col("_gap") - F.coalesce("_got", F.lit(0))).alias("_gap")))
        open_ = tried.filter(~F.col("_fits")).drop("_gap", "_fits")
    filled = filled.select("_p", F.col("_at").alias("_rank"), F.lit(True).alias("_filled"))
    order = keep(order.join(filled, ["_p", "_rank"], "left").withColumn("_more", F.col("_more") | F.coalesce("_filled", F.lit(False))).drop("_filled"))
    for path in (order_path, *paths):
        keep.drop(path)
    miss = F.abs(F.col("_gap") - F.col("size"))
    last = order.join(broadcast_if_small(gap), "_p").filter(~F.col("_more") & (miss < F.col("_gap"))).groupBy("_p").agg(F.min(F.struct(miss, "_rank")).alias("_last"))
    last = keep(last.select("_p", F.col("_last._rank").alias("_closing")))
    chosen = F.col("_more") | F.coalesce(F.col("_rank") == F.col("_closing"), F.lit(False))
    times = F.col("_whole") + F.when(chosen & (F.col("_whole") < max_repeats), 1).otherwise(0)
    out = order.join(broadcast_if_small(last), "_p", "left").select("doc_id", "pattern", "text_hash", "size", (F.col("size") * times).alias("taken"))
    return out, sources


def mixed(docs: DataFrame, size: Column, *, source_col: str = "source", **options) -> DataFrame:
    """``taken`` for documents of one source each, with ``source_size`` and ``target`` of that source."""
    out, sources = taken(docs, size, F.array(F.col(source_col).cast("string")), **options)
    facts = sources.select(group_key(F.col("source")).alias("_s"), F.col("own").alias("source_size"), "target")
    rows = out.withColumn("_s", group_key(F.get("pattern", F.lit(0))))
    return rows.join(broadcast_if_small(facts), "_s").select("doc_id", "text_hash", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, size: Column, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: all columns of the documents, each row as often as it is taken.

    Rows that share id and text divide their common number of copies as evenly as it goes.
    """
    given = mixed(docs, size, id_col=id_col, text_col=text_col, **options)
    count = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    plan = given.select(group_key(F.col("doc_id")).alias("_id"), F.col("text_hash").alias("_hash"), count.alias("_times"))
    plan = plan.groupBy("_id", "_hash").agg(F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(F.struct("*").alias("_row"), group_key(F.col(id_col)).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_other"))
    out = rows.join(plan, ["_id", "_hash"]).withColumn("_other", F.xxhash64("_row")).withColumn("_nth", nth)
    out = out.withColumn("_n", F.expr("cast((_times + _nth - 1) div _rows as int)")).filter(F.col("_n") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
