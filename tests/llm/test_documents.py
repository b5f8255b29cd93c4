"""Document operators against plain Python on a small table with nulls, ties, repeats, long texts and clashing columns."""

import collections
import random
import re
import zlib
from fractions import Fraction
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from propspark.llm import grades, licenses, mixing, packing, quality, sharding, simhash
from propspark.llm.common import cell_bits, group_key, seeded, text_of, words_of

SHAPE = ("doc_id long, text string, lang string, source string, size long, fp long, shard int, words array<string>, n int, _row string, _key long, "
         "key string, taken long, target double, _n int")
RANDOM = np.random.default_rng(1)
WORDS = ["the", "of", "and", "river", "stone", "lamp", "Green", "under", "la", "de", "über", "x1", "then,", "so."]
SPACE = "[^\\x20\\x09-\\x0D]+"


def prose(n):
    return " ".join(RANDOM.choice(WORDS, n))


LONG = prose(30_000)
TEXTS = [
    prose(80), prose(300), prose(80), LONG, "", None, "   \n\t ", "one", "two words", "a b c", "a b c a b c", "a b c " * 60, "Same line\nSame line\n\nother\nSame line",
    "Licensed under the Apache License, Version 2.0.", "GNU  General\nPublic LICENSE, version 3 and the mit license; CC-BY 4", "gnu general gnu general public license",
    "Ünïcode ümläut ß " * 30, "日本語 の テキスト " * 30, "<|endoftext|> marks", "#* $% &| <> " * 40, "THE OF AND " * 100, "x" * 5000, " lead and trail ", "a\u00a0b\u2003c\x0bd\x0ce",
    prose(120) + " the", prose(120)]
TEXTS += [TEXTS[0], TEXTS[1], TEXTS[1] + " end", TEXTS[1] + " End.", TEXTS[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, ("en", "fr", None, "xx")[i % 4], ("b", "a", "ä", None)[min(i % 7, 3)]) for i, t in enumerate(TEXTS)]
    rows += [rows[1], rows[1]]
    return spark.createDataFrame([r + (None,) * 11 for r in rows], SHAPE).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


def bag(items):
    return collections.Counter(repr(tuple(x)) for x in items)


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = Tokenizer.from_file(paths[0])
    got = packing.packed(docs, *paths, window=256, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["offset"] == 0 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    order = sorted(got, key=lambda r: r["sequence_id"])
    assert all(a["length"] >= b["length"] for a, b in zip(order, order[1:]))
    for (doc, text, _, _), n in collections.Counter(rows).items():
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by[doc, len(ids)], key=lambda r: r["start"])
        starts = collections.defaultdict(list)
        for r in mine:
            starts[r["start"]].append(r["ids"])
        at = 0
        for start in sorted(starts):
            assert start == at and len(starts[start]) == n and all(x == ids[at : at + len(x)] for x in starts[start])
            at += len(starts[start][0])
        assert at == len(ids)
        # As few pieces as the binary form of the rest has ones.
        assert len(starts) == len(ids) // 256 + bin(len(ids) % 256).count("1")
    again = packing.packed(docs.repartition(2), *paths, window=256)
    assert bag(again.collect()) == bag(packing.packed(docs, *paths, window=256).collect())
    assert packing.packed(empty, *paths).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, *paths, window=100)


def test_licenses(docs, empty, rows):
    def plain(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = sorted((i, t.label) for t in licenses.BASE for p in [t.parts()[0]] for i in range(len(words)) if words[i : i + len(p)] == p)
        own = {t.label for t in licenses.BASE + licenses.NOTICES for ws, ps in [t.parts()] for s in range(-len(ws), len(words) + 1)
               if all(s + o >= 0 and words[s + o : s + o + len(p)] == p for o, p in ps)}
        at = [i for i, _ in places]
        return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(own)))

    got = licenses.scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()
    assert bag(got) == bag((d, *plain(t)) for d, t, _, _ in rows)
    score = {r["labels"]: r["score"] for r in licenses.scanned(docs).collect()}
    assert score[""] == 0 and score["apache,apache-2.0"] == 1 and all(0 <= s <= 1 for s in score.values())
    assert licenses.scanned(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.index([licenses.Template("none", "no mandatory part")])


def test_license_score_is_the_share_in_place(spark):
    t = licenses.Template("t", "aa bb [cc dd] ee")
    df = spark.createDataFrame([(1, "aa xx cc dd ee"), (2, "cc dd"), (3, "cc aa dd")], "doc_id long, text string")
    got = {r["doc_id"]: (round(r["score"], 6), r["labels"], r["n_base"], r["base_labels"]) for r in licenses.scanned(df, [t]).collect()}
    assert got == {1: (0.8, "t", 0, ""), 2: (0.4, "t", 0, ""), 3: (0, "", 0, "")}


def test_license_postings_are_intersected(spark):
    """Index words alone, in another order or at another distance, lead to no start that all postings share."""
    t = [licenses.Template("one", "[rare words stand here] and more"), licenses.Template("two", "[rare things]"), licenses.Template("three", "[here here]")]
    facts, postings = licenses.index(t, rare=2)
    assert [f["rare"] for f in facts] == [2, 2, 2] and postings["here"] == [{"t": 2, "off": 0}, {"t": 2, "off": 1}]
    assert all(len([p for own in postings.values() for p in own if p["t"] == k]) == 2 for k in range(3))
    texts = ["rare words stand here and more", "here stand words rare", "rare x words stand here", "rare things rare words stand here here", "here here here", "words stand"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(m["label"], m["start"]) for m in r["matches"]] for r in licenses.scanned(df, t).collect()}
    assert got == {0: [("one", 0)], 1: [], 2: [], 3: [("two", 0), ("one", 2), ("three", 5)], 4: [("three", 0), ("three", 1)], 5: []}


def test_every_notice_is_found_once(spark):
    """Each full notice carries its label with score 1."""
    df = spark.createDataFrame([(i, "x " + re.sub(r"[\[\]]", "", t.notice) + " y") for i, t in enumerate(licenses.NOTICES)], "doc_id long, text string")
    for r in licenses.scanned(df).collect():
        t = licenses.NOTICES[r["doc_id"]]
        assert t.label in r["labels"].split(",") and r["score"] == pytest.approx(1.0)
    assert len(licenses.NOTICES) >= 40 and len({t.label for t in licenses.NOTICES}) == len(licenses.NOTICES)


def test_quality_against_given_references(spark, docs):
    """Trusted texts as the reference: a table of nothing but noise cannot pass by being its own measure."""
    from propspark.llm.common import Stored

    rng = random.Random(1)
    prose = [(i, " ".join(rng.choice(("the", "of", "and", f"house{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", "Garden" + chr(97 + j % 26))) for j in range(300)), "en") for i in range(20)]
    noise = [(100 + i, " ".join("9%d!%d" % (i, j) for j in range(300)), "en") for i in range(20)]
    shape = "doc_id long, text string, lang string"
    trusted, bad = spark.createDataFrame(prose, shape), spark.createDataFrame(noise, shape)
    refs = Stored(spark)(quality.references(quality.measured(trusted)))
    assert {r["kept"] for r in quality.checked(bad).collect()} == {True}
    assert {r["kept"] for r in quality.checked(bad, refs).collect()} == {False}
    fair = [r["kept"] for r in quality.checked(trusted, refs).collect() if not r["base_failed"]]
    assert len(fair) > 10 and all(fair)
    assert quality.passing(bad.unionByName(trusted), refs).count() == len(fair)


def test_sharding(docs, empty, rows):
    got = sharded = sharding.sharded(docs, 4).collect()
    assert bag((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got) == bag(
        (d, s, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, s in rows)
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(4))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in counts)
    for source, n in collections.Counter(r["source"] for r in got).items():
        for s in counts:
            assert abs(sum(r["source"] == source for r in got if r["shard"] == s) - n / 4) <= 2
    assert bag(sharding.sharded(docs.repartition(2), 4).collect()) == bag(sharded)
    assert sharding.sharded(empty, 4).count() == 0
    few = sharding.sharded(docs.filter("doc_id < 2").dropDuplicates(["doc_id"]), 16).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2


def test_sharding_step_by_step(spark):
    """Shards and slots from the seeded keys by sorting in plain Python."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 9), rng.choice(["a"] * 6 + ["b", "c", None, f"own{i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "source", F.crc32(F.col("text").cast("binary")).alias("crc"), (F.octet_length("text") + 1).cast("long").alias("size"),
                        group_key(F.col("doc_id")).alias("_id"), group_key(F.col("source")).alias("_source"))
    keyed = keyed.withColumn("key", seeded(7, "_source", "_id", "crc", "size")).withColumn("offset", seeded(8, "_source")).collect()
    groups = collections.defaultdict(list)
    for r in keyed:
        groups[r["_source"]].append(r)
    order = []
    for own in groups.values():
        own.sort(key=lambda r: (r["key"], r["_id"]))
        order += [((i + r["offset"] / (1 << 63)) / len(own), r["_source"], r["_id"], r["doc_id"]) for i, r in enumerate(own)]
    order.sort()
    place = [(i * 7 // 400, i) for i in range(400)]
    first = {s: min(i for t, i in place if t == s) for s in range(7)}
    want = {x[3]: (s, i - first[s]) for x, (s, i) in zip(order, place)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(docs, 7).collect()} == want


def test_small_sources_do_not_share_a_cell(spark, monkeypatch):
    """20,000 sources of one row each: no cell of the order holds more than a small share of them."""
    seen, ranked = [], sharding.ranked

    def counted_cells(df, group, key, ties, n):
        cells = df.groupBy(group, F.shiftright(key, 63 - cell_bits(n))).count()
        seen.append(cells.agg(F.max("count")).first()[0])
        return ranked(df, group, key, ties, n)

    monkeypatch.setattr(sharding, "ranked", counted_cells)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("source"))
    got = sharding.sharded(docs, 16).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {1250} and seen[1] < 200


def counted(text):
    text = text or ""
    words, lines = re.findall(SPACE, text), [x for x in text.split("\n") if re.search(SPACE, x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeats = len({i + k for own in at.values() if len(own) > 1 for i in own for k in range(3)})
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats,
            len(words) < 50 or 100 * repeats > 50 * len(words))


def test_quality_counts(docs, empty, rows):
    got = quality.checked(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert bag(got) == bag((d, *counted(t)) for d, t, _, _ in rows)
    assert quality.checked(empty).count() == 0 and quality.passing(empty).count() == 0


@pytest.mark.parametrize("bits", [2, 5, 24])
def test_repeated_windows_by_either_way(spark, bits):
    texts = [t for t in TEXTS if t] + [" ".join(RANDOM.choice(list("abc"), n)) for n in range(2, 60, 3)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", words_of(text_of())).withColumn("n", F.size("words"))
    windows, pairs, found = quality.repeat_words("n", "words", bits)
    got = df.withColumn("windows", F.expr(windows)).withColumn("pairs", F.expr(pairs)).select("text", F.expr(found)).collect()
    assert all(n == counted(t)[4] for t, n in got)


def test_quality_verdict(spark):
    common, odd = ["the", "of", "and", "river", "stone"], ["#river#", "*stone*"]
    make = lambda words, n: " ".join(RANDOM.choice(words, n)) + " " + " ".join(f"w{i}" for i in range(n))
    rows = [(i, make(common, 200), "en") for i in range(20)] + [(100, make(odd, 200), "en"), (101, make(odd, 30), "en"), (102, make(odd, 200), "fr"), (103, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.checked(df).collect()}
    assert all(got[i]["kept"] for i in range(20)) and not got[100]["kept"] and not got[103]["kept"]
    assert got[101]["kept"] and got[102]["kept"]  # too short to judge; a language with too few words
    kept = quality.passing(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}


def test_divergence(spark):
    df = spark.createDataFrame([([1.0, 3.0], [2.0, 6.0]), ([1.0, 0.0], [0.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [3.0, 1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.divergence(F.col("p"), F.col("q"))).collect()]
    p, q = np.array([0.5, 0.5]), np.array([0.75, 0.25])
    m = (p + q) / 2
    assert got == pytest.approx([0, 1, 0, np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)])


def test_grades(spark, docs, empty):
    good, poor, toxic = ["river", "stone", "lamp"], ["bad##", "poor%%"], ["vile", "awful"]
    make = lambda extra: prose(40) + " " + " ".join(RANDOM.choice(extra, 6))
    kinds = [toxic, poor, good]
    rows = [(i, make(kinds[i % 3]), "pad") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(5, None), (None, 1), (9999, 2)], "doc_id long, grade int")
    model = grades.fitted(df, labels, F.col("grade"), buckets=1 << 14)
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in grades.graded(df, model, F.col("doc_id")).collect()}
    held = range(300, 600)
    assert np.mean([sum(t >= 0.5 for t in got[i]["tails"]) == i % 3 for i in held]) > 0.95
    assert all(got[i]["expected_grade"] == pytest.approx(sum(got[i]["tails"])) and got[i]["tails"][0] >= got[i]["tails"][1] for i in held)
    kept = grades.selected(df, model)
    assert kept.columns == df.columns and np.mean([r["doc_id"] % 3 == 2 for r in kept.collect()]) > 0.95
    again = grades.fitted(df.repartition(7), labels, F.col("grade"), buckets=1 << 14)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.cuts, again.cuts)
    # Any text can be scored, and no rating at all leaves even chances.
    assert grades.graded(docs, model, F.struct("*").alias("_row")).count() == docs.count() and grades.graded(empty, model, F.col("doc_id")).count() == 0
    none = grades.fitted(df, labels.limit(0), F.col("grade"), buckets=1 << 10)
    assert not none.weights.any() and grades.selected(docs, none).count() == docs.count()


def test_mixing(docs, empty, rows):
    size = F.size(words_of(text_of()))
    got = mixing.mixed(docs, size).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(SPACE, t or ""))
    target = water_levels(dict(sizes), cyclic_weights(list(sizes)))
    assert sum(target.values()) == sum(sizes.values()) and all(target[s] <= 3 * sizes[s] for s in sizes)
    source = {(d, len(re.findall(SPACE, t or ""))): s for d, t, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert (r["source_size"], r["target"]) == (sizes[s], float(target[s]))
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= max(n for (_, n), x in source.items() if x == s) for s in sizes)
    assert bag(mixing.mixed(docs.repartition(2), size).collect()) == bag(got)
    out = mixing.repeated(docs, size)
    assert out.columns == docs.columns
    assert sum(len(re.findall(SPACE, r["text"] or "")) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed(empty, size).count() == 0


def cyclic_weights(sources):
    order = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}


def water_levels(sizes, weights, cap=3):
    """Targets by trying every level at which a source stops: the one at which all words are shared out."""
    total, open_ = sum(sizes.values()), [s for s in sizes if weights[s] > 0]
    for stopped in sorted({Fraction(0), *(Fraction(cap * sizes[s], weights[s]) for s in open_)}):
        capped = [s for s in open_ if Fraction(cap * sizes[s], weights[s]) <= stopped]
        rest = [s for s in open_ if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        if not rest or left <= min(Fraction(cap * sizes[s], weights[s]) for s in rest) * sum(weights[s] for s in rest):
            out = {s: Fraction(cap * sizes[s]) for s in capped} | {s: Fraction(left * weights[s], sum(weights[r] for r in rest)) for s in rest}
            return {s: out.get(s, Fraction(0)) for s in sizes}


def test_weights_and_quotas(spark):
    def found(sizes, weights=None):
        table = spark.createDataFrame(list(sizes.items()), "source string, own long")
        got = mixing.quotas(mixing.weighed(table, weights and (lambda names: {n: weights[n] for n in names}), 100)).collect()
        return {r["source"]: r for r in got}

    assert {s: r["weight"] for s, r in found({"b": 1, None: 1, "a": 1, "ä": 1}).items()} == {"a": 1, "b": 2, "ä": 3, None: 1}
    rng = random.Random(6)
    cases = [({"a": 10, "b": 100, "c": 190}, {"a": 1, "b": 1, "c": 1}), ({"a": 0, "b": 6}, {"a": 5, "b": 1}), ({"a": 4, "b": 6}, {"a": 0, "b": 1}), ({"a": 1}, {"a": 0})]
    for _ in range(6):
        sizes = {f"s{i}": rng.choice((0, 1, 7, 10**rng.randint(1, 12))) for i in range(rng.randint(1, 8))}
        cases.append((sizes, {s: rng.randint(0, 5) for s in sizes}))
    for sizes, weights in cases:
        want, got = water_levels(sizes, weights), found(sizes, weights)
        for s in sizes:
            assert got[s]["target"] == pytest.approx(float(want[s]), rel=1e-12) and abs(got[s]["quota"] - want[s]) <= Fraction(1, 2)
    with pytest.raises(ValueError):
        mixing.weighed(spark.createDataFrame([("a", 1), ("b", 1)], "source string, own long"), lambda s: dict.fromkeys(s, 1), 1)


def cheapest(patterns, targets, cap):
    """The largest flow and its least cost by trying all ways to share out whole words."""
    shapes, best = list(patterns), None
    ways = [[w for w in product(*(range(cap * patterns[p] + 1) for _ in p)) if sum(w) <= cap * patterns[p]] for p in shapes]
    for choice in product(*ways):
        into = dict.fromkeys(targets, 0)
        for p, w in zip(shapes, choice):
            for s, n in zip(p, w):
                into[s] += n
        if all(into[s] <= targets[s] for s in targets):
            cost = sum(sum(max(0, sum(w) - r * patterns[p]) for r in range(1, cap)) for p, w in zip(shapes, choice))
            best = min(best or (0, 0), (-sum(map(sum, choice)), cost))
    return best


def test_flow_is_the_cheapest_largest():
    rng = random.Random(3)
    for _ in range(25):
        shapes = rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "c")], 3)
        patterns, cap = {p: rng.randint(0, 2) for p in shapes}, rng.choice((2, 3))
        targets = {s: rng.randint(0, 6) for s in {s for p in shapes for s in p}}
        give = mixing.route(patterns, targets, cap)
        cost = sum(sum(max(0, give[p] - r * patterns[p]) for r in range(1, cap)) for p in shapes)
        assert (-sum(give.values()), cost) == cheapest(patterns, targets, cap)


def test_flow_prefers_first_copies(spark):
    """A shared pattern gives its words where the other source cannot reach without repeats."""
    give = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10})
    assert give == {("a",): 10, ("a", "b"): 10}
    give = mixing.route({("a",): 10, ("b",): 5, ("a", "b"): 10}, {"a": 12, "b": 20})
    assert sum(give.values()) == 32 and sum(max(0, give[p] - n) for p, n in {("a",): 10, ("b",): 5, ("a", "b"): 10}.items()) == 7
    docs = spark.createDataFrame([(i, "w " * 5, ["a"] if i % 2 else ["b", "a"]) for i in range(40)] + [(99, "w " * 30, ["c"])], "doc_id long, text string, lists array<string>")
    out, sources = mixing.taken(docs, F.size(words_of(text_of())), F.col("lists"), weights=lambda s: dict.fromkeys(s, 1))
    assert {r["source"]: (r["own"], r["target"]) for r in sources.collect()} == {"a": (200, 120.0), "b": (100, 120.0), "c": (30, 90.0)}
    assert sum(r["taken"] for r in out.collect()) == 330
    overlapping = F.array(F.col("doc_id"), F.col("doc_id") + 1)
    with pytest.raises(ValueError):
        mixing.taken(docs, F.lit(1), overlapping, max_patterns=3, weights=lambda s: dict.fromkeys(s, 1))
    with pytest.raises(ValueError):
        mixing.taken(docs, F.lit(1), overlapping, max_patterns=3)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """Brute force over distinct fingerprints."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, empty, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t, _, _ in rows]
    root, least = components(set(prints), 2), {}
    for (d, *_), f in zip(rows, prints):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], 1 << 60))
    assert bag(got) == bag((d, f"{f:016x}", least.get(root[f])) for (d, *_), f in zip(rows, prints))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_class(empty).count() == 0
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert {r["doc_id"] for r in kept.collect()} - {None} == set(least.values())


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_hashing_links(spark, radius):
    rng = np.random.default_rng(radius)
    fps = set()
    for _ in range(6):
        f = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):
            fps.add(f)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(b)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from propspark.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.links(df, radius), "a", "b").collect()}
    want = components(fps, radius)
    sets = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert sets(got) == {s for s in sets({signed(f): want[f] for f in fps}) if len(s) > 1}
    with pytest.raises(ValueError):
        simhash.links(df, 1)


def test_components_of_chains_and_stars(spark):
    from propspark.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3), (7, 6), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}


def plain_chances(score, cuts, grade):
    edges = [-np.inf, *cuts, np.inf]
    tail = lambda c: 1 / (1 + np.exp(-(c - score)))
    return tail(edges[grade + 1]) - tail(edges[grade])


def likelihood(x, row, bucket, value, grade, penalty, n_buckets):
    w, cuts = x[:n_buckets], x[n_buckets] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_buckets + 1 :]))])
    score = np.zeros(len(grade))
    for r, b, v in zip(row, bucket, value):
        score[r] += v * w[b]
    return -np.mean([np.log(plain_chances(s, cuts, g)) for s, g in zip(score, grade)]) + penalty * (w @ w)


def test_grades_fit_is_the_best_likelihood():
    """The fit's penalised likelihood against a slow search by finite differences, on 50 rows."""
    rng = np.random.default_rng(3)
    row, bucket = np.repeat(np.arange(50), 3), rng.integers(0, 4, 150)
    value, grade = rng.random(150), rng.integers(0, 3, 50)
    for r in range(50):
        if (bucket[row == r] == 0).sum() >= 1:
            grade[r] = min(2, grade[r] + 1)
    got = grades.fit_ordinal(row, bucket, value, grade, 3, 4, rounds=2000, penalty=1e-2, min_rows=1)
    point = np.concatenate([got.weights.astype(float), [got.cuts[0], np.log(got.cuts[1] - got.cuts[0])]])
    loss = lambda x: likelihood(x, row, bucket, value, grade, 1e-2, 4)

    def slope(x):
        return np.array([(loss(x + h) - loss(x - h)) / 2e-5 for h in np.eye(len(x)) * 1e-5])

    assert np.abs(slope(point)).max() < 2e-3
    slow = np.zeros(6)
    for _ in range(3000):
        slow -= 0.4 * slope(slow)
    assert loss(point) <= loss(slow) + 1e-5 and point == pytest.approx(slow, abs=0.05)


def test_grade_tails_from_scratch(spark):
    """Score, tails and expected grade of fixed weights, recomputed word by word with the same hashes."""
    rng = np.random.default_rng(5)
    model = grades.GradeModel(rng.normal(size=64).astype(np.float32), np.array([-0.5, 0.75]))
    texts = ["Good words, GOOD words 12", "one", "", None, "(x) Y-z 7 7 7 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = df.select("doc_id", *grades.hashed(text_of("text"), 64)).collect()
    want = {}
    for r in ids:
        score = sum(np.sqrt(n / len(own)) * float(model.weights[b]) for own in (r["words"], r["shapes"]) for b, n in collections.Counter(own).items())
        tails = [1 / (1 + np.exp(c - score)) for c in model.cuts]
        want[r["doc_id"]] = (sum(tails), *tails)
    got = {r["doc_id"]: (r["expected_grade"], *r["tails"]) for r in grades.graded(df, model, F.col("doc_id")).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    split = {r["doc_id"]: (len(r["words"]), len(r["shapes"])) for r in ids}
    assert split == {0: (5, 5), 1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (240, 200)}
