"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from propspark.llm import lexical


def terms(text):
    return re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ä%d" % i for i in range(20)]
    some = lambda n: rng.choice((" ", ", ", "-", "\n")).join(rng.choices(vocabulary, range(420, 0, -1), k=n))
    texts = [some(rng.choice((1, 8, 60, 300))) for _ in range(300)]
    texts += [rng.choice(texts) for _ in range(150)] + ["w399 W7 w8"] * 120 + ["", None, "!?", some(40_000), "common"] + ["common w1"] * 40
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(None, "w399 w7 w8"), (7, "w3 repeated"), (7, "w3 repeated")]


ITEMS = [(0, "W399 w7, w7; w8"), (1, "w1 w2 w3 w4 ä5"), (2, "nothing of it"), (3, None), (4, ""), (5, "common"), (6, "w0"), (6, "w300 w1"), (None, "w5 W6"),
         (8, " ".join(f"w{i}" for i in range(400))), (9, "repeated Ä3")]


def found(spark, docs, items, k=10, **options):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, score string").repartition(5)
    q = spark.createDataFrame([(*r, "y") for r in items], "item_id int, text string, rank string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, q, k, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"width": 8}, {"width": 1}, {"first_share": 1}, {"block_terms": 50}])
def test_against_all_scores(spark, docs, options):
    """Few coordinates make loose bounds, never other results."""
    assert found(spark, docs, ITEMS, **options) == brute(docs, ITEMS, 10)


def test_fewer_than_k(spark, docs):
    assert found(spark, docs[:40], ITEMS, 100) == brute(docs[:40], ITEMS, 100)
    assert found(spark, docs, ITEMS, 1) == brute(docs, ITEMS, 1)


def test_empty_tables(spark, docs):
    assert found(spark, [], ITEMS) == [] and found(spark, docs, []) == [] and found(spark, [(1, None), (2, " ")], ITEMS) == []


def test_text_ids(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "two three")], "item_id string, text string")
    assert [r["doc_id"] for r in lexical.search(d, q, 4).orderBy("rank").collect()] == ["c", "a", "b", None]


def test_bounds_hold(spark, docs):
    """The peak of a coordinate is the largest count of the terms hashed to it."""
    import numpy as np
    from xxhash import xxh64_intdigest

    d = spark.createDataFrame([*docs, (10_000, "many " * 300 + "few"), (10_001, "most " * 70_000)], "doc_id long, text string")
    for r in lexical.indexed(d, width=16).collect():
        own = r["terms"].split(" ") if r["n"] else []
        counts = lexical.whole_numbers(r["counts"], len(own)).tolist()
        want = {}
        for t, n in zip(own, counts, strict=True):
            c = xxh64_intdigest(t, 42) % 16
            want[c] = max(want.get(c, 0), n)
        coords = np.frombuffer(r["coords"], "<u2").tolist()
        assert dict(zip(coords, lexical.whole_numbers(r["peaks"], len(coords)).tolist(), strict=True)) == want
        assert r["n"] == sum(counts)
