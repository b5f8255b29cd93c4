"""Filter interactions against walks through all orders in plain Python."""

import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from propspark.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, mask int"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_path_counts():
    """Orders through a state are those that reach it times those that leave it."""
    reach, leave = audit.path_counts(4)
    for state in range(16):
        k = state.bit_count()
        assert (reach[state], leave[state]) == (math.factorial(k), math.factorial(4 - k))
    assert audit.path_counts(1) == ([1, 1], [1, 1])


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        docs.append((lang or "", i, fails))
    out = {}
    for part in {d[0] for d in docs}:
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                failing = [d for d in docs if d[0] == part and f in d[2]]
                left = [d for d in left if f not in d[2]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[2] == {f} for d in failing),
                                                   sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = []
    for _ in range(120):
        n = rng.choice((0, 3, 99, 100, 150))
        words = [rng.choice(("w", "W", "WORD", "$", "a#")) + str(rng.randrange(rng.choice((40, 4000)))) for _ in range(n)]
        texts.append(rng.choice((" ", "\n", "\t \x0b")).join(w.lower() if rng.random() < 0.5 else w for w in words))
    texts += rng.choices(texts, k=80) + [None, "", None, "x " * 50_000, "Ä ß" * 60]
    out = [(i, t, rng.choice(("de", "en", "", None))) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [(None, "null id", "de"), (None, "null id", None), (3, "repeated", "en"), (3, "repeated", "en"), (9, "repeated", "fr")]


def test_all_orders(spark, rows):
    rng = random.Random(5)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in got.collect()} == brute(rows, labels)
    assert got.count() == 120 * 5 * 4


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs.limit(0), labels).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in audit.audited(docs, labels).collect()} == {(0, 0)}
    assert audit.audited(docs, None).count() == 2400


def test_other_filters(spark):
    """Any filters by letter; the sums over all orders add up to the documents that fail any, times the number of orders."""
    docs = spark.createDataFrame([(i, str(i)) for i in range(60)], "doc_id long, text string")
    filters = {"x": F.col("doc_id") % 2 == 0, "y": F.col("doc_id") % 3 == 0, "z": F.when(F.col("doc_id") > 50, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") < 10)}
    got = audit.interactions(audit.failures(docs, filters), "xyz").collect()
    assert len(got) == 18 and {r["part"] for r in got} == {""}
    shapley = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}
    assert sum(shapley.values()) == 6 * sum(i % 2 == 0 or i % 3 == 0 or i < 10 for i in range(60))
    for bad in ("", "xx", "abcdefghi"):
        with pytest.raises(ValueError):
            audit.interactions(audit.failures(docs, filters), bad)
