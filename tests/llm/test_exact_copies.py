"""Chunk recipes against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from propspark.llm import recipes

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgABC éÄß日\n", k=rng.randint(1, 9)))
    long = " ".join(word() for _ in range(60_000))
    texts = ["", None, " ", "a", "A", "Ä", "ä", long, long.swapcase().translate(CAPITALS), long + "x", long[:-1], "x" * 300_000, "x" * 300_001]
    texts += [" ".join(word() for _ in range(rng.choice((1, 5, 900)))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(60)] + ["hot"] * 200
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(None, "a"), (None, "alone"), (None, "alone"), (5, "again"), (5, "AGAIN")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(CAPITALS)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return groups, sorted(out, key=repr)


@pytest.mark.parametrize("key_bytes", [16, 1])
def test_groups(spark, rows, key_bytes):
    """Keys of one byte collide, so they are lengthened until no two contents share one."""
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, recipe int, key string")
    got = recipes.exact_duplicates(df, mean=256, key_bytes=key_bytes).collect()
    groups, want = expected(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_key_length(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert recipes.colliding_keys(df, mean=256, key_bytes=1).count() > 0
    assert recipes.verified_key_bytes(df, mean=256, key_bytes=1) in (4, 8)
    assert recipes.verified_key_bytes(df.limit(0)) == 16


def test_cuts_follow_the_content():
    """Most chunks of a text return after bytes are put before it; their sizes stay within the bounds and their contents make up the text."""
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghij ", k=100_000))
    of = recipes._chunker(512, 16, 42)
    a, b = of(text), of("something before " + text)
    assert b"".join(c for _, c in a).decode() == text
    assert all(128 <= len(c) <= 4096 for _, c in a[:-1]) and len(a) > 60
    assert len({k for k, _ in a} & {k for k, _ in b}) > 0.9 * len(a)


def test_without_copies(spark, rows):
    df = spark.createDataFrame([(i, t, n, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _other int, _row int")
    got = recipes.without_copies(df, mean=256)
    assert got.columns == df.columns
    groups, want = expected(rows)
    kept = got.collect()
    assert len(kept) == len(groups)
    assert {((r["text"] or "").translate(CAPITALS), r["doc_id"]) for r in kept} == {
        (t, max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}


def test_empty_and_other_ids(spark):
    df = spark.createDataFrame([("b", "T"), ("a", "t")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in recipes.exact_duplicates(df).collect()} == {("a", "b", False), ("b", "b", True)}
    assert recipes.exact_duplicates(df.limit(0)).count() == 0
    assert recipes.without_copies(df.filter(F.lit(False))).count() == 0
