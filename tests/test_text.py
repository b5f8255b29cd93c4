import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.functions.text import classify, normalize_text
from propspark.operators import fingerprints as P
from propspark.operators.selectors import BitFrequencySelector, kept_columns, median_impute, prune_columns
from propspark.operators.standardize import standardize_key, standardize_with, strip_fragments


def keys(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, smiles string")


def pairs(df):
    return [(r["smiles_standardized"], r["preprocess_reason"]) for r in df.orderBy("id").collect()]


def test_reasons(spark):
    df = keys(spark, None, "   ", "not_a_smiles", "CCO", "[Na+].")
    out = standardize_key(df, "smiles", valid_regex=r"^[A-Za-z0-9@+\-\[\]\(\)=#.\\/]+$", separator=".", strip=["[Na+]"])
    got = pairs(out)
    assert got[0] == got[1] == (None, "empty_smiles")
    assert got[2] == (None, "invalid_smiles")
    assert got[3] == ("CCO", None)
    assert out.count() == 5


def test_nan_key_is_empty(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 2.5)], "id int, smiles double")
    assert pairs(standardize_key(df, "smiles")) == [(None, "empty_smiles"), ("2.5", None)]


def test_strip_never_removes_everything(spark):
    df = keys(spark, "CC(=O)[O-].[Na+]", "[Na+]", "[Na+].[Na+]")
    got = [r[0] for r in df.orderBy("id").select(strip_fragments(F.col("smiles"), ".", ["[Na+]"])).collect()]
    assert got == ["CC(=O)[O-]", "[Na+]", "[Na+].[Na+]"]


def test_blank_after_strip(spark):
    out = standardize_key(keys(spark, "a. .a"), "smiles", separator=".", strip=["a"])
    assert pairs(out) == [(None, "empty_after_desalt")]


def test_hook(spark):
    def fn(s):
        if s == "boom":
            raise KeyError(s)
        return (None, "invalid_smiles") if s == "bad" else (s.upper(), None)

    got = pairs(standardize_with(keys(spark, "cco", "boom", "bad", None, " "), "smiles", fn))
    assert got == [("CCO", None), (None, "standardize_error:KeyError"), (None, "invalid_smiles"), (None, "empty_smiles"), (None, "empty_smiles")]


@pytest.mark.parametrize("text,bucket", [
    ("unbound intrinsic clearance", "unbound"),
    ("intrinsic clearance in mL/min/kg", "hepatic"),
    ("Appearant clint", "intrinsic"),
    ("apparent clearance", "unknown"),
    ("CLint,u of drug", "unbound"),
    (None, "unknown"),
])
def test_classifier(spark, text, bucket):
    df = spark.createDataFrame([(text, None)], "a string, b string")
    assert df.select(classify(normalize_text(F.col("a"), F.col("b")))).first()[0] == bucket


def test_normalize(spark):
    df = spark.createDataFrame([("  Human\t\nLiver ", None, "X")], "a string, b string, c string")
    assert df.select(normalize_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "human liver | | x"


def _bit(s, n):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % n


def _windows(words, radius):
    return {f"{r}:" + " ".join(words[max(0, i - r): i + r + 1]) for r in range(radius + 1) for i in range(len(words))}


@pytest.mark.parametrize("text", ["", "one", "one two", "a b c d e f g h", "a a a a", "  Äpfel\tund  Birnen  und Äpfel "])
def test_fingerprints_against_python(spark, text):
    words = text.lower().split()
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        P.neighbourhood_bits(F.col("t"), P.NeighbourhoodConfig(2, 64)).alias("n"), P.path_bits(F.col("t"), P.PathConfig(1, 3, 64)).alias("p"),
        P.substructure_bits(F.col("t"), P.SubstructureConfig(3, 64)).alias("s")).first()
    joined = " ".join(words)
    runs = {" ".join(words[i: i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    grams = {joined[i: i + 3] for i in range(len(joined) - 2)}
    assert row["n"] == sorted({_bit(s, 64) for s in _windows(words, 2)})
    assert row["p"] == sorted({_bit(s, 64) for s in runs})
    assert row["s"] == sorted({_bit(s, 64) for s in grams})


def test_names_and_configs():
    names = P.bit_names("fp", 1024)
    assert len(names) == len(set(names)) == 1024
    with pytest.raises(ValueError):
        P.path_bits(None, P.PathConfig(3, 2))


def test_profile_is_finite_or_null(spark):
    row = P.text_profile(spark.createDataFrame([("",), ("Ab 1, ab\nAb 1, ab",)], "t string"), "t").collect()
    assert row[0]["distinct_word_ratio"] is None and row[0]["digit_share"] is None
    assert row[1]["repeated_line_ratio"] == 0.5 and row[1]["n_words"] == 6.0


def test_projection(spark):
    w = P.projection_matrix(8, 3)
    assert np.allclose(np.linalg.norm(w, axis=0), 1.0, atol=1e-6)
    with pytest.raises(ValueError):
        P.projection_matrix(4, 5)
    df = spark.createDataFrame([([1.0] * 8,), (None,)], "v array<double>")
    got = [r[0] for r in df.select(P.project("v", 8, 3)).collect()]
    assert np.allclose(got[0], np.ones(8) @ w, atol=1e-5) and got[1] is None


def test_embed(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    out = P.embed(df, lambda ts: np.array([[len(t), 1] for t in ts], dtype=np.float32), "t", 2, batch=1)
    assert sorted(r["embedding"] for r in out.collect()) == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(ValueError):
        P.embed(df, len, "t", 2, batch=0)


def _bit_rows(spark, ones, n):
    return spark.createDataFrame([(i, [j for j, k in enumerate(ones) if i < k]) for i in range(n)], "id int, bits array<int>")


def test_bit_selector(spark):
    df = _bit_rows(spark, [0, 1, 3, 9, 10], 10)
    sel = BitFrequencySelector(0.2, 0.8).fit(df, "bits", 5)
    assert [r["bit"] for r in sel.support().collect()] == [2]
    df = _bit_rows(spark, [0, 1, 3], 5)
    sel = BitFrequencySelector(0.2, 0.9).fit(df, "bits", 3)
    assert sorted(r["bit"] for r in sel.support().collect()) == [1, 2]
    new = spark.createDataFrame([([0, 1],), ([2],)], "bits array<int>")
    assert [r["bits"] for r in sel.transform(new, "bits").collect()] == [[0], [1]]
    with pytest.raises(RuntimeError):
        BitFrequencySelector().transform(df, "bits")
    for lo, hi in ((-0.1, 0.5), (0.1, 1.1), (0.8, 0.2)):
        with pytest.raises(ValueError):
            BitFrequencySelector(lo, hi)


def test_pruning_and_imputation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, None), (2.0, 5.0, 1.0, None), (3.0, 5.0, 2.0, None), (4.0, 5.0, 3.0, None), (None, 5.0, 4.0, None)],
                               "a double, b double, c double, d double")
    assert [r["feature"] for r in kept_columns(df, df.columns).collect()] == ["a", "c"]
    assert [r["feature"] for r in kept_columns(df, df.columns, drop_constant=False).collect()] == ["a", "b", "c"]
    pruned, names = prune_columns(df, df.columns)
    assert names == ["a", "c"] == pruned.columns
    filled = median_impute(df, df.columns)
    assert filled.columns == ["a", "b", "c"]
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_fingerprints_of_odd_texts(spark):
    """Bits come from Arrow batches and are those of all runs of the text, whatever its characters."""
    texts = [None, "", "  ", "a", "ab", "Ab  c\tD\n\ne", "\U0001f600x\U0001f600 y", "one two one two one", "\x00 \u2003 é"]
    plain = [" ".join(w for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def check(column, runs):
        out = df.select("i", column.alias("bits"))
        assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
        got = [r["bits"] for r in out.orderBy("i").collect()]
        assert got == [sorted({int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 97 for s in runs(t)}) for t in plain]

    c = F.col("text")
    for size in range(1, 5):
        check(P.substructure_bits(c, P.SubstructureConfig(size, 97)), lambda t: [t[i : i + size] for i in range(len(t) - size + 1)])
    words = lambda t: t.split(" ") if t else []
    check(P.path_bits(c, P.PathConfig(1, 3, 97)), lambda t: [" ".join(words(t)[i : i + n]) for n in (1, 2, 3) for i in range(len(words(t)) - n + 1)])
    check(P.neighbourhood_bits(c, P.NeighbourhoodConfig(2, 97)), lambda t: [
        f"{r}:" + " ".join(words(t)[max(0, i - r) : i + r + 1]) for r in range(3) for i in range(len(words(t)))])
