"""The classifier's sample reaches the driver in chunks; what is fitted is that of the whole sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.llm import grades


def test_sample_comes_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [["vile", "awful"], ["bad", "poor"], ["river", "lamp"]]
    rows = [(i, " ".join(rng.choice(words[i % 3] + ["the", "of", "and"], 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(190)], "doc_id long, grade int")
    sizes = []
    monkeypatch.setattr(type(docs), "toArrow", lambda self, f=type(docs).toArrow: (t := f(self), sizes.append(t.num_rows))[0])
    fit = lambda **k: grades.fitted(docs, labels, F.col("grade"), buckets=1 << 12, rounds=40, **k)
    whole, some = fit(), fit(max_rows=100)
    assert sizes == [190, 100]
    sizes.clear()
    monkeypatch.setattr(grades, "CHUNK", 25)
    parts, fewer = fit(), fit(max_rows=100)
    assert max(sizes) <= 25 and sum(sizes) == 290
    for a, b in ((whole, parts), (some, fewer)):
        assert a.weights.any() and a.weights == pytest.approx(b.weights, abs=1e-6) and a.cuts == pytest.approx(b.cuts, abs=1e-9)
