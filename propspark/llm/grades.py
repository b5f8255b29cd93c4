"""Graded quality by an ordinal cumulative-link regression on hashed text.

One weight vector is shared by all grades: a text's score is the weighted sum of its hashed words and
word shapes, and rising thresholds turn the score into the chance of each grade or better. Hashing runs
in column functions; counts and weights are handled in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import SPACES, Stored, seeded, text_of

#: Documents of the sample that reach the driver at a time.
CHUNK = 1500


@dataclass
class GradeModel:
    """Weights by bucket and rising thresholds: P(grade > k) = 1 / (1 + exp(cuts[k] - score))."""

    weights: np.ndarray
    cuts: np.ndarray


def hashed(text: Column, buckets: int) -> list[Column]:
    """Buckets of the words, lower-cased and without marks, and buckets of the word shapes.

    A shape is a word with each run of capitals as A, of other letters as a, and of digits as 0. Words
    fill the lower seven eighths of the buckets, shapes the rest.
    """
    low = buckets * 7 // 8
    words = F.filter(F.split(F.lower(text), "[\\p{Punct}\\x20\\x09-\\x0D]+"), lambda w: w != "")
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\p{Lu}+", "A"), "[\\p{L}&&[^A]]+", "a"), "[0-9]+", "0")
    shapes = F.filter(F.split(shaped, SPACES), lambda w: w != "")
    return [
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(low)).cast("int")).alias("words"),
        F.transform(shapes, lambda w: (F.pmod(F.xxhash64(w), F.lit(buckets - low)) + low).cast("int")).alias("shapes")]


def _featurizer():
    """A function that gives (row, bucket, value) of a batch; value is the root of the bucket's share in the text."""

    def build(batch: pa.RecordBatch):
        import numpy as np

        parts = []
        for name in ("words", "shapes"):
            lists = batch.column(name)
            ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(ends)
            ids = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
            key, n = np.unique(np.repeat(np.arange(len(size), dtype=np.int64), size) << 32 | ids, return_counts=True)
            row = key >> 32
            parts.append((row, key & 0xFFFFFFFF, np.sqrt(n / np.maximum(size, 1)[row])))
        return tuple(np.concatenate(x) for x in zip(*parts))

    return build


def fit_ordinal(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int, buckets: int, *, rounds: int = 200,
                rate: float = 0.5, penalty: float = 2e-6, min_rows: int = 5) -> GradeModel:
    """Penalised maximum likelihood of the cumulative logit model, by Adam on all rows.

    Buckets held by fewer than ``min_rows`` rows keep weight 0. Without rows the chances are even.
    """
    return _fit([(row, bucket, value)], grade, n_grades, buckets, rounds=rounds, rate=rate, penalty=penalty, min_rows=min_rows)


def _fit(parts: list[tuple], grade: np.ndarray, n_grades: int, buckets: int, *, rounds: int = 200, rate: float = 0.5, penalty: float = 2e-6,
         min_rows: int = 5) -> GradeModel:
    """The same over entries in parts (row, bucket, value), which are used up: they are held once, in 32 bits each, and worked on in blocks."""
    n = len(grade)
    above = np.array([(grade > k).sum() for k in range(n_grades - 1)], float)
    cuts = np.maximum.accumulate(-np.log((above + 0.5) / (n - above + 0.5)))
    weights = np.zeros(buckets, np.float32)
    used = sum((np.bincount(bucket, minlength=buckets) for _, bucket, _ in parts), np.zeros(buckets, np.int64)) >= min_rows
    if n == 0 or not used.any() or len(np.unique(grade)) < 2:
        return GradeModel(weights, cuts)
    place, blocks = (np.cumsum(used) - 1).astype(np.int32), []
    while parts:
        row, bucket, value = parts.pop(0)
        for s in (slice(i, i + (1 << 18)) for i in range(0, len(row), 1 << 18)):
            hold = used[bucket[s]]
            blocks.append((row[s][hold].astype(np.int32), place[bucket[s][hold]], value[s][hold].astype(np.float32 if value.dtype == np.float32 else float)))
    del row, bucket, value
    x = np.zeros(used.sum() + n_grades - 1)
    x[-(n_grades - 1)] = cuts[0]
    x[len(x) - n_grades + 2 :] = np.log(np.maximum(np.diff(cuts), 1e-2))
    first, second = np.zeros_like(x), np.zeros_like(x)
    edge = lambda c: np.concatenate([[-np.inf], c, [np.inf]])
    logistic = lambda t: 0.5 * (1 + np.tanh(np.clip(t, -60, 60) / 2))
    for t in range(1, rounds + 1):
        w, gaps = x[: 1 - n_grades], np.exp(x[len(x) - n_grades + 2 :])
        cuts = x[-(n_grades - 1)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = sum(np.bincount(row, weights=value * w[at], minlength=n) for row, at, value in blocks)
        c = edge(cuts)
        low, high = logistic(c[grade] - score), logistic(c[grade + 1] - score)
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_score = (d_high - d_low) / p / n
        d_cut = np.array([(d_low / p)[grade == k + 1].sum() - (d_high / p)[grade == k].sum() for k in range(n_grades - 1)]) / n
        g = np.concatenate([
            sum(np.bincount(at, weights=value * d_score[row], minlength=len(w)) for row, at, value in blocks) + 2 * penalty * w, [d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * gaps])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
        x = x - rate * (1 - t / (rounds + 1)) * step
    weights[used] = x[: 1 - n_grades]
    return GradeModel(weights, x[-(n_grades - 1)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(x) - n_grades + 2 :]))]))


def fitted(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int = 3, *, max_rows: int = 12_000, buckets: int = 1 << 20, seed: int = 5,
           id_col: str = "doc_id", text_col: str = "text", **options) -> GradeModel:
    """A model of the rated documents: at most ``max_rows`` of them, the first by a seeded hash of their ids.

    ``grade`` is a column of ``labels`` from 0 (worst); rows without one are left out, and of several
    ratings the lowest counts. Only hashed counts of the sample reach the driver, ``CHUNK`` documents at a time.
    """
    rated = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).filter("_grade is not null and _id is not null")
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).withColumn("_order", seeded(seed, "_id"))
    rated = F.broadcast(rated.orderBy("_order", "_id").limit(max_rows))
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(rated, "_id")
    build = _featurizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, bucket, value = build(batch)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype("int32")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[order].astype(t))) for v, t in ((bucket, "int32"), (value, "float32"))]
            yield pa.RecordBatch.from_arrays([batch.column("_grade"), batch.column("_order"), batch.column("_tie"), *lists],
                                             ["_grade", "_order", "_tie", "bucket", "value"])

    found = rows.select("_grade", "_order", F.xxhash64("text").alias("_tie"), *hashed(F.col("text"), buckets)).mapInArrow(
        run, "_grade int, _order long, _tie long, bucket array<int>, value array<float>")
    # The sample is stored in its order; a chunk is all that Spark's driver and Arrow hold beside the fit's own arrays.
    keep = Stored(docs.sparkSession)
    sample, path = keep.put(found.orderBy("_order", "_tie", "_grade").limit(max_rows).select("_grade", "bucket", "value").withColumn(
        "_at", F.monotonically_increasing_id()))
    spans = sample.select((F.col("_at") - F.col("_at") % CHUNK).alias("_from"), "_at").groupBy("_from").agg(F.max("_at").alias("_to")).orderBy("_from").collect()
    grades, parts, n = [np.zeros(0, np.int32)], [], 0
    for span in spans:
        chunk = sample.filter(F.col("_at").between(span["_from"], span["_to"])).coalesce(1).sortWithinPartitions("_at").toArrow()
        grade, bucket, value = (chunk.column(c).combine_chunks() for c in ("_grade", "bucket", "value"))
        row = np.repeat(np.arange(n, n + len(grade), dtype=np.int32), np.diff(bucket.offsets.to_numpy()))
        # Copies, so that no buffer of Arrow stays.
        parts.append((row, bucket.flatten().to_numpy().copy(), value.flatten().to_numpy().copy()))
        grades.append(grade.to_numpy().copy())
        n += len(grade)
    keep.drop(path)
    return _fit(parts, np.concatenate(grades), n_grades, buckets, **options)


def graded(docs: DataFrame, model: GradeModel, *carry: Column, text_col: str = "text") -> DataFrame:
    """The columns of ``carry`` with ``expected_grade`` and ``tails``, an array of P(grade >= 1), P(grade >= 2), ...

    Whole texts are scored, without a shuffle. Null and empty texts get score 0, the chances of a text
    that tells nothing. Repeated rows are scored alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    build, buckets = _featurizer(), len(model.weights)
    text = text_of(text_col)
    src = docs.select(*carry, *hashed(text, buckets))
    names = src.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        weights, cuts = sent.value
        for batch in batches:
            row, bucket, value = build(batch)
            score = np.bincount(row, weights=value * weights[bucket], minlength=batch.num_rows)
            tails = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
            ends = np.arange(0, len(cuts) * (batch.num_rows + 1), len(cuts), dtype="int32")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tails.ravel()))],
                [*names, "expected_grade", "tails"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(run, kinds + ", expected_grade double, tails array<double>")


def selected(docs: DataFrame, model: GradeModel, *, min_tail: float = 0.4, grade: int = 2, text_col: str = "text") -> DataFrame:
    """The documents (all columns) whose chance of ``grade`` or better is at least ``min_tail``."""
    out = graded(docs, model, F.struct("*").alias("_row"), text_col=text_col)
    return out.filter(F.get("tails", F.lit(grade - 1)) >= min_tail).select("_row.*")
