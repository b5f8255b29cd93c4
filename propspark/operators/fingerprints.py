"""Features of text keys: folded binary fingerprints (as sorted on-bit arrays), numeric profiles,
and dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.functions.text import collapse_blanks, md5, tokens


@dataclass(frozen=True)
class NeighbourhoodConfig:
    """Each token with its neighbours up to ``radius`` tokens on either side."""

    radius: int = 3
    n_bits: int = 1024


@dataclass(frozen=True)
class PathConfig:
    """Every run of ``min_path`` to ``max_path`` consecutive tokens."""

    min_path: int = 1
    max_path: int = 7
    n_bits: int = 1024


@dataclass(frozen=True)
class SubstructureConfig:
    """Character runs of length ``size``."""

    size: int = 3
    n_bits: int = 1024


def _folded(text: Column, bits_of: Callable[[list[str]], list[np.ndarray]]) -> Column:
    """Sorted distinct bit numbers of texts, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def fold(texts: pd.Series) -> pd.Series:
        return pd.Series(bits_of(texts.to_list()), dtype=object)

    return fold(text)


def _plain(c: Column) -> Column:
    """The ``tokens`` of a text with single blanks between them."""
    return collapse_blanks(F.lower(F.coalesce(c, F.lit(""))))


def _bits(pieces: Iterable[bytes], n_bits: int) -> np.ndarray:
    """The first 32 bits of every piece's md5, modulo the width."""
    return np.frombuffer(bytearray().join([md5(s).digest()[:4] for s in pieces]), ">u4") % np.uint32(n_bits)


def _sorted_distinct(bits: np.ndarray, n_bits: int) -> np.ndarray:
    held = np.zeros(n_bits, bool)
    held[bits] = True
    return np.flatnonzero(held).astype(np.int32)


def _char_bits(texts: list[str], size: int, n_bits: int) -> list[np.ndarray]:
    """Bits of the character runs of up to three characters, packed to one number each; a run is hashed once for all texts."""
    runs = []
    for text in texts:
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        n = max(0, len(c) - size + 1)
        runs.append(np.unique(sum((c[i : i + n] << 21 * i for i in range(1, size)), c[:n])))
    every = np.unique(np.concatenate(runs)) if runs else np.empty(0, np.int64)
    code = np.stack([every >> 21 * i & (1 << 21) - 1 for i in range(size)], axis=1).astype("<u4").tobytes()
    bits = _bits((code[at : at + 4 * size].decode("utf-32-le").encode() for at in range(0, len(code), 4 * size)), n_bits)
    return [_sorted_distinct(bits[np.searchsorted(every, r)], n_bits) for r in runs]


def _runs(words: list[bytes], n: int) -> Iterator[bytes]:
    """All runs of exactly ``n`` neighbouring words."""
    return map(b" ".join, zip(*(words[i:] for i in range(n)))) if n > 1 else iter(words)


def neighbourhood_bits(c: Column, cfg: NeighbourhoodConfig = NeighbourhoodConfig()) -> Column:
    """Windows are cut off at the start and the end of the text."""
    if cfg.radius < 0 or cfg.n_bits < 1:
        raise ValueError("radius must be >= 0 and n_bits >= 1")
    radius, n_bits = cfg.radius, cfg.n_bits

    def bits_of(text: str) -> np.ndarray:
        words = text.encode().split(b" ") if text else []
        pieces: set[bytes] = set()
        for r in range(radius + 1):
            ends = {*range(min(r, len(words))), *range(max(0, len(words) - r), len(words))}
            windows = {*_runs(words, 2 * r + 1), *(b" ".join(words[max(0, i - r) : i + r + 1]) for i in ends)}
            pieces.update(map((b"%d:" % r).__add__, windows))
        return _sorted_distinct(_bits(pieces, n_bits), n_bits)

    return _folded(_plain(c), lambda texts: [bits_of(t) for t in texts])


def path_bits(c: Column, cfg: PathConfig = PathConfig()) -> Column:
    if not 1 <= cfg.min_path <= cfg.max_path:
        raise ValueError("need 1 <= min_path <= max_path")
    sizes, n_bits = range(cfg.min_path, cfg.max_path + 1), cfg.n_bits

    def bits_of(text: str) -> np.ndarray:
        words = text.encode().split(b" ") if text else []
        return _sorted_distinct(_bits(set().union(*(_runs(words, n) for n in sizes)), n_bits), n_bits)

    return _folded(_plain(c), lambda texts: [bits_of(t) for t in texts])


def substructure_bits(c: Column, cfg: SubstructureConfig = SubstructureConfig()) -> Column:
    size, n_bits = cfg.size, cfg.n_bits

    def bits_of(texts: list[str]) -> list[np.ndarray]:
        if 1 <= size <= 3:
            return _char_bits(texts, size, n_bits)
        return [_sorted_distinct(_bits({t[i : i + size].encode() for i in range(len(t) - size + 1)}, n_bits), n_bits) for t in texts]

    return _folded(_plain(c), bits_of)


def bit_names(token: str, n_bits: int) -> list[str]:
    return [f"{token}::bit_{i}" for i in range(n_bits)]


PROFILE_COLUMNS = (
    "n_chars", "n_words", "distinct_word_ratio", "mean_word_len", "digit_share", "punct_share",
    "upper_share", "n_lines", "repeated_line_ratio",
)


def text_profile(df: DataFrame, col: str) -> DataFrame:
    """Numeric descriptors of a text column; what is not finite becomes null."""
    text = F.coalesce(F.col(col), F.lit(""))
    staged = df.withColumns({"_w": tokens(text), "_l": F.split(text, "\n"), "_n": F.char_length(text)})
    n, words, lines = F.col("_n"), F.col("_w"), F.col("_l")
    share = lambda pattern: F.try_divide(n - F.char_length(F.regexp_replace(text, pattern, "")), n)
    ratio = lambda a: F.try_divide(F.size(F.array_distinct(a)), F.size(a))
    return staged.withColumns(
        {
            "n_chars": n.cast("double"),
            "n_words": F.size(words).cast("double"),
            "distinct_word_ratio": ratio(words),
            "mean_word_len": F.try_divide(F.char_length(F.array_join(words, "")), F.size(words)),
            "digit_share": share("[0-9]"),
            "punct_share": share(r"[.,;:!?]"),
            "upper_share": share("[A-Z]"),
            "n_lines": F.size(lines).cast("double"),
            "repeated_line_ratio": F.lit(1.0) - ratio(lines),
        }
    ).drop("_w", "_l", "_n")


def projection_matrix(in_dim: int, out_dim: int, seed: int = 0) -> np.ndarray:
    """Seeded Gaussian matrix with unit columns."""
    if not 0 < out_dim <= in_dim:
        raise ValueError(f"output size must be in [1, {in_dim}]")
    w = np.random.default_rng(seed).standard_normal((in_dim, out_dim)).astype(np.float32)
    return w / (np.linalg.norm(w, axis=0, keepdims=True) + 1e-12)


def project(c: Column | str, in_dim: int, out_dim: int, seed: int = 0) -> Column:
    """Dense vector times the fixed projection, in Arrow batches; the matrix comes from its seed."""
    w = projection_matrix(in_dim, out_dim, seed)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(v: pd.Series) -> pd.Series:
        have = v.notna().to_numpy()
        dense = np.zeros((len(v), w.shape[1]), dtype=np.float32)
        if have.any():
            dense[have] = np.stack(v[have].to_list()).astype(np.float32) @ w
        return pd.Series([row if ok else None for row, ok in zip(dense, have)], dtype=object)

    return apply(c)


def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray], col: str, dim: int, *, out_col: str = "embedding", batch: int = 64) -> DataFrame:
    """Run a user's own encoder (texts in, matrix out) over Arrow batches, ``batch`` rows at a time."""
    if batch <= 0:
        raise ValueError("batch must be > 0")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                m = np.asarray(fn(part[col].tolist()), dtype=np.float32)
                if m.shape != (len(part), dim):
                    raise ValueError(f"encoder gave shape {m.shape}, expected {(len(part), dim)}")
                yield part.assign(**{out_col: list(m)})

    return df.mapInPandas(run, schema)
