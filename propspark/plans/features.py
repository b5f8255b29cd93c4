"""Feature sets: blocks computed from a key column and put side by side as one MLlib vector."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.operators.fingerprints import (
    PROFILE_COLUMNS, NeighbourhoodConfig, PathConfig, SubstructureConfig,
    bit_names, neighbourhood_bits, path_bits, project, substructure_bits, text_profile,
)
from propspark.operators.selectors import column_medians, impute_with, kept_columns
from propspark.operators.similarity import Block
from propspark.sources.tables import require_columns

KINDS = ("neighbourhood", "path", "substructure", "profile", "dense", "numeric")


@dataclass(frozen=True)
class Feature:
    """One block. ``source`` is the column it reads: text for fingerprints and profiles, an array of
    numbers for ``dense``. ``numeric`` takes existing columns as they are."""

    name: str
    kind: str
    source: str
    n_bits: int = 1024
    radius: int = 3
    min_path: int = 1
    max_path: int = 7
    width: int = 0
    reduce_to: int | None = None
    columns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind: {self.kind}")

    @property
    def family(self) -> str:
        return "binary" if self.kind in ("neighbourhood", "path", "substructure") else "dense"

    @property
    def numbers(self) -> list[str]:
        """Names of the numeric columns of a profile or numeric block."""
        if self.kind == "profile":
            return [f"{self.name}::{c}" for c in PROFILE_COLUMNS]
        return list(self.columns) if self.kind == "numeric" else []

    @property
    def size(self) -> int:
        if self.family == "binary":
            return self.n_bits
        return len(self.numbers) or self.reduce_to or self.width

    @property
    def names(self) -> list[str]:
        if self.family == "binary":
            return bit_names(self.name, self.n_bits)
        return self.numbers or [f"{self.name}::{i}" for i in range(self.size)]


def featurize(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Add one column per block (on-bits or dense array), or one per number for profiles."""
    for f in features:
        if f.kind == "numeric":
            require_columns(df, *f.columns)
            continue
        require_columns(df, f.source)
        src = F.col(f.source)
        if f.kind == "neighbourhood":
            df = df.withColumn(f.name, neighbourhood_bits(src, NeighbourhoodConfig(f.radius, f.n_bits)))
        elif f.kind == "path":
            df = df.withColumn(f.name, path_bits(src, PathConfig(f.min_path, f.max_path, f.n_bits)))
        elif f.kind == "substructure":
            df = df.withColumn(f.name, substructure_bits(src, SubstructureConfig(n_bits=f.n_bits)))
        elif f.kind == "profile":
            before = df.columns
            df = text_profile(df, f.source).select(
                *[F.col(f"`{c}`") for c in before if c not in PROFILE_COLUMNS],
                *[F.col(c).alias(f"{f.name}::{c}") for c in PROFILE_COLUMNS],
            )
        elif f.reduce_to:
            df = df.withColumn(f.name, project(src, f.width, f.reduce_to))
        elif f.name != f.source:
            df = df.withColumn(f.name, src)
    return df


def similarity_block(f: Feature) -> Block:
    """The block under which the similarity engine sees a bit or dense feature."""
    if f.numbers:
        raise ValueError(f"{f.name}: pack numeric columns with profile_array first")
    return Block(f.name, f.name, f.family, f.size)


def profile_array(df: DataFrame, f: Feature) -> DataFrame:
    """Numeric columns of a block as one dense array: pruned and median-imputed over the rows given
    (the domain analysis prepares training and test rows together)."""
    names = f.numbers
    keep = {r["feature"] for r in kept_columns(df, names).collect()}
    names = [c for c in names if c in keep]
    med = {r["feature"]: r["median"] for r in column_medians(df, names).collect()}
    filled = impute_with(df, med, names)
    packed = F.array(*[F.col(f"`{c}`") for c in names])
    return filled.withColumn(f.name, packed).drop(*f.numbers)


def assemble(df: DataFrame, features: Sequence[Feature], numbers: Sequence[str], *, out: str = "_features") -> DataFrame:
    """All blocks side by side as one vector. Fingerprints become sparse vectors in the JVM."""
    cols = []
    for f in features:
        if f.numbers:
            cols += [c for c in f.numbers if c in set(numbers)]
        elif f.family == "binary":
            vec = CountVectorizerModel.from_vocabulary([str(i) for i in range(f.n_bits)], f"_t_{f.name}", f"_v_{f.name}")
            vec.setBinary(True)
            df = vec.transform(df.withColumn(f"_t_{f.name}", F.col(f.name).cast("array<string>"))).drop(f"_t_{f.name}")
            cols.append(f"_v_{f.name}")
        else:
            dense = F.coalesce(F.col(f.name).cast("array<double>"), F.array_repeat(F.lit(0.0), f.size))
            df = df.withColumn(f"_v_{f.name}", array_to_vector(dense))
            df = VectorSizeHint(inputCol=f"_v_{f.name}", size=f.size, handleInvalid="optimistic").transform(df)
            cols.append(f"_v_{f.name}")
    plain = {c: f"_n{i}" for i, c in enumerate(cols) if c in set(numbers)}
    df = df.withColumns({n: F.col(f"`{c}`").cast("double") for c, n in plain.items()}) if plain else df
    inputs = [plain.get(c, c) for c in cols]
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(df).drop(*inputs)


def fit_numbers(train: DataFrame, features: Sequence[Feature]) -> tuple[list[str], dict[str, float]]:
    """Which numeric columns survive and their medians, from training rows only.

    Every surviving column keeps its median: rows to be scored may have gaps that the training rows had not.
    """
    names = [c for f in features for c in f.numbers]
    if not names:
        return [], {}
    found = {r["feature"] for r in kept_columns(train, names).collect()}
    kept = [c for c in names if c in found]
    return kept, {r["feature"]: r["median"] for r in column_medians(train, kept).collect()} if kept else {}


def fill_numbers(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in medians.items()}) if medians else df
