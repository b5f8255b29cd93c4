"""Nearest-neighbour similarity between two tables, as block products inside Spark tasks.

Tanimoto for on-bit arrays, cosine for dense vectors, and the mean over blocks for combined feature
sets. On-bits travel as packed 64-bit words. Pairs never become rows: each task multiplies two blocks and emits
only the k best values per left row. Three routes give the same result:

* the right side is shown to be small: it is broadcast and every left row is finished where it lies;
* the left side is shown to be small: it is broadcast, the right side streams by without a shuffle;
* otherwise both sides are cut into chunks. Rows are chunked by coordinates that bound similarities (the number of
  on-bits; the angles to pivot vectors), a first round takes each row to its most promising chunks, and a second
  one only where its k best can still be beaten. Rows travel to blocks of chunks, whose number follows from what a task
  can hold: however small the chunks are, a row is copied once for each block that holds one it must see.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.operators.ordered import global_index
from propspark.session import broadcast_if_small, cut_lineage
from propspark.sources.tables import is_empty, require_columns

# Cells (rows x numbers or 32-bit words) of a side that may be broadcast: 160 MB of numbers, 80 MB of words.
BROADCAST_CELLS = 20_000_000
CHUNK_CELLS = 4_000_000
# Pivot vectors, the rows that they are chosen from, and the runs of chunks that rows are bounded against.
PIVOTS, PIVOT_ROWS, REGIONS = 32, 2048, 4096
# Rows and columns of a tile of similarities, which stays in the cache, and the least blocks that a side of many chunks makes.
TILE, MIN_BLOCKS = (256, 1024), 8


@dataclass(frozen=True)
class Block:
    """One feature block: a column of on-bits (binary) or of numbers (dense)."""

    name: str
    column: str
    family: str
    width: int

    def __post_init__(self):
        if self.family not in ("binary", "dense"):
            raise ValueError(f"unknown feature family: {self.family}")

    @property
    def cells(self) -> int:
        return self.width if self.family == "dense" else 2 * _words(self.width)


def _words(width: int) -> int:
    return max(1, -(-width // 64))


def pack_bits(values: Sequence, width: int) -> np.ndarray:
    """Lists of on-bits as rows of 64-bit words; a missing list has none."""
    out = np.zeros((len(values), _words(width)), "<u8")
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024]
        sizes = [0 if v is None else len(v) for v in part]
        flat = np.zeros((len(part), out.shape[1] * 64), np.uint8)
        if sum(sizes):
            flat[np.repeat(np.arange(len(part)), sizes), np.concatenate([np.asarray(v, dtype=np.int64) for v in part if v is not None])] = 1
        out[at : at + 1024] = np.packbits(flat, axis=1, bitorder="little").view("<u8")
    return out


def _packed(rows: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """The rows with every on-bit column as the bytes of its words."""
    widths: dict[str, int] = {}
    for b in blocks:
        if b.family == "binary":
            widths[b.column] = max(b.width, widths.get(b.column, 0))
    return rows.withColumns({column: _packer(width)(column) for column, width in widths.items()})


def _packer(width: int) -> Callable:
    @F.pandas_udf(T.BinaryType())
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([w.tobytes() for w in pack_bits(v.tolist(), width)], dtype=object)

    return pack


def _matrix(values: Sequence, block: Block) -> np.ndarray:
    """Rows of one block: words of packed bits, or numbers of unit length; missing rows are all zero."""
    n = len(values)
    if block.family == "binary":
        return np.frombuffer(b"".join(values), "<u8").reshape(n, -1) if n else np.zeros((0, _words(block.width)), "<u8")
    zero = np.zeros(block.width)
    m = np.stack([zero if v is None else np.asarray(v, dtype=np.float64) for v in values]) if n else np.zeros((0, block.width))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _bits(m: np.ndarray) -> np.ndarray:
    """Rows of packed bits as zeros and ones."""
    return np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def _common_bits(b: np.ndarray, n: int) -> Callable[[np.ndarray, np.ndarray], None]:
    """A function that writes for up to ``n`` packed rows how many bits each shares with each row of ``b``.

    Rows of 512 to 4,032 bits are multiplied as zeros and ones, two rows of ``b`` as one, the second one times 4,096: such sums are
    whole numbers below 2^24 and exact in single precision. Other widths count the bits of their words.
    """
    words, half = b.shape[1], -(-len(b) // 2)
    if 8 <= words < 64:
        two = _bits(b[:half])
        two[: len(b) - half] += 4096 * _bits(b[half:])
        sums, whole, low = (np.empty((n, half), t) for t in (np.float32, np.int32, np.int32))

        def product(a: np.ndarray, out: np.ndarray) -> None:
            k = len(a)
            whole[:k] = np.matmul(_bits(a), two.T, out=sums[:k])
            out[:, :half] = np.bitwise_and(whole[:k], 4095, out=low[:k])
            out[:, half:] = np.right_shift(whole[:k], 12, out=low[:k])[:, : len(b) - half]

        return product
    columns = np.ascontiguousarray(b.T)

    def counted(a: np.ndarray, out: np.ndarray) -> None:
        held = np.zeros((len(a), len(b)), np.uint32)
        for w, column in enumerate(columns):
            held += np.bitwise_count(a[:, w, None] & column)
        out[:] = held

    return counted


def _on(m: np.ndarray) -> np.ndarray:
    """On-bits of every row."""
    return np.bitwise_count(m).sum(axis=1, dtype=np.float64)


def block_similarity(a: np.ndarray, b: np.ndarray, family: str) -> np.ndarray:
    """All pairs of two prepared blocks. An empty union or a zero vector gives 0."""
    return a @ b.T if family == "dense" else _tanimoto(a, b, np.full(len(a), -np.inf))[1]


def _tanimoto(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``a`` that may be more than ``need`` similar to a row of ``b``, and their similarities to all of it.

    Rows are taken a few at a time, so that counts stay in the cache; single precision tells which of them matter.
    """
    if not len(b):
        return np.arange(len(a)), np.zeros((len(a), 0))
    step = max(1, min(len(a), (1 << 18) // len(b)))
    inter, ratio = (np.empty((step, len(b)), np.float32) for _ in range(2))
    on_a, on_b, common = _on(a), _on(b), _common_bits(b, step)
    some_a, some_b = np.maximum(on_a, 0.5).astype(np.float32), on_b.astype(np.float32)
    rows, sims = [np.empty(0, int)], [np.empty((0, len(b)))]
    for at in range(0, len(a), step):
        part = slice(at, min(at + step, len(a)))
        held, share = inter[: part.stop - at], ratio[: part.stop - at]
        common(a[part], held)
        np.subtract(np.add(some_a[part, None], some_b, out=share), held, out=share)
        hit = np.flatnonzero(~(np.divide(held, share, out=share).max(axis=1) <= need[part] - 1e-6))
        exact = held[hit].astype(np.float64)
        rows.append(at + hit)
        sims.append(exact / np.maximum(on_a[at + hit, None] + on_b - exact, 1))
    return np.concatenate(rows), np.concatenate(sims)


class _Best:
    """Running k best values per left row for each (feature set, scope)."""

    def __init__(self, n: int, k: int, keys: Sequence[tuple[str, str]]):
        self.k = k
        self.top = {key: np.full((n, k), -np.inf) for key in keys}
        self.least = {key: np.full(n, -np.inf) for key in keys}

    def add(self, key: tuple[str, str], at: np.ndarray, sim: np.ndarray, peak: np.ndarray) -> None:
        """Merge the similarities of the left rows ``at``; rows whose ``peak`` is not above their k-th best stay as they are."""
        hit = np.flatnonzero(~(peak <= self.least[key][at]))
        if len(hit):
            both = np.concatenate([self.top[key][at[hit]], sim[hit]], axis=1)
            best = np.partition(both, -self.k, axis=1)[:, -self.k :]
            self.top[key][at[hit]] = best
            self.least[key][at[hit]] = best[:, 0]

    def needed(self, at: np.ndarray, feature_sets: Mapping[str, Sequence[str]], flagged: bool) -> np.ndarray:
        """What the rows must exceed in a block that all feature sets share before any of their k-th best values changes."""
        out = np.full(len(at), np.inf)
        for (fs, scope), least in self.least.items():
            if scope == "all" or flagged:
                # The mean over B blocks can exceed f only if the shared block's share exceeds B f - (B - 1).
                n = len(feature_sets[fs])
                np.minimum(out, least[at] if n == 1 else n * least[at] - (n - 1) - 1e-6, out=out)
        return out

    def rows(self, ids: pd.Series) -> Iterator[pd.DataFrame]:
        for (fs, scope), m in self.top.items():
            row, col = np.nonzero(np.isfinite(m))
            yield pd.DataFrame({"id": ids.to_numpy()[row], "feature_set": fs, "scope": scope, "sim": m[row, col]})


def _codes(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are (NaN is equal to nothing)."""
    both = np.concatenate([left.to_numpy(), right.to_numpy()])
    codes = pd.factorize(both, use_na_sentinel=both.dtype.kind == "f")[0].astype(np.int32)
    return np.where(codes < 0, -2, codes)[: len(left)], codes[len(left) :]


def _mats(rows: pd.DataFrame, blocks: Sequence[Block]) -> dict[str, np.ndarray]:
    return {b.name: _matrix(rows[b.column].tolist(), b) for b in blocks}


def _flagged_first(rows: pd.DataFrame, *before: str) -> tuple[pd.DataFrame, int | None]:
    """The right rows with flagged ones first (below the order of other columns) and how many are flagged; None without flags."""
    if "_ft" in rows:
        return rows.iloc[np.lexsort([~rows["_ft"].to_numpy(bool), *[rows[c].to_numpy() for c in before]])], int(rows["_ft"].sum())
    return (rows.sort_values(list(before), kind="stable") if before else rows), None


def _score(best: _Best, left: dict, right: dict, blocks, feature_sets, n_flagged: int | None, same: tuple | None, at: np.ndarray | None = None) -> None:
    """Meet the left rows ``at`` (all by default) with all right rows, tile by tile.

    ``same`` has the codes of both sides' ids where equal ones are left out. Flagged right rows come first. Where all feature sets
    share a binary block, tiles hold rows of like on-bit counts, those of the nearest counts come first, and a row leaves out
    the tiles whose counts keep them from changing its best values.
    """
    n_left, n_right = (len(m[blocks[0].name]) for m in (left, right))
    at = np.arange(n_left) if at is None else at
    if not len(at) or not n_right:
        return
    cuts, tile_rows = sorted({*range(0, n_right, TILE[1]), n_right, n_flagged or 0}), TILE[0]
    main = _shared_block(blocks, feature_sets)
    main = main if main and main.family == "binary" else None
    if main:
        on_left, on_right, tile_rows = _on(left[main.name]), _on(right[main.name]), TILE[1]
        order = np.lexsort((on_right, np.arange(n_right) >= (n_flagged or 0)))
        right, same = {name: m[order] for name, m in right.items()}, same and (same[0], same[1][order])
        at = at[np.argsort(on_left[at], kind="stable")]
        least, most = (f.reduceat(on_right[order], cuts[:-1])[:, None] for f in (np.minimum, np.maximum))
    for i in range(0, len(at), tile_rows):
        rows, tiles = at[i : i + tile_rows], range(len(cuts) - 1)
        if main:
            bound = np.minimum(upper_bounds(on_left[rows, None], least, most, "binary"), 1)
            tiles = np.argsort(-bound.mean(axis=0), kind="stable")
        for tile in tiles:
            lo, hi = cuts[tile : tile + 2]
            flagged = n_flagged is not None and hi <= n_flagged
            mine, sims = rows, {}
            if main:
                need = best.needed(rows, feature_sets, flagged)
                open_ = ~(bound[:, tile] <= need)
                hit, sims[main.name] = _tanimoto(left[main.name][rows[open_]], right[main.name][lo:hi], need[open_])
                mine = rows[open_][hit]
                if not len(mine):
                    continue
            sims |= {b.name: block_similarity(left[b.name][mine], right[b.name][lo:hi], b.family) for b in blocks if b.name not in sims}
            own = same[0][mine, None] == same[1][lo:hi] if same else None
            own = own if own is not None and own.any() else None
            for fs, names in feature_sets.items():
                sim = sum((sims[n] for n in names[1:]), sims[names[0]]) / len(names) if len(names) > 1 else sims[names[0]]
                sim = sim if own is None else np.where(own, -np.inf, sim)
                peak = sim.max(axis=1)
                best.add((fs, "all"), mine, sim, peak)
                if flagged:
                    best.add((fs, "finetune"), mine, sim, peak)


def nearest(
    left: DataFrame,
    right: DataFrame,
    blocks: Sequence[Block],
    feature_sets: Mapping[str, Sequence[str]],
    *,
    k: int = 1,
    id_col: str = "id",
    finetune_col: str | None = None,
    exclude_self: bool = False,
    broadcast_cells: int = BROADCAST_CELLS,
    chunk_cells: int = CHUNK_CELLS,
) -> DataFrame:
    """The k largest similarities of every left row: ``id, feature_set, scope, sim`` (up to k rows each).

    ``finetune_col`` adds the scope "finetune", the best among right rows with that flag. Every distinct
    block is multiplied once, however many feature sets use it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    known = {b.name for b in blocks}
    feature_sets = {fs: list(names) for fs, names in feature_sets.items()}
    if not feature_sets or any(not names or set(names) - known for names in feature_sets.values()):
        raise ValueError("every feature set needs at least one known block")
    if is_empty(right.select(id_col)):
        raise ValueError("the training side has no rows")
    blocks = [b for b in blocks if any(b.name in names for names in feature_sets.values())]
    columns = sorted({b.column for b in blocks})
    require_columns(left, id_col, *columns)
    flag = [F.coalesce(F.col(finetune_col), F.lit(False)).alias("_ft")] if finetune_col else []
    r_rows = _packed(right.select(F.col(id_col).alias("id"), *columns, *flag), blocks)
    if left is right and any(b.family == "binary" for b in blocks):
        # Stored, as both sides need them and fingerprints are costly.
        r_rows = cut_lineage(r_rows)
        # Dealt out, as a scan would pack its small files into few tasks.
        l_rows = r_rows.select("id", *columns).repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    else:
        l_rows = _packed(left.select(F.col(id_col).alias("id"), *columns), blocks)
    scopes = ["all", "finetune"] if finetune_col else ["all"]
    keys = [(fs, s) for fs in feature_sets for s in scopes]
    width, widest = sum(b.cells for b in blocks), max(b.cells for b in blocks)
    schema = T.StructType([
        l_rows.schema["id"], T.StructField("feature_set", T.StringType()),
        T.StructField("scope", T.StringType()), T.StructField("sim", T.DoubleType()),
    ])
    fits = max(1, broadcast_cells // width)
    args = (blocks, feature_sets, keys, k, exclude_self, schema, bool(flag))
    if right.select(id_col).limit(fits + 1).count() <= fits:
        return _by_broadcast_right(l_rows, r_rows, *args)
    if left.select(id_col).limit(fits + 1).count() <= fits:
        part = _by_broadcast_left(l_rows, r_rows, *args)
    elif main := _shared_block(blocks, feature_sets):
        part = _by_pruned_chunks(l_rows, r_rows, *args, max(1, chunk_cells // widest), main)
    else:
        part = _by_chunks(l_rows, r_rows, *args, max(1, chunk_cells // widest))
    order = Window.partitionBy("id", "feature_set", "scope").orderBy(F.desc("sim"))
    return part.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def _share(rows: DataFrame, blocks):
    """A side of checked size as matrices on every executor."""
    pdf, n_flagged = _flagged_first(rows.toPandas())
    return rows.sparkSession.sparkContext.broadcast((pdf["id"], _mats(pdf, blocks), n_flagged))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of few files, which may arrive in one task, dealt out for work that is far larger than they are."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= tasks else rows.repartition(tasks)


def _by_broadcast_right(l_rows, r_rows, blocks, feature_sets, keys, k, exclude_self, schema, scoped) -> DataFrame:
    """Right side on every executor: each left row sees all candidates at once; only left rows are dealt out."""
    shared = _share(r_rows, blocks)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mats, n_flagged = shared.value
        for batch in it:
            best = _Best(len(batch), k, keys)
            _score(best, _mats(batch, blocks), mats, blocks, feature_sets, n_flagged, _codes(batch["id"], ids) if exclude_self else None)
            yield from best.rows(batch["id"])

    return _dealt(l_rows).mapInPandas(run, schema)


def _by_broadcast_left(l_rows, r_rows, blocks, feature_sets, keys, k, exclude_self, schema, scoped) -> DataFrame:
    """Left side on every executor; the right side is read once, its rows dealt out where they come in few files."""
    shared = _share(l_rows, blocks)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mats, _ = shared.value
        best = _Best(len(ids), k, keys)
        for batch in it:
            part, n_flagged = _flagged_first(batch)
            _score(best, mats, _mats(part, blocks), blocks, feature_sets, n_flagged, _codes(ids, part["id"]) if exclude_self else None)
        yield from best.rows(ids)

    return _dealt(r_rows).mapInPandas(run, schema)


def _by_chunks(l_rows, r_rows, blocks, feature_sets, keys, k, exclude_self, schema, scoped, chunk_rows) -> DataFrame:
    """Both sides in hash chunks of about ``chunk_rows`` rows; each chunk pair is one task's work."""
    n_l = max(1, math.ceil(l_rows.count() / chunk_rows))
    n_r = max(1, math.ceil(r_rows.count() / chunk_rows))
    chunk = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lx = l_rows.withColumn("_lc", chunk(n_l, 1)).withColumn("_rc", every(n_r))
    rx = r_rows.withColumn("_rc", chunk(n_r, 2)).withColumn("_lc", every(n_l))
    return _multiply(lx, rx, blocks, feature_sets, keys, k, exclude_self, schema, scoped)


def _multiply(lx, rx, blocks, feature_sets, keys, k, exclude_self, schema, scoped, bounds=None) -> DataFrame:
    """One bounded block product per (_lc, _rc).

    With ``bounds`` the right rows have a region ``_r``, and a left row meets those regions of the block alone that
    it asks for: those of ``_home``, or with a ``_ratio`` all others whose bound reaches it.
    """

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        rp, n_flagged = _flagged_first(rp, *(["_r"] if bounds else []))
        left, right, best = _mats(lp, blocks), _mats(rp, blocks), _Best(len(lp), k, keys)
        same = _codes(lp["id"], rp["id"]) if exclude_self else None
        if bounds is None:
            _score(best, left, right, blocks, feature_sets, n_flagged, same)
        else:
            regions, starts = np.unique(rp["_r"].to_numpy(), return_index=True)
            open_ = _wanted(lp, regions, *bounds)
            for r, lo, hi in zip(range(len(regions)), starts, [*starts[1:], len(rp)]):
                part = {name: m[lo:hi] for name, m in right.items()}
                flagged = int(rp["_ft"].iloc[lo:hi].sum()) if scoped else None
                _score(best, left, part, blocks, feature_sets, flagged, (same[0], same[1][lo:hi]) if same else None, np.flatnonzero(open_[:, r]))
        return pd.concat(best.rows(lp["id"]), ignore_index=True)

    # Both sides may come from one table; fresh column identities keep the pairing unambiguous.
    lx, rx = lx.toDF(*lx.columns), rx.toDF(*rx.columns)
    return lx.groupBy("_lc", "_rc").cogroup(rx.groupBy("_lc", "_rc")).applyInPandas(run, schema)


def _wanted(lp: pd.DataFrame, regions: np.ndarray, lo: np.ndarray, hi: np.ndarray, family: str) -> np.ndarray:
    """Which of the regions (columns) each left row asks for."""
    home = (np.stack(lp["_home"].tolist())[:, :, None] == regions).any(axis=1)
    if "_ratio" not in lp:
        return home
    at, ratio = np.stack(lp["_where"].tolist()), lp["_ratio"].to_numpy()[:, None]
    step = max(1, CHUNK_CELLS // len(regions))
    reach = [upper_bounds(at[i : i + step], lo[regions], hi[regions], family) >= ratio[i : i + step] for i in range(0, len(at), step)]
    return np.concatenate(reach) & ~home


def _shared_block(blocks, feature_sets) -> Block | None:
    """A block that every feature set uses, fingerprints first."""
    shared = [b for b in blocks if all(b.name in names for names in feature_sets.values())]
    return next((b for b in shared if b.family == "binary"), shared[0] if shared else None)


def choose_pivots(m: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of unit length that lie far from each other: each next one is the farthest from those before."""
    m = m[np.linalg.norm(m, axis=1) > 0]
    if not len(m):
        return np.zeros((1, m.shape[1]))
    at, nearest_to = [0], m @ m[0]
    while len(at) < n and nearest_to.min() < 1 - 1e-9:
        at.append(int(nearest_to.argmin()))
        nearest_to = np.maximum(nearest_to, m @ m[at[-1]])
    return m[at]


def upper_bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, family: str) -> np.ndarray:
    """The largest similarity that a row with coordinates ``x`` (rows x coordinates) may have inside each box ``lo`` to ``hi``.

    On-bit counts: Tanimoto never exceeds the smaller count over the larger one. Angles to pivots: two
    vectors are at least as far apart as their angles to any pivot differ. Rounding is given a little room.
    """
    if family == "binary":
        y = np.clip(x[:, :1], lo[:, 0], hi[:, 0])
        most = np.maximum(x[:, :1], y)
        return np.divide(np.minimum(x[:, :1], y), most, out=np.zeros_like(y), where=most > 0) + 1e-9
    gap = np.zeros((len(x), len(lo)))
    for p in range(x.shape[1]):
        np.maximum(gap, lo[:, p] - x[:, p, None], out=gap)
        np.maximum(gap, x[:, p, None] - hi[:, p], out=gap)
    return np.cos(np.maximum(gap - 1e-6, 0)) + 1e-9


def _placed(rows: DataFrame, main: Block, pivots: np.ndarray | None) -> DataFrame:
    """Add ``_where``, the coordinates of a row, and ``_cell``, the pivot that it is nearest to."""

    @F.pandas_udf("cell int, at array<double>")
    def place(v: pd.Series) -> pd.DataFrame:
        m = _matrix(v.tolist(), main)
        at = np.bitwise_count(m).sum(axis=1, dtype=np.float64)[:, None] if pivots is None else np.arccos(np.clip(m @ pivots.T, -1, 1))
        return pd.DataFrame({"cell": at.argmin(axis=1).astype("int32"), "at": list(at)})

    return rows.withColumn("_p", place(main.column)).select(*rows.columns, F.col("_p.at").alias("_where"), F.col("_p.cell").alias("_cell"))


def _chunked(rows: DataFrame, chunk_rows: int, name: str) -> DataFrame:
    """Chunks of equal size of neighbouring rows: by cell, then by the distance to its pivot."""
    order = ["_cell", F.get("_where", F.col("_cell")), F.xxhash64("id"), "id"]
    return global_index(rows, order, "_i").withColumn(name, F.floor(F.col("_i") / chunk_rows).cast("int")).drop("_i", "_cell")


def _by_pruned_chunks(l_rows, r_rows, blocks, feature_sets, keys, k, exclude_self, schema, scoped, chunk_rows, main) -> DataFrame:
    """Exact, in two rounds. Every left row meets its two most promising regions of chunks first; the k-th best
    value found there bounds which others can still matter, and only these see the row: one lonely row does not open
    all chunks to its neighbours. Rows travel to blocks of regions, as many as tasks of ``CHUNK_CELLS`` need and ``MIN_BLOCKS`` at
    least. At most ``REGIONS`` boxes (or one for each block) and ``PIVOT_ROWS`` sample rows pass the driver."""
    pivots = None
    if main.family == "dense":
        sample = r_rows.select("id", main.column).orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).select(main.column).toPandas()
        pivots = choose_pivots(_matrix(sample[main.column].tolist(), main), PIVOTS)
    # Stored, as putting rows in order reads them twice and their features may be costly.
    lx = _chunked(cut_lineage(_placed(l_rows, main, pivots)), chunk_rows, "_lc")
    rx = _chunked(cut_lineage(_placed(r_rows, main, pivots)), chunk_rows, "_rc")
    n_left, n_chunks = (d.agg(F.max(c)).first()[0] for d, c in ((lx, "_lc"), (rx, "_rc")))
    n_left, n_chunks = -1 if n_left is None else n_left, n_chunks + 1
    n_at = 1 if pivots is None else len(pivots)
    full = max(chunk_rows, CHUNK_CELLS // max(b.cells for b in blocks))
    n_blocks = lambda n: min(n, max(MIN_BLOCKS, math.ceil(n * chunk_rows / full)))
    n_lb, n_rb = max(1, n_blocks(n_left + 1)), n_blocks(n_chunks)
    n_regions = max(n_rb, min(REGIONS, n_chunks))
    run_of = lambda c, n, of: F.floor(F.col(c) * n / of).cast("int")
    rx = rx.withColumn("_r", run_of("_rc", n_regions, n_chunks)).withColumn("_rc", run_of("_r", n_rb, n_regions))
    ends = [f(F.get("_where", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(n_at)]
    boxes = rx.groupBy("_r").agg(*ends).orderBy("_r").collect()
    lo, hi = (np.array([[b[f"{name}{i}"] for i in range(n_at)] for b in boxes]) for name in ("lo", "hi"))
    rx, family = rx.drop("_where"), main.family
    block_of = np.arange(n_regions) * n_rb // n_regions

    def bounded(at: pd.Series) -> Iterator[np.ndarray]:
        step = max(1, CHUNK_CELLS // len(lo))
        for i in range(0, len(at), step):
            yield upper_bounds(np.stack(at.iloc[i : i + step].tolist()), lo, hi, family)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def homes(at: pd.Series) -> pd.Series:
        """The two best regions."""
        return pd.Series([h for best in bounded(at) for h in np.argsort(-best, axis=1, kind="stable")[:, :2].astype("int32")], dtype=object)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def others(at: pd.Series, home: pd.Series, ratio: pd.Series) -> pd.Series:
        """The blocks of all other regions that reach the row's ratio."""
        found, done = [], 0
        for best in bounded(at):
            rows = slice(done, done + len(best))
            open_ = best >= ratio.iloc[rows].to_numpy()[:, None]
            np.put_along_axis(open_, np.stack(home.iloc[rows].tolist()).astype(int), False, axis=1)
            held = np.logical_or.reduceat(open_, np.searchsorted(block_of, np.arange(n_rb)), axis=1)
            found += [np.flatnonzero(h).astype("int32") for h in held]
            done += len(best)
        return pd.Series(found, dtype=object)

    args = (blocks, feature_sets, keys, k, exclude_self, schema, scoped, (lo, hi, family))
    lx = cut_lineage(lx.withColumn("_lc", run_of("_lc", n_lb, n_left + 1 or 1)).withColumn("_home", homes("_where")))
    asked = lx.withColumn("_rc", F.explode(F.array_distinct(F.transform("_home", lambda r: F.floor(r * n_rb / n_regions).cast("int"))))).drop("_where")
    pairs = broadcast_if_small(asked.select("_lc", "_rc").distinct())
    first = cut_lineage(_multiply(asked, rx.join(pairs, "_rc"), *args))
    order = Window.partitionBy("id", "feature_set", "scope").orderBy(F.desc("sim"))
    kept = first.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    per_key = kept.groupBy("id", "feature_set", "scope").agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_kth"))
    # The mean over B blocks can reach f only if the shared block's share reaches B f - (B - 1).
    n_blocks = F.lit(1)
    for fs, names in feature_sets.items():
        n_blocks = F.when(F.col("feature_set") == fs, F.lit(len(names))).otherwise(n_blocks)
    need = F.when(F.col("_n") >= k, n_blocks * F.col("_kth") - (n_blocks - 1)).otherwise(F.lit(-2.0))
    per_row = per_key.groupBy("id").agg(F.count(F.lit(1)).alias("_keys"), F.min(need).alias("_need"))
    per_row = per_row.select(F.col("id").alias("_id"), F.when(F.col("_keys") == len(keys), F.col("_need")).otherwise(F.lit(-2.0)).alias("_ratio"))
    asked = lx.join(per_row, lx["id"] == per_row["_id"], "left").drop("_id").withColumn("_ratio", F.coalesce("_ratio", F.lit(-2.0)))
    asked = cut_lineage(asked.withColumn("_rc", F.explode(others("_where", "_home", "_ratio"))))
    if is_empty(asked):
        return first
    more = broadcast_if_small(asked.select("_lc", "_rc").distinct())
    return first.unionByName(_multiply(asked, rx.join(more, "_rc"), *args))


def summarize_top(top: DataFrame) -> DataFrame:
    """Per left row: the maximum and the mean of the kept values (fewer than k when the right side is short)."""
    return top.groupBy("id", "feature_set", "scope").agg(F.max("sim").alias("max_sim"), F.avg("sim").alias("mean_topk"))


def train_neighbours(
    train: DataFrame,
    blocks: Sequence[Block],
    feature_sets: Mapping[str, Sequence[str]],
    *,
    id_col: str = "id",
    finetune_col: str | None = None,
    **sizes,
) -> DataFrame:
    """Similarity of each training row to its nearest other row: ``id, feature_set, scope, nn_sim``.

    Self is excluded by row, so duplicates find each other at 1.0. Combined feature sets average each
    block's own maximum (the test side instead takes the maximum of the block mean). A lone row counts
    as 1.0. The finetune scope holds flagged rows among themselves.
    """
    single = {n: [n] for names in feature_sets.values() for n in names}
    best = nearest(train, train, blocks, single, k=1, id_col=id_col, finetune_col=finetune_col, exclude_self=True, **sizes)
    member = F.array(*[
        F.struct(F.lit(fs).alias("fs"), F.lit(n).alias("block")) for fs, names in feature_sets.items() for n in names
    ])
    who = train.select(F.col(id_col).alias("id"), F.lit("all").alias("scope"))
    if finetune_col:
        who = who.unionByName(train.filter(F.col(finetune_col)).select(F.col(id_col).alias("id"), F.lit("finetune").alias("scope")))
    expected = who.select("id", "scope", F.inline(member))
    found = best.select(F.col("id"), "scope", F.col("feature_set").alias("block"), "sim")
    return (
        expected.join(found, ["id", "scope", "block"], "left")
        .groupBy("id", F.col("fs").alias("feature_set"), "scope")
        .agg(F.avg(F.coalesce("sim", F.lit(1.0))).alias("nn_sim"))
    )
