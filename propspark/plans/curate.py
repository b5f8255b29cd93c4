"""From raw assay records to training sets: harvest, prepare per source, combine, cut."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.functions.scalars import from_log10, scale_where, structure_status, to_bool
from propspark.functions.text import contains_all, contains_any
from propspark.operators.lookups import having_match, last_written, lookup
from propspark.operators.rows import complete_rows, exact_values, exclude_values, union_all, unscaled_rows, with_value_and_id
from propspark.sources.tables import require_columns

# Terms that find candidate assays, and the words a candidate's description must hold.
CANDIDATE_TERMS = ("human liver microsom", "human liver microsomal", "hlm")
REQUIRED_WORDS = ("human", "liver", "microsom")
CANONICAL_COLUMNS = (
    "mol_id", "SMILES", "hlm_value_unscaled", "hlm_value_unscaled_log1p",
    "hlm_value_scaled", "hlm_value_scaled_log1p", "dataset", "scaling_was_applied",
)


def candidate_assays(
    assays: DataFrame, *, id_col: str = "assay_id", description_col: str = "description", order_cols: Iterable[str],
    terms: Iterable[str] = CANDIDATE_TERMS, words: Iterable[str] = REQUIRED_WORDS,
) -> DataFrame:
    """Assays found by any term whose description holds every word; the last written row per id counts."""
    d = F.col(description_col)
    return last_written(assays.filter(contains_any(d, terms) & contains_all(d, words)), id_col, order_cols)


@dataclass(frozen=True)
class HarvestColumns:
    """Names of the columns in the four raw tables."""

    assay_id: str = "assay_id"
    molecule_id: str = "molecule_id"
    target_id: str = "target_id"
    kind: str = "standard_type"
    value: str = "standard_value"
    relation: str = "standard_relation"
    structure: str = "smiles"
    target_name: str = "target_name"


def harvest(
    activities: DataFrame, assays: DataFrame, molecules: DataFrame, targets: DataFrame, *,
    kind: str, cols: HarvestColumns = HarvestColumns(), assay_cols: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact measurements of the candidate assays with structure, target name and structure status.

    ``assays``, ``molecules`` and ``targets`` hold one row per id. One lazy plan, no per-batch requests.
    """
    kept = activities.filter(F.col(cols.kind) == kind)
    kept = exact_values(with_value_and_id(kept, cols.value, cols.molecule_id), cols.relation)
    if assay_cols:
        rows = lookup(kept, assays, cols.assay_id, cols.assay_id, dict(assay_cols), how="inner")
    else:
        rows = having_match(kept, assays, cols.assay_id, cols.assay_id)
    rows = lookup(rows, molecules, cols.molecule_id, cols.molecule_id, {cols.structure: cols.structure}, hit="_returned")
    rows = lookup(rows, targets, cols.target_id, cols.target_id, {cols.target_name: cols.target_name})
    return rows.withColumn("structure_status", structure_status("_returned", cols.structure)).drop("_returned")


@dataclass(frozen=True)
class SourceConfig:
    """How one source becomes canonical rows.

    ``scaled_unit`` None with a ``factor`` scales every row; without a factor scaled equals unscaled.
    """

    name: str
    required: tuple[str, ...]
    value: str
    is_log10: bool = False
    excluded: tuple[str, tuple] | None = None
    flag_col: str | None = None
    unit_col: str | None = None
    units: tuple[str, ...] = ()
    scaled_unit: str | None = None
    factor: float | None = None
    year: str | None = None
    renames: Mapping[str, str] = field(default_factory=dict)


def prepare_source(df: DataFrame, cfg: SourceConfig) -> DataFrame:
    """Complete rows, quality and unit filters, linear value, scaled value, log1p of both, provenance."""
    extra = [c for c in (cfg.unit_col, cfg.flag_col) if c]
    require_columns(df, *cfg.required, *extra)
    if cfg.flag_col:
        df = df.filter(F.col(cfg.flag_col).isNull())
    if cfg.unit_col and cfg.units:
        df = df.filter(F.col(cfg.unit_col).isin(*cfg.units))
    keep_unit = [cfg.unit_col] if cfg.unit_col and cfg.unit_col not in cfg.required else []
    out = complete_rows(df, [*cfg.required, *keep_unit])
    if cfg.excluded:
        out = exclude_values(out, cfg.excluded[0], cfg.excluded[1], value_col=cfg.value)
    raw: Column = from_log10(cfg.value) if cfg.is_log10 else F.col(cfg.value).cast("double")
    if cfg.factor is None:
        scaled = raw
    elif cfg.scaled_unit is None:
        scaled = raw * F.lit(float(cfg.factor))
    else:
        scaled = scale_where(raw, cfg.unit_col, cfg.scaled_unit, cfg.factor)
    out = out.withColumns({"hlm_value_unscaled": raw, "hlm_value_scaled": scaled})
    out = out.withColumns({
        "hlm_value_unscaled_log1p": F.log1p("hlm_value_unscaled"),
        "hlm_value_scaled_log1p": F.log1p("hlm_value_scaled"),
        "dataset": F.lit(cfg.name),
    })
    if cfg.year:
        out = out.withColumn("data_year", F.lit(cfg.year))
    return out.withColumnsRenamed({k: v for k, v in cfg.renames.items() if k in out.columns})


def combine(sources: Iterable[DataFrame], *, columns: Iterable[str] | None = CANONICAL_COLUMNS) -> DataFrame:
    """Union of prepared sources; the scaling flag becomes a real boolean. ``columns=None`` keeps all."""
    flagged = [s.withColumn("scaling_was_applied", to_bool("scaling_was_applied")) for s in sources]
    out = union_all(flagged)
    return out if columns is None else out.select(*columns)


def training_sets(sources: Mapping[str, DataFrame], *, single: str, predicted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The training sets cut from the combined table, as views of one plan.

    ``all``, ``no_scaling`` (unscaled rows), ``single`` (one source) and, given a large predicted source,
    ``all_predicted``: that source below the unprojected union, so every source column survives.
    """
    everything = combine(sources.values(), columns=None)
    table = everything.select(*CANONICAL_COLUMNS)
    out = {"all": table, "no_scaling": unscaled_rows(table), "single": table.filter(F.col("dataset") == single)}
    if predicted is not None:
        flagged = predicted.withColumn("scaling_was_applied", to_bool("scaling_was_applied"))
        out["all_predicted"] = union_all([everything, flagged])
    return out
