"""Multi-axis scores under weight profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sequences import positional_identity
from winnow.functions.windows import window_load


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] = K.CATALOG_ALIASES) -> DataFrame:
    """Rename an alias unless its target is already there."""
    present = set(df.columns)
    renames = {old: new for old, new in aliases.items() if old in present and new not in present}
    return df.withColumnsRenamed(renames) if renames else df


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of the names the frame has; decided while the plan is built."""
    present = set(df.columns)
    return next((n for n in names if n in present), None)


def weighted_score(df: DataFrame, profile: Mapping[str, float] = K.PROFILE_V010, score_col: str = "score") -> DataFrame:
    return df.withColumn(score_col, S.weighted(profile))


def with_beats(df: DataFrame, score_col: str = "score", threshold: float = K.LOCKPOINT_VERBATIM) -> DataFrame:
    return df.withColumn("beats_lockpoint", S.beats(score_col, threshold))


def rescore(
    df: DataFrame,
    id_col: str = "design_id",
    keep: Sequence[str] = ("strategy", "parent_editor"),
    old: Mapping[str, float] = K.PROFILE_V010,
    new: Mapping[str, float] = K.PROFILE_V012,
    old_threshold: float = K.LOCKPOINT_VERBATIM,
    new_threshold: float = K.LOCKPOINT_V012,
    version: str = "0.1.2",
    profile: str = K.USE_CASE,
) -> DataFrame:
    """Both profiles side by side. Flags compare unrounded scores; a missing axis column takes its default."""
    present = set(df.columns)
    added = set(new) - set(old)

    def axis(name: str) -> Column:
        if name in added or name not in present:
            return F.lit(K.RESCORE_DEFAULTS[name])
        return F.col(name).cast("double")

    before = S.weighted(old, {a: axis(a) for a in old})
    after = S.weighted(new, {a: axis(a) for a in new})
    raw = df.select(
        F.col(id_col),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in present else F.lit("").alias(c) for c in keep],
        *[axis(a).alias(f"{a}_v010") for a in old],
        *[axis(a).alias(f"{a}_v012") for a in new],
        before.alias("raw_old"),
        after.alias("raw_new"),
    ).withColumn("raw_delta", F.col("raw_new") - F.col("raw_old"))
    return raw.select(
        *[c for c in raw.columns if not c.startswith("raw_")],
        S.round_column("raw_old", 4).alias("score_v010"),
        S.round_column("raw_new", 4).alias("score_v012"),
        S.round_column("raw_delta", 4).alias("score_delta"),
        (F.col("raw_old") > old_threshold).alias("beats_v010_lockpoint"),
        (F.col("raw_new") > new_threshold).alias("beats_v012_lockpoint"),
        F.lit(version).alias("score_version"),
        F.lit(profile).alias("profile"),
    )


def _axis_rows(profile: Mapping[str, float]) -> Column:
    """Array of (axis, value, weight, contribution): weights are plan literals, so no join is needed."""
    rows = []
    for name, weight in profile.items():
        value = S.number(name)
        rows.append(
            F.struct(
                F.lit(name).alias("axis"),
                value.alias("value"),
                F.lit(float(weight)).alias("weight"),
                (F.coalesce(value, F.lit(0.0)) * F.lit(float(weight))).alias("contribution"),
            )
        )
    return F.array(*rows)


def axis_contributions(df: DataFrame, id_col: str, profile: Mapping[str, float] = K.PROFILE_V010) -> DataFrame:
    return df.select(id_col, F.inline(_axis_rows(profile)))


def contribution_delta(
    df: DataFrame,
    id_col: str,
    old: Mapping[str, float] = K.PROFILE_V010,
    new: Mapping[str, float] = K.PROFILE_V012,
) -> DataFrame:
    """Share of each axis in the score change; the shares of a design add up to its total change."""
    rows = []
    for name in dict.fromkeys([*old, *new]):
        value = F.coalesce(S.number(name), F.lit(0.0)) if name in df.columns else F.lit(K.RESCORE_DEFAULTS[name])
        w_old, w_new = float(old.get(name, 0.0)), float(new.get(name, 0.0))
        rows.append(
            F.struct(
                F.lit(name).alias("axis"),
                F.lit(w_old).alias("weight_old"),
                F.lit(w_new).alias("weight_new"),
                (value * w_new - value * w_old).alias("delta"),
            )
        )
    return df.select(id_col, F.inline(F.array(*rows)))


def score_batch(
    df: DataFrame,
    sequence_col: str = "protein_sequence",
    strategy_col: str = "strategy",
    label_col: str = "tier_a",
    composite_col: str = "composite",
    confidence_col: str = "tier_a_confidence",
    probability_col: str = "composite_prob",
    immuno_col: str = "predicted_s_immuno",
    parent_sequence: str | None = None,
    score_col: str = "score",
    threshold: float = K.LOCKPOINT_VERBATIM,
) -> DataFrame:
    """All axes, score, flag and method. Absent columns take the documented defaults.

    The flag uses the rounded score. The window scan runs only for rows that need the proxy. Filters on the result run
    after the scoring: pushed below it, they would copy each rounded value's expression into the next, and scan again.
    Filter on input columns before.
    """
    present = set(df.columns)

    def given(name: str, default) -> Column:
        return F.col(name) if name in present else F.lit(default)

    label = given(label_col, K.CLASS_FREE)
    composite = given(composite_col, True).cast("boolean")
    confidence = given(confidence_col, 1.0).cast("double")
    probability = given(probability_col, 1.0).cast("double")
    strategy = given(strategy_col, K.STRATEGY_SWAP)
    sequence = F.col(sequence_col)
    measured = S.number(given(immuno_col, None))

    needs_scan = measured.isNull() & ~F.coalesce(strategy == K.STRATEGY_TARGETED, F.lit(False))
    scanned = df.withColumn(
        "_load", window_load(F.when(needs_scan, sequence), positions=False)["weighted_load"]
    )
    if parent_sequence:
        identity = F.when(
            strategy.startswith("C") & (F.length(sequence) > 0), positional_identity(sequence, F.lit(parent_sequence))
        )
    else:
        identity = F.lit(None).cast("double")

    raw = scanned.withColumns(
        {
            "S_DSB": S.score_class(label),
            "S_Spec": S.raw_specificity(confidence, probability).cast("double"),
            "S_Cargo": S.score_cargo(label, composite),
            "S_Deliv": S.score_length(F.length(sequence)),
            "S_Immuno": S.score_immuno(measured, strategy, "_load"),
            "S_Prog": S.raw_programmability(probability, composite).cast("double"),
            "S_Mature": S.score_maturity(strategy, identity),
        }
    )
    # each rounding works on plain columns of the step before, which keeps it in generated code
    proxies = raw.withColumns({a: S.round_column(a, 4) for a in ("S_Spec", "S_Prog")})
    rounded = F.when(F.monotonically_increasing_id() >= 0, S.round_column("_raw", 4))  # holds filters above
    scored = proxies.withColumn("_raw", S.weighted(K.PROFILE_V010)).withColumn(score_col, rounded)
    return scored.withColumns(
        {
            **{a: S.round_column(a, 4) for a in ("S_Deliv", "S_Immuno", "S_Mature")},
            "beats_lockpoint": F.col(score_col) > threshold,
            "score_method": F.lit(K.SCORE_METHOD),
        }
    ).drop("_load", "_raw")


def rename_values(df: DataFrame, column: str, renames: Mapping[str, str] = K.RENAMED_PARENTS) -> DataFrame:
    """Migrate values; unknown values stay."""
    return df.replace(dict(renames), subset=[column])


def count_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """How many rows a migration touches."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def add_evidence_flags(df: DataFrame) -> DataFrame:
    """Constant evidence columns; the invariants behind them are checked by `checks.check_invariants`."""
    return df.withColumns({"intrinsic_cargo_mechanism": F.lit(True), "cell_based_evidence": F.lit(False)})


def migrate_parents(df: DataFrame, id_col: str = "design_id", strategy_col: str = "strategy") -> DataFrame:
    return df.withColumn("parent_editor", S.parent_of(id_col, strategy_col))


def stability_columns(df: DataFrame, options: Sequence[tuple[str, str]], value_col: str = "ddg_kcal_mol") -> DataFrame:
    """Chosen measurement, its method and the three stability flags."""
    value, method = S.choose_measurement(options)
    return df.withColumns({value_col: value, "ddg_method": method}).withColumns(S.stability_flags(value_col))
