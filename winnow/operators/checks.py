"""Hypothesis tests, invariants and data contracts: each is one aggregate pass with a report row per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.operators.aggregates import best_row, distinct_sources
from winnow.operators.gates import beats_predicate, cargo_delivery_predicate
from winnow.operators.joins import calibrated_only
from winnow.operators.neighbours import mean_pairwise_identity
from winnow.operators.ranking import beaters, diverse_top


def verdict(passed: Column, evaluable: Column | None = None) -> Column:
    out = F.when(passed, "PASS").otherwise("FAIL")
    return out if evaluable is None else F.when(~evaluable, "NOT_EVALUABLE").otherwise(out)


# --- hypotheses ------------------------------------------------------------------------------------------------


def hypothesis_count_above(
    df: DataFrame,
    threshold: float = K.LOCKPOINT_VERBATIM,
    secondary: float = K.LOCKPOINT_CALIBRATED,
    minimum: int = 5,
    score_col: str = "score",
) -> DataFrame:
    """H1: rows above the threshold, with a looser secondary threshold."""
    n1 = F.count_if(beats_predicate(score_col, threshold))
    n2 = F.count_if(beats_predicate(score_col, secondary))
    return df.agg(n1.alias("n_beating"), n2.alias("n_beating_calibrated")).select(
        F.lit("H1").alias("test_id"),
        verdict(F.col("n_beating") >= minimum).alias("verdict"),
        "n_beating",
        "n_beating_calibrated",
        verdict(F.col("n_beating_calibrated") >= minimum).alias("verdict_calibrated"),
    )


def beaters_calibrated_only(
    df: DataFrame,
    threshold: float = K.LOCKPOINT_VERBATIM,
    secondary: float = K.LOCKPOINT_CALIBRATED,
    score_col: str = "score",
    id_col: str = "design_id",
) -> DataFrame:
    """Rows that only the looser threshold accepts."""
    return calibrated_only(
        beaters(df, secondary, score_col, id_col), beaters(df, threshold, score_col, id_col), id_col
    )


def hypothesis_existence(
    df: DataFrame, cargo_col: str = "S_Cargo", delivery_col: str = "S_Deliv", minimum: int = 1
) -> DataFrame:
    """H2: at least one row meets the joint predicate."""
    joint = cargo_delivery_predicate(cargo_col, delivery_col)
    return df.agg(F.count_if(joint).alias("n_satisfying")).select(
        F.lit("H2").alias("test_id"), verdict(F.col("n_satisfying") >= minimum).alias("verdict"), "n_satisfying"
    )


def hypothesis_best_gain(
    df: DataFrame,
    stratum: str = "C",
    baseline: float = K.BASELINE_IMMUNO,
    secondary: float = K.BASELINE_IMMUNO_REMEASURED,
    minimum: float = 0.10,
    value_col: str = "S_Immuno",
    stratum_col: str = "strategy",
    id_col: str = "design_id",
) -> DataFrame:
    """H3: best value of a stratum against the baseline; an empty stratum cannot be evaluated."""
    part = df.filter(F.col(stratum_col) == stratum)
    best = best_row(part, [], value_col, id_col, [value_col, id_col])
    gain = F.col(value_col) - baseline
    return best.select(
        F.lit("H3").alias("test_id"),
        verdict(gain >= minimum, F.col(value_col).isNotNull()).alias("verdict"),
        F.col(id_col).alias("best_design"),
        F.col(value_col).alias("best_value"),
        S.round_exact(gain, 4).alias("delta"),
        S.round_exact(F.col(value_col) - secondary, 4).alias("delta_secondary"),
    )


def passes_gain(delta: str | Column, minimum: float = 0.10) -> Column:
    """Row form of H3: NULL when no gain is known."""
    return S.number(delta) >= minimum


def hypothesis_survivors(
    df: DataFrame,
    stratum: str = "B",
    minimum: int = 10,
    stratum_col: str = "strategy",
    length_col: str = "protein_length_aa",
    genus_col: str = "genus",
    score_col: str = "score",
) -> DataFrame:
    """H4: survivors of a stratum, with their length, genus and score statistics."""
    part = df.filter(F.col(stratum_col) == stratum)
    one = part.agg(
        F.count(F.lit(1)).alias("n_survivors"),
        F.min(length_col).alias("length_min"),
        F.max(length_col).alias("length_max"),
        S.round_exact(F.avg(length_col), 1).alias("length_mean"),
        F.count_distinct(genus_col).alias("n_genera"),
        S.round_exact(F.min(S.number(score_col)), 4).alias("score_min"),
        S.round_exact(F.max(S.number(score_col)), 4).alias("score_max"),
    )
    return one.select(
        F.lit("H4").alias("test_id"), verdict(F.col("n_survivors") >= minimum).alias("verdict"), *one.columns
    )


def hypothesis_diversity(
    df: DataFrame,
    k: int = 5,
    minimum: int = 3,
    score_col: str = "score",
    stratum_col: str = "strategy",
    id_col: str = "design_id",
    sequence_col: str | None = "protein_sequence",
    enforce: bool = True,
) -> DataFrame:
    """H5: distinct strata among the top rows, and their mean pairwise identity."""
    if enforce:
        top = diverse_top(df, k, minimum, score_col, stratum_col, id_col)
    else:
        top = (
            df.orderBy(F.desc_nulls_last(score_col), F.asc(id_col)).limit(k).withColumn("diversity_enforced", F.lit(False))
        )
    sources = distinct_sources(top, stratum_col, minimum).select("n_distinct", "sources")
    enforced = top.agg(F.coalesce(F.bool_or("diversity_enforced"), F.lit(False)).alias("diversity_enforced"))
    frames = [sources, enforced]
    if sequence_col:
        frames.append(mean_pairwise_identity(top, sequence_col).select("mean_identity"))
    # one-row frames, joined on a constant
    out = frames[0].withColumn("_k", F.lit(1))
    for frame in frames[1:]:
        out = out.join(F.broadcast(frame.withColumn("_k", F.lit(1))), "_k")
    return out.select(
        F.lit("H5").alias("test_id"),
        verdict(F.col("n_distinct") >= minimum).alias("verdict"),
        *[c for c in out.columns if c != "_k"],
    )


def hypothesis_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.HYPOTHESES), "id string, statement string, threshold string")


def rollup_verdicts(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Counts by verdict and the policy text, tested in the published order; a missing result is NOT_RUN."""
    found = registry.select(F.col("id").alias("test_id")).join(results.select("test_id", "verdict"), "test_id", "left")
    v = F.coalesce("verdict", F.lit("NOT_RUN"))
    counts = found.agg(
        F.count_if(v == "PASS").alias("n_pass"),
        F.count_if(v == "FAIL").alias("n_fail"),
        F.count_if(v.isin("NOT_EVALUABLE", "NOT_RUN")).alias("n_not_evaluable"),
    )
    evaluated = F.col("n_pass") + F.col("n_fail")
    text = K.ROLLUP_TEXT
    policy = (
        F.when(F.col("n_pass") == 5, text["all"])
        .when((F.col("n_pass") == 4) & (evaluated == 4) & (F.col("n_not_evaluable") == 1), text["four_evaluated"])
        .when((F.col("n_pass") == 4) & (F.col("n_fail") == 1), text["four"])
        .when(F.col("n_pass") == 3, text["three"])
        .otherwise(text["rework"])
    )
    return counts.withColumn("policy", policy)


# --- invariants and contracts ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A named check: an aggregate counted over the table and the value it must have."""

    name: str
    observed: Column
    expected: int


def row_count(n: int) -> Check:
    return Check("row_count", F.count(F.lit(1)), n)


def all_true(column: str) -> Check:
    return Check(f"all_true({column})", F.count_if(~F.coalesce(F.col(column), F.lit(False))), 0)


def all_false(column: str) -> Check:
    return Check(f"all_false({column})", F.count_if(F.coalesce(F.col(column), F.lit(True))), 0)


def forbidden(column: str, values: Sequence) -> Check:
    return Check(f"forbidden({column})", F.count_if(F.col(column).isin(*values)), 0)


def allowed(column: str, values: Sequence) -> Check:
    return Check(f"allowed({column})", F.count_if(~F.coalesce(F.col(column).isin(*values), F.lit(False))), 0)


def in_range(column: str, low: float = 0.0, high: float = 1.0) -> Check:
    outside = ~F.coalesce(S.number(column).between(low, high), F.lit(True))
    return Check(f"in_range({column})", F.count_if(outside), 0)


def no_nulls(column: str) -> Check:
    return Check(f"no_nulls({column})", F.count_if(F.col(column).isNull()), 0)


def count_where(name: str, predicate: Column, n: int) -> Check:
    return Check(name, F.count_if(predicate), n)


def run_checks(
    df: DataFrame,
    checks: Sequence[Check],
    required: Sequence[str] = (),
    column_count: int | None = None,
) -> DataFrame:
    """Report of (check, observed, expected, passed). Schema checks need no data, the rest take one pass."""
    missing = [c for c in required if c not in df.columns]
    fixed = [("required_columns", len(missing), 0)] if required else []
    if column_count is not None:
        fixed.append(("column_count", len(df.columns), column_count))
    row = df.agg(*[c.observed.cast("long").alias(f"c{i}") for i, c in enumerate(checks)]) if checks else None

    def entry(name: str, observed: Column, expected: int) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            observed.cast("long").alias("observed"),
            F.lit(expected).cast("long").alias("expected"),
            (observed == expected).alias("passed"),
        )

    entries = [entry(n, F.lit(o), e) for n, o, e in fixed]
    entries += [entry(c.name, F.col(f"c{i}"), c.expected) for i, c in enumerate(checks)]
    base = row if row is not None else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*entries)))


def check_invariants(df: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """Invariants of an upgraded catalog."""
    checks = [row_count(rows)] if rows is not None else []
    checks += [
        all_true("intrinsic_cargo_mechanism"),
        all_false("cell_based_evidence"),
        forbidden("parent_editor", list(K.RENAMED_PARENTS)),
    ]
    return run_checks(df, checks, column_count=columns)


def check_contract(
    df: DataFrame,
    score_col: str = "score",
    stratum_col: str = "strategy",
    axes: Sequence[str] = K.AXES,
    strata: Sequence[str] = K.STRATEGIES,
    extra: Sequence[Check] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """Contract of a published catalog: columns, ranges, strata, no missing scores."""
    present = [a for a in axes if a in df.columns]
    checks = [
        in_range(score_col),
        *[in_range(a) for a in present],
        allowed(stratum_col, strata),
        no_nulls(score_col),
        *extra,
    ]
    return run_checks(df, checks, required or ["design_id", stratum_col, score_col, *axes])


def profile_table(spark: SparkSession, profiles: Mapping[str, Mapping[str, float]] = K.PROFILES) -> DataFrame:
    rows = [(p, a, float(w)) for p, axes in profiles.items() for a, w in axes.items()]
    return spark.createDataFrame(rows, "profile string, axis string, weight double")


def validate_profiles(profiles: DataFrame, axes: Sequence[str] = K.AXES, tolerance: float = 1e-6) -> DataFrame:
    """Weights add up to one and every axis has one."""
    total = F.sum("weight")
    covered = F.count_distinct(F.when(F.col("axis").isin(*axes), F.col("axis")))
    return profiles.groupBy("profile").agg(
        S.round_exact(total, 6).alias("weight_sum"),
        F.count(F.lit(1)).alias("n_axes"),
        ((F.abs(total - 1.0) < tolerance) & (covered == len(axes))).alias("valid"),
    )
