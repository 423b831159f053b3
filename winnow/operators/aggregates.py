"""Reports and aggregates over candidate tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.operators.numbering import medians, null_safe_join, rank_in_group


def strategy_breakdown(
    df: DataFrame, stratum_col: str = "strategy", score_col: str = "score", threshold: float = K.LOCKPOINT_VERBATIM
) -> DataFrame:
    """Rows, rows above the threshold, best and median score by stratum."""
    score = S.number(score_col)
    also = [F.count(F.lit(1)).alias("n"), F.count_if(score > threshold).alias("n_beating"), F.max(score).alias("best")]
    return medians(df, [stratum_col], score_col, also=also).select(stratum_col, "n", "n_beating", "best", "median")


def delta_by_strategy(df: DataFrame, stratum_col: str = "strategy", delta_col: str = "score_delta") -> DataFrame:
    """Median, mean and count of the score change, by stratum and overall (is_total)."""
    value = S.number(delta_col)
    # every row counts for its stratum and for the total, so both come from the same two passes
    twice = df.select(stratum_col, delta_col, F.explode(F.array(F.lit(False), F.lit(True))).alias("is_total"))
    twice = twice.withColumn(stratum_col, F.when(~F.col("is_total"), F.col(stratum_col)))
    also = [F.avg(value).alias("mean"), F.count(value).alias("count")]
    found = medians(twice, [stratum_col, "is_total"], delta_col, also=also)
    return found.select(stratum_col, "mean", "count", "median", "is_total")


def subset_statistics(
    df: DataFrame,
    length_col: str = "protein_length_aa",
    genus_col: str = "genus",
    score_col: str = "score",
) -> DataFrame:
    """One row: length range, mean and median, distinct genera, score range."""
    also = [
        F.count(F.lit(1)).alias("n"),
        F.min(length_col).alias("length_min"),
        F.max(length_col).alias("length_max"),
        F.avg(length_col).alias("length_mean"),
        F.count_distinct(genus_col).alias("n_genera"),
        F.min(S.number(score_col)).alias("score_min"),
        F.max(S.number(score_col)).alias("score_max"),
    ]
    return medians(df, [], length_col, "length_median", also)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def gate_pass_counts(df: DataFrame, prefix: str = "gate_", excluded: str = "note") -> DataFrame:
    """Passed rows of every gate column, in one pass."""
    gates = [c for c in df.columns if c.startswith(prefix) and c.endswith("_pass") and excluded not in c]
    counts = [F.count_if(F.col(c)).alias(f"p_{c}") for c in gates]
    rows = [
        F.struct(F.lit(c).alias("gate"), F.col(f"p_{c}").alias("n_pass"), F.col("n_rows").alias("n_rows"))
        for c in gates
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts).select(F.inline(F.array(*rows)))


def confidence_statistics(atoms: DataFrame, key: str = "design_id", value_col: str = "b") -> DataFrame:
    """Mean, range and residue-ordered list of the confidence per structure."""
    listed = F.array_sort(F.collect_list(F.struct("res_seq", F.col(value_col).alias("b"))))
    return atoms.groupBy(key).agg(
        F.avg(value_col).alias("mean_plddt"),
        F.min(value_col).alias("min_plddt"),
        F.max(value_col).alias("max_plddt"),
        F.count(value_col).alias("n_residues"),
        F.transform(listed, lambda r: r["b"]).alias("per_residue"),
    )


def confidence_at_positions(
    atoms: DataFrame, positions: DataFrame, key: str = "design_id", value_col: str = "b"
) -> DataFrame:
    """Mean, minimum and number of values found at listed positions; nothing found gives 0, 0, 0.

    positions: key, positions (array<int>). Residues outside the lists are dropped by the join before the group.
    """
    wanted = positions.select(key, F.explode("positions").alias("res_seq"))
    found = (
        atoms.join(wanted, [key, "res_seq"])
        .groupBy(key)
        .agg(
            F.avg(value_col).alias("site_mean"), F.min(value_col).alias("site_min"), F.count(value_col).alias("site_found")
        )
    )
    zero = {"site_mean": 0.0, "site_min": 0.0, "site_found": 0}
    return positions.select(key).join(found, key, "left").na.fill(zero)


def active_site_summary(
    df: DataFrame, stratum_col: str = "strategy", value_col: str = "active_site_plddt", flag_col: str = "pass_active_site"
) -> DataFrame:
    passed = F.count_if(F.col(flag_col))
    return df.groupBy(stratum_col).agg(
        F.count(F.lit(1)).alias("total"),
        passed.alias("n_pass"),
        (F.count(F.lit(1)) - passed).alias("n_fail"),
        F.avg(value_col).alias("mean_value"),
        F.min(value_col).alias("min_value"),
        F.max(value_col).alias("max_value"),
    )


def pass_rate(df: DataFrame, flag_col: str) -> DataFrame:
    passed, total = F.count_if(F.col(flag_col)), F.count(F.lit(1))
    rate = F.when(total > 0, S.round_exact(passed / total, 4)).otherwise(0.0)
    return df.agg(
        total.alias("total"), passed.alias("n_pass"), (total - passed).alias("n_fail"), rate.alias("pass_rate")
    )


def dedupe_first(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """First row of each key by line order, with partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order_col))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def best_row(df: DataFrame, groups: Sequence[str], value_col: str, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Row with the largest value per group; the smallest id wins a tie, NaN and NULL never win."""
    value = S.number(value_col)
    rest = [c for c in columns if c not in (value_col, id_col)]
    # largest value first, then smallest id: a minimum over (-value, id) aggregates map-side
    key = F.when(value.isNotNull(), F.struct((-value).alias("k"), F.col(id_col).alias("i")))
    row = F.struct(value.alias(value_col), F.col(id_col), *rest)
    return df.groupBy(*groups).agg(F.min_by(row, key).alias("_row")).select(*groups, "_row.*")


def distinct_sources(df: DataFrame, source_col: str, min_distinct: int = 3) -> DataFrame:
    """Distinct sources of a bounded top-k frame, NULL counted as one source."""
    if source_col not in df.columns:
        raise KeyError(f"column {source_col!r} not found")
    sources = df.select(source_col).distinct()
    return sources.agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.array_sort(F.collect_list(F.coalesce(F.col(source_col).cast("string"), F.lit("null")))).alias("sources"),
    ).withColumn("passes", F.col("n_distinct") >= min_distinct)


def epitopes_removed(
    df: DataFrame,
    n1_col: str = "n1",
    n2_col: str = "n2",
    baseline1: int = K.BASELINE_LOAD_CLASS_1,
    baseline2: int = K.BASELINE_LOAD_CLASS_2,
) -> DataFrame:
    """Windows removed against the baseline counts, never negative."""
    return df.withColumns(
        {
            "n_mhc_i_epitopes_removed": F.greatest(F.lit(0), F.lit(baseline1) - F.col(n1_col)),
            "n_mhc_ii_epitopes_removed": F.greatest(F.lit(0), F.lit(baseline2) - F.col(n2_col)),
        }
    )


def fallback_rows(df: DataFrame, flag_col: str = "rna_fallback") -> DataFrame:
    return df.filter(F.coalesce(F.col(flag_col), F.lit(False)))


def binder_load(binders: DataFrame, key: str = "design_id", weight: float = 0.5) -> DataFrame:
    """Distinct start positions by class under their rank rules, and the weighted load."""
    strong1 = (F.col("class") == "I") & (F.col("rank_el") < K.RANK_CLASS_1)
    strong2 = (F.col("class") == "II") & (F.col("rank_el") <= K.RANK_CLASS_2)
    starts = binders.filter(strong1 | strong2).select(key, "class", "pos").distinct()
    counts = starts.groupBy(key).agg(
        F.count_if(F.col("class") == "I").cast("int").alias("n1"),
        F.count_if(F.col("class") == "II").cast("int").alias("n2"),
    )
    everyone = binders.select(key).distinct()
    return (
        everyone.join(counts, key, "left")
        .na.fill({"n1": 0, "n2": 0})
        .withColumn("weighted_load", F.col("n1") + F.col("n2") * weight)
    )


# --- uncertainty and what-if reports ---------------------------------------------------------------------------


def hash_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from a digest of the parts: the same for any partitioning or engine."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / float(2**48)


# the uniform behind the radius is at least half of 2 ** -48
NOISE_BOUND = math.sqrt(2 * 49 * math.log(2))


def hash_normal(*parts: Column) -> Column:
    u1, u2 = hash_uniform(*parts, F.lit("u")), hash_uniform(*parts, F.lit("v"))
    return F.sqrt(F.log(u1) * -2.0) * F.cos(u2 * 6.283185307179586)


def noisy_scores(
    df: DataFrame, id_col: str, score_col: str, iterations: int, sigma: float, seed: int
) -> DataFrame:
    """One noisy copy of every score per iteration."""
    # copies are made where the rows are, so the narrow input is dealt over all cores first
    dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism, id_col)
    copies = dealt.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    noise = hash_normal(F.col(id_col).cast("string"), F.col("iteration").cast("string"), F.lit(str(seed)))
    return copies.withColumn("noisy_score", S.number(score_col) + noise * sigma)


def rank_intervals(
    df: DataFrame,
    id_col: str = "design_id",
    score_col: str = "score",
    iterations: int = K.RESAMPLING["iterations"],
    sigma: float = K.RESAMPLING["sigma"],
    seed: int = K.RESAMPLING["seed"],
    level: float = 0.95,
) -> DataFrame:
    """Rank interval of each design over noisy re-rankings.

    The copies hold id, iteration and score only and are ranked over range partitions, whatever their number.
    """
    noisy = noisy_scores(df.select(id_col, score_col), id_col, score_col, iterations, sigma, seed)
    ranked = rank_in_group(
        noisy.select(id_col, "iteration", "noisy_score"),
        ["iteration"],
        [F.desc_nulls_last("noisy_score"), F.asc(id_col)],
    )
    tail = (1.0 - level) / 2.0
    return ranked.groupBy(id_col).agg(
        F.expr(f"percentile(rank, array({tail}D, {1.0 - tail}D))").alias("_p"), F.avg("rank").alias("rank_mean")
    ).select(id_col, F.col("_p")[0].alias("rank_low"), F.col("_p")[1].alias("rank_high"), "rank_mean")


def top_presence(
    df: DataFrame,
    id_col: str = "design_id",
    score_col: str = "score",
    stratum_col: str = "strategy",
    iterations: int = K.RESAMPLING["iterations"],
    sigma: float = K.RESAMPLING["sigma"],
    seed: int = K.RESAMPLING["seed"],
    top: int = K.RESAMPLING["top"],
) -> DataFrame:
    """Share of noisy re-rankings with the stratum in the top.

    The noise is bounded (`NOISE_BOUND` sigmas, by the digits it is made of), so a row that lies more than twice the bound
    below the last of the best `top` scores is below all of these in every iteration: it is dropped before any copy is
    made. Copies of the others are cut to the top in the tasks, before the shuffle.
    """
    score = S.number(score_col)
    narrow = df.select(id_col, score_col, stratum_col)
    best = narrow.select(score.alias("_s")).orderBy(F.desc_nulls_last("_s")).limit(top).agg(F.min("_s").alias("_last"), F.count("_s").alias("_n"))
    floor = best.select(F.when(F.col("_n") >= top, F.col("_last") - 2 * NOISE_BOUND * abs(sigma)).alias("_floor"))
    # one row; without enough scores there is no floor and all rows stay
    able = narrow.join(F.broadcast(floor), F.coalesce(score >= F.col("_floor"), F.col("_floor").isNull())).drop("_floor")
    noisy = noisy_scores(able, id_col, score_col, iterations, sigma, seed)
    order = Window.partitionBy("iteration").orderBy(F.desc_nulls_last("noisy_score"), F.asc(id_col))
    best = noisy.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    seen = best.select("iteration", stratum_col).distinct().groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n_hit"))
    return null_safe_join(df.select(stratum_col).distinct(), seen, [stratum_col], "left").select(
        stratum_col, (F.coalesce("n_hit", F.lit(0)) / float(iterations)).alias("top_probability")
    )


def score_ceiling(
    df: DataFrame,
    stratum_col: str = "strategy",
    raised: Sequence[str] = ("S_Deliv",),
    profile: Mapping[str, float] = K.PROFILE_V012,
    fixed: Mapping[str, float] | None = None,
) -> DataFrame:
    """Best attainable score by stratum when the raised axes are 1; `fixed` axes take their constant."""
    replaced = {a: F.lit(1.0) for a in raised}
    replaced.update({a: F.lit(v) for a, v in (fixed or {}).items()})
    return df.groupBy(stratum_col).agg(
        F.max(S.weighted(profile)).alias("best_observed"), F.max(S.weighted(profile, replaced)).alias("score_ceiling")
    )


def counterfactuals(
    df: DataFrame,
    scenarios: Mapping[str, Mapping[str, float]],
    profile: Mapping[str, float] = K.PROFILE_V010,
    threshold: float = K.LOCKPOINT_VERBATIM,
) -> DataFrame:
    """Rows above the threshold when axes are replaced, scenario by scenario, counted in one pass.

    n_fail_axis_only counts rows that fail as observed and pass under the scenario.
    """
    observed = F.coalesce(S.weighted(profile) > threshold, F.lit(False))
    aggregates = [F.count_if(observed).alias("n_observed")]
    for i, replaced in enumerate(scenarios.values()):
        passes = S.weighted(profile, {a: F.lit(float(v)) for a, v in replaced.items()}) > threshold
        aggregates.append(F.count_if(passes).alias(f"n_{i}"))
        aggregates.append(F.count_if(passes & ~observed).alias(f"m_{i}"))
    rows = [
        F.struct(
            F.lit(name).alias("scenario"),
            F.col("n_observed").alias("n_observed"),
            F.col(f"n_{i}").alias("n_scenario"),
            (F.col(f"n_{i}") - F.col("n_observed")).alias("n_more"),
            F.col(f"m_{i}").alias("n_fail_axis_only"),
        )
        for i, name in enumerate(scenarios)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
