"""Top-k, caps and diversity rules.

Caps use row_number with an upper bound, which Spark prunes per task before the shuffle (WindowGroupLimit). Frames
kept for swaps hold at most k rows, so their windows and broadcasts are bounded by construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sequences import mutation_fingerprint
from winnow.operators.numbering import null_safe_join, rank_in_group, rank_top
from winnow.session import materialise


def by_score(score_col: str, id_col: str) -> list[Column]:
    return [F.desc_nulls_last(score_col), F.asc(id_col)]


def cap_per_group(
    df: DataFrame,
    group: str | Column,
    order: Sequence[Column],
    limit: int = K.GATE_PER_GENUS,
) -> DataFrame:
    """At most `limit` rows per group in the given order."""
    group = F.col(group) if isinstance(group, str) else group
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= limit).drop("_rn")


def finalists(df: DataFrame, stratum_col: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The best rows of every stratum, written once.

    They include the global top and the best row of any stratum, so the diversity rules read this small table
    several times instead of recomputing the scored input.
    """
    return materialise(cap_per_group(df, stratum_col, order, limit), "finalists")


def cap_per_genus(
    df: DataFrame,
    probability_col: str = "composite_prob",
    id_col: str = "uniprot_acc",
    limit: int = K.GATE_PER_GENUS,
    genus_col: str = "genus",
    organism_col: str = "organism",
) -> DataFrame:
    """Cap by genus; the genus comes from the organism when missing, else Unknown."""
    genus = F.col(genus_col) if genus_col in df.columns else F.lit(None).cast("string")
    if organism_col in df.columns:
        genus = F.coalesce(genus, S.genus_of(organism_col))
    filled = df.withColumn(genus_col, F.coalesce(genus, F.lit(K.UNKNOWN_NAME)))
    return cap_per_group(filled, genus_col, by_score(probability_col, id_col), limit)


def top_by_product(
    df: DataFrame, value_col: str, factor_col: str, id_col: str, limit: int = 150, score_col: str = "rank_score"
) -> DataFrame:
    """First rows by a product score, with the score of the last one as cutoff."""
    scored = df.withColumn(score_col, F.col(value_col) * F.col(factor_col))
    top = rank_top(scored, by_score(score_col, id_col), limit)
    # the frame holds at most `limit` rows
    return top.withColumn("cutoff", F.min(score_col).over(Window.partitionBy(F.lit(1))))


def tiered_selection(
    df: DataFrame,
    stratum_col: str,
    rules: Mapping[str, str | int | Column],
    order: Sequence[Column],
) -> DataFrame:
    """Rows kept by the rule of their stratum: 'all', a top-n count, or a predicate. Unlisted strata are dropped."""
    counts = {s: r for s, r in rules.items() if isinstance(r, int) and not isinstance(r, bool)}
    keep = F.lit(False)
    for stratum, rule in rules.items():
        if stratum in counts:
            continue
        matched = F.lit(True) if isinstance(rule, str) else F.coalesce(rule, F.lit(False))
        keep = keep | ((F.col(stratum_col) == stratum) & matched)
    out = df.filter(keep)
    if counts:
        # the rank is bounded by the largest count, so rows beyond it never leave their task
        window = Window.partitionBy(stratum_col).orderBy(*order)
        ranked = (
            df.filter(F.col(stratum_col).isin(*counts))
            .withColumn("_rn", F.row_number().over(window))
            .filter(F.col("_rn") <= max(counts.values()))
        )
        limit = F.lit(0)
        for stratum, n in counts.items():
            limit = F.when(F.col(stratum_col) == stratum, n).otherwise(limit)
        out = out.unionByName(ranked.filter(F.col("_rn") <= limit).drop("_rn"))
    return out


def swap_top(
    df: DataFrame, score_col: str, stratum_col: str, id_col: str, top: int = 5, crowd: int = 4, keep: int = 50
) -> DataFrame:
    """First `keep` rows after the crowding rule, with position and note.

    If one stratum holds at least `crowd` of the top rows, its row number `crowd` is replaced by the best row of any
    other stratum outside the top, and returns to the head of the remainder. With fewer than `top` rows nothing is
    done.
    """
    order = by_score(score_col, id_col)
    best = finalists(df, stratum_col, order, max(keep, top) + 1)
    return _swap_top(best, score_col, stratum_col, id_col, top, crowd, keep)


def _swap_top(
    df: DataFrame, score_col: str, stratum_col: str, id_col: str, top: int, crowd: int, keep: int
) -> DataFrame:
    order = by_score(score_col, id_col)
    head = rank_top(df, order, max(keep, top) + 1, "_rank")
    in_top = head.filter(F.col("_rank") <= top)
    within = Window.partitionBy(stratum_col)
    crowded = (
        in_top.withColumn("_n", F.count(F.lit(1)).over(within))
        .withColumn("_at", F.row_number().over(within.orderBy("_rank")))
        .withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
        .filter((F.col("_rows") >= top) & (F.col("_n") >= crowd) & (F.col("_at") == crowd))
        .select(F.col(stratum_col).alias("_dominant"), F.col(id_col).alias("_out"), F.col("_rank").alias("_out_rank"))
    )
    # at most one stratum can hold four of five rows, so this frame has one row or none
    outside = df.join(F.broadcast(in_top.select(id_col)), id_col, "left_anti")
    different = ~F.col(stratum_col).eqNullSafe(F.col("_dominant"))
    alternative = (
        outside.join(F.broadcast(crowded), different).orderBy(*order).limit(1)
    )
    note = F.format_string(
        K.SWAP_NOTE, F.col("_out_rank"), F.col("_dominant"), F.col(stratum_col)
    )
    newcomer = alternative.select(*df.columns, F.lit(0).alias("_block"), note.alias("diversity_note"))
    swap = alternative.select("_out", F.col(id_col).alias("_in"))

    marked = head.join(F.broadcast(swap), F.lit(True), "left")
    leaves = F.coalesce(F.col(id_col) == F.col("_out"), F.lit(False))
    stays = (
        marked.filter(~F.coalesce(F.col(id_col) == F.col("_in"), F.lit(False)))
        .withColumn("_block", F.when((F.col("_rank") <= top) & ~leaves, 0).otherwise(1))
        .select(*df.columns, "_block", F.lit("").alias("diversity_note"))
    )
    merged = stays.unionByName(newcomer)
    return rank_top(merged, [F.asc("_block"), *order], keep, "diversity_rank").drop("_block")


def enforce_diversity(
    df: DataFrame,
    top_k: int = 50,
    min_per_strategy: int = 5,
    score_col: str = "score",
    stratum_col: str = "strategy",
    id_col: str = "design_id",
) -> DataFrame:
    """Crowding swap, then the pad to a minimum per stratum, kept as documented compatibility behaviour.

    The pad adds the best rows of short strata and cuts back to `top_k` by score, so it mostly changes nothing; when
    it adds any row, the result is re-sorted by score.
    """
    order = by_score(score_col, id_col)
    best = finalists(df, stratum_col, order, max(top_k, 5, min_per_strategy) + 1)
    swapped = _swap_top(best, score_col, stratum_col, id_col, 5, 4, top_k)
    if min_per_strategy <= 0:
        return swapped
    return pad_strata(best, swapped, top_k, min_per_strategy, score_col, stratum_col, id_col)


def pad_strata(
    df: DataFrame,
    result: DataFrame,
    top_k: int,
    min_per_strategy: int,
    score_col: str = "score",
    stratum_col: str = "strategy",
    id_col: str = "design_id",
) -> DataFrame:
    order = by_score(score_col, id_col)
    counts = result.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("_have"))
    best = cap_per_group(df, stratum_col, order, min_per_strategy)
    # a NULL stratum is a stratum like any other
    short = null_safe_join(best, F.broadcast(counts), [stratum_col], "left").filter(
        F.coalesce("_have", F.lit(0)) < min_per_strategy
    )
    extras = (
        short.drop("_have")
        .join(F.broadcast(result.select(id_col)), id_col, "left_anti")
        .orderBy(*order)
        .limit(top_k)
        .select(*df.columns, F.lit("").alias("diversity_note"), F.lit(None).cast("long").alias("diversity_rank"))
    )
    both = result.unionByName(extras)
    added = F.max(F.col("diversity_rank").isNull()).over(Window.partitionBy(F.lit(1)))
    keyed = both.withColumn("_added", added).withColumn(
        "_old", F.when(F.col("_added"), F.lit(0)).otherwise(F.col("diversity_rank"))
    )
    return rank_top(keyed.drop("diversity_rank"), [F.asc("_old"), *order], top_k, "diversity_rank").drop(
        "_added", "_old"
    )


def diverse_top(
    df: DataFrame,
    k: int = 5,
    min_strata: int = 3,
    score_col: str = "score",
    stratum_col: str = "strategy",
    id_col: str = "design_id",
) -> DataFrame:
    """Top-k with at least `min_strata` strata where the data has them.

    The best rows of absent strata replace the lowest rows that are not the best of their stratum.
    """
    order = by_score(score_col, id_col)
    df = finalists(df, stratum_col, order, k)
    top = rank_top(df, order, k, "_rank")
    within = Window.partitionBy(stratum_col).orderBy("_rank")
    everything = Window.partitionBy(F.lit(1))
    top = top.withColumn("_in_stratum", F.row_number().over(within)).withColumn(
        "_strata", F.count_if(F.col("_in_stratum") == 1).over(everything)
    )
    surplus = F.when(F.col("_in_stratum") > 1, F.col("_rank"))
    top = top.withColumn(
        "_leave_order",
        F.when(
            F.col("_in_stratum") > 1,
            F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(surplus))),
        ),
    )
    # every frame below holds at most k rows
    present = top.select(stratum_col).distinct()
    need = top.agg(
        F.greatest(F.lit(min_strata) - F.coalesce(F.max("_strata"), F.lit(0)), F.lit(0)).alias("_need"),
        F.count("_leave_order").alias("_spare"),
    )
    # eqNullSafe keeps a NULL stratum from counting as absent from itself
    left, right = df.alias("d"), F.broadcast(present).alias("p")
    absent = left.join(
        right, F.col(f"d.{stratum_col}").eqNullSafe(F.col(f"p.{stratum_col}")), "left_anti"
    )
    arrivals = rank_top(cap_per_group(absent, stratum_col, order, 1), order, min_strata, "_arrival")
    room = F.least("_need", "_spare")
    arrivals = arrivals.join(F.broadcast(need), F.col("_arrival") <= room).select(
        *df.columns, F.lit(True).alias("diversity_enforced")
    )
    n_in = arrivals.agg(F.count(F.lit(1)).alias("_arrived"))
    stays = top.join(F.broadcast(n_in), F.coalesce("_leave_order", F.lit(k + 1)) > F.col("_arrived")).select(
        *df.columns, F.lit(False).alias("diversity_enforced")
    )
    return rank_top(stays.unionByName(arrivals), order, k)


def catalog_rank(df: DataFrame, score_col: str = "score", id_col: str = "design_id", rank_col: str = "rank") -> DataFrame:
    """1..n over the whole catalog, without a single-task window."""
    return rank_in_group(df, [], by_score(score_col, id_col), rank_col, [score_col, id_col])


def beaters(
    df: DataFrame, threshold: float = K.LOCKPOINT_VERBATIM, score_col: str = "score", id_col: str = "design_id"
) -> DataFrame:
    return df.filter(S.above(score_col, threshold)).orderBy(*by_score(score_col, id_col))


def top_k(df: DataFrame, k: int, score_col: str = "score", id_col: str = "design_id") -> DataFrame:
    return df.orderBy(*by_score(score_col, id_col)).limit(k)


def sort_variants(
    df: DataFrame, gain_col: str = "predicted_s_immuno_delta", cost_col: str = "predicted_ddg_total", id_col: str = "variant_id"
) -> DataFrame:
    """Largest gain first, then lowest cost."""
    return df.orderBy(F.desc_nulls_last(gain_col), F.asc_nulls_last(cost_col), F.asc(id_col))


def sort_novel_first(df: DataFrame, identity_col: str, id_col: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(identity_col), F.asc(id_col))


def dedupe_variants(
    df: DataFrame,
    n: int,
    mutations_col: str = "mutations_introduced",
    gain_col: str = "predicted_s_immuno_delta",
    cost_col: str = "predicted_ddg_total",
    id_col: str = "variant_id",
    prefix: str = "C",
) -> DataFrame:
    """Best variant of each mutation set, then the first n, relabelled in rank order."""
    order = [F.desc_nulls_last(gain_col), F.asc_nulls_last(cost_col), F.asc(id_col)]
    keyed = df.withColumn("_fingerprint", mutation_fingerprint(mutations_col))
    unique = cap_per_group(keyed, "_fingerprint", order, 1).drop("_fingerprint")
    ranked = rank_top(unique, order, n, "_rank")
    return ranked.withColumn(id_col, F.format_string(f"{prefix}_%03d", "_rank")).drop("_rank")


def nearest_misses(
    df: DataFrame,
    threshold: float = K.LOCKPOINT_VERBATIM,
    profile: Mapping[str, float] = K.PROFILE_V010,
    reference: Mapping[str, float] | None = None,
    score_col: str = "score",
    id_col: str = "design_id",
    limit: int = 10,
) -> DataFrame:
    """Best rows not above the threshold, with the axis that loses most against the reference (1 by default)."""
    reference = reference or {a: 1.0 for a in profile}
    below = df.filter(F.col(score_col) <= threshold)
    gaps = F.array(
        *[
            F.struct(
                ((F.lit(float(reference[a])) - F.coalesce(S.number(a), F.lit(0.0))) * float(w)).alias("gap"),
                F.lit(-i).alias("first"),
                F.lit(a).alias("axis"),
            )
            for i, (a, w) in enumerate(profile.items())
        ]
    )
    worst = F.array_max(gaps)
    top = below.orderBy(*by_score(score_col, id_col)).limit(limit)
    return top.withColumns(
        {
            "margin": F.col(score_col) - threshold,
            "barrier_axis": worst["axis"],
            "barrier_gap": worst["gap"],
        }
    )
