"""Scoring, triage and ranking; structure triage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions.sequences import mapped_positions
from winnow.operators.aggregates import confidence_at_positions
from winnow.operators.gates import TRIAGE_GATES, Gate, active_site_gate, apply_gates, confidence_gate
from winnow.operators.ranking import diverse_top, enforce_diversity, tiered_selection
from winnow.operators.scoring import first_present, score_batch


def score_and_triage(
    designs: DataFrame, gates: Sequence[Gate] = TRIAGE_GATES, mode: str = "filter", **scoring
) -> DataFrame:
    """Axes, score and gates, no shuffle. In filter mode, gates on columns that scoring does not write also run before it."""
    if mode == "filter":
        written = {*K.AXES, scoring.get("score_col", "score"), "beats_lockpoint", "score_method"}
        early = [g for g in gates if written.isdisjoint(g.columns) and first_present(designs, g.columns)]
        designs = apply_gates(designs, early).select(designs.columns)
    return apply_gates(score_batch(designs, **scoring), gates, mode)


def triaged_ranking(
    designs: DataFrame,
    top_k: int = 50,
    min_per_strategy: int = 5,
    guaranteed: bool = False,
    min_strata: int = 3,
    gates: Sequence[Gate] = TRIAGE_GATES,
    **scoring,
) -> DataFrame:
    """Ranked survivors under the compatibility rule, or with guaranteed diversity."""
    triaged = score_and_triage(designs, gates, **scoring)
    if guaranteed:
        return diverse_top(triaged, top_k, min_strata)
    return enforce_diversity(triaged, top_k, min_per_strategy)


def structure_triage(
    results: DataFrame,
    atoms: DataFrame,
    rules: Mapping[str, str | int | Column] | None = None,
    key: str = "design_id",
    stratum_col: str = "strategy",
    length_col: str = "seq_len",
) -> DataFrame:
    """Confidence gate, confidence at the mapped positions, active-site gate, selection by stratum."""
    passed = confidence_gate(results).filter("pass_gate5")
    positions = passed.select(key, mapped_positions(stratum_col, length_col).alias("positions"))
    sites = confidence_at_positions(atoms, positions, key)
    gated = active_site_gate(passed.join(sites, key, "left"))
    if rules is None:
        return gated
    return tiered_selection(gated, stratum_col, rules, [F.desc_nulls_last("rank_score"), F.asc(key)])
