"""Quality gates with explicit null rules, and the reports on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.operators.scoring import first_present

COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "ge": lambda c, v: S.number(c) >= v,
    "gt": lambda c, v: S.number(c) > v,
    "le": lambda c, v: S.number(c) <= v,
    "lt": lambda c, v: S.number(c) < v,
    "between": lambda c, v: S.number(c).between(*v),
    "eq": lambda c, v: c == v,
    "true": lambda c, v: c.cast("boolean"),
    "has_text": lambda c, v: F.length(c) > 0,
}


# the same comparisons on the bare column, so that a filter reaches the scan; only >= and > would let NaN pass
PUSHABLE: dict[str, Callable[[Column, object], Column]] = {
    "ge": lambda c, v: (c >= v) & ~F.isnan(c),
    "gt": lambda c, v: (c > v) & ~F.isnan(c),
    "le": lambda c, v: c <= v,
    "lt": lambda c, v: c < v,
    "between": lambda c, v: c.between(*v),
    "eq": lambda c, v: c == v,
    "true": lambda c, v: c.cast("boolean"),
    "has_text": lambda c, v: F.length(c) > 0,
}
NUMERIC = ("ge", "gt", "le", "lt", "between")


@dataclass(frozen=True)
class Gate:
    """One gate: the first existing column, a comparison, and what a NULL does ('drop' or 'keep')."""

    name: str
    columns: tuple[str, ...]
    comparison: str
    value: object = None
    on_null: str = "drop"
    required: bool = False

    def condition(self, column: str) -> Column:
        return F.coalesce(COMPARISONS[self.comparison](F.col(column), self.value), F.lit(self.on_null == "keep"))

    def kept(self, column: str) -> Column:
        """Filter form of the condition: a NULL result drops the row, so dropping needs no wrapper."""
        c = F.col(column)
        passes = PUSHABLE[self.comparison](c, self.value)
        if self.on_null == "drop":
            return passes
        missing = c.isNull() | F.isnan(c) if self.comparison in NUMERIC else c.isNull()
        return missing | passes

    @property
    def flag(self) -> str:
        return f"gate_{self.name}_pass"


SOURCE_GATES = (
    Gate("1", ("composite_prob",), "ge", K.GATE_PROBABILITY),
    Gate("2", ("composite",), "true"),
    Gate("3", ("protein_length_aa",), "between", K.GATE_LENGTH),
)
STRUCTURE_GATES = (
    Gate("5_global", ("af3_mean_plddt",), "ge", K.GATE_GLOBAL_PLDDT, required=True),
    Gate("5_site", ("af3_active_site_plddt",), "ge", K.GATE_SITE_PLDDT, required=True),
)
TRIAGE_GATES = (
    Gate("A", ("esmfold_mean_plddt", "mean_plddt", "af3_mean_plddt"), "ge", K.TRIAGE_PLDDT),
    Gate("B", ("ddg_kcal_mol",), "le", K.TRIAGE_DDG),
    Gate("C", ("active_site_pass",), "true", on_null="keep"),
    Gate("D", ("tier_a",), "eq", K.CLASS_FREE),
    Gate("E", ("score",), "ge", 0.0),
)


def resolve_gates(df: DataFrame, gates: Sequence[Gate]) -> tuple[list[tuple[Gate, str]], list[str]]:
    """Gates that can run with their column, and the names of those skipped for want of one."""
    active, skipped = [], []
    for gate in gates:
        column = first_present(df, gate.columns)
        if column is not None:
            active.append((gate, column))
        elif gate.required:
            raise ValueError(f"gate {gate.name} needs one of the columns {list(gate.columns)}")
        else:
            skipped.append(gate.name)
    return active, skipped


def apply_gates(df: DataFrame, gates: Sequence[Gate], mode: str = "filter") -> DataFrame:
    """Gate flags for all rows plus the first failed gate ('annotate'), or the survivors ('filter')."""
    active, _ = resolve_gates(df, gates)
    if mode == "filter":
        for gate, column in active:
            df = df.filter(gate.kept(column))
        return df.withColumns({gate.flag: F.lit(True) for gate, _ in active}) if active else df
    flagged = df.withColumns({gate.flag: gate.condition(column) for gate, column in active})
    return flagged.withColumn("first_failed_gate", first_failed([g for g, _ in active]))


def first_failed(gates: Sequence[Gate]) -> Column:
    out = F.lit(None).cast("string")
    for gate in reversed(list(gates)):
        out = F.when(~F.col(gate.flag), gate.name).otherwise(out)
    return out


def skip_gate(df: DataFrame, name: str, report: str | None = None) -> DataFrame:
    """Status columns of a gate that could not run: NULL means not evaluated, and every row stays."""
    columns = {f"gate_{name}_pass": F.lit(None).cast("boolean")}
    if report:
        columns[f"gate_{name}_{report}"] = F.lit(None).cast("double")
    return df.withColumns(columns)


def funnel_report(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Input, output and removed rows of every gate, counted in one pass."""
    active, _ = resolve_gates(df, gates)
    alive = F.lit(True)
    counts = [F.count(F.lit(1)).alias("n_0")]
    for i, (gate, column) in enumerate(active, 1):
        alive = alive & gate.condition(column)
        counts.append(F.count_if(alive).alias(f"n_{i}"))
    steps = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(gate.name).alias("gate"),
            F.col(f"n_{i - 1}").alias("n_input"),
            F.col(f"n_{i}").alias("n_output"),
            (F.col(f"n_{i - 1}") - F.col(f"n_{i}")).alias("n_removed"),
        )
        for i, (gate, _) in enumerate(active, 1)
    ]
    return df.agg(*counts).select(F.inline(F.array(*steps)))


def failure_modes(df: DataFrame, gates: Sequence[Gate], stratum_col: str) -> DataFrame:
    """Rows failing first at each gate, by stratum and in total (stratum NULL, is_total true).

    Strata and gates without failures appear with zero: gates are known to the plan and every stratum is a group.
    """
    annotated = apply_gates(df, gates, "annotate")
    active, _ = resolve_gates(df, gates)
    counts = [F.count_if(F.col("first_failed_gate") == g.name).alias(f"n_{i}") for i, (g, _) in enumerate(active)]
    rolled = annotated.rollup(stratum_col).agg(
        F.grouping(stratum_col).cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("n_rows"), *counts
    )
    rows = [
        F.struct(F.lit(g.name).alias("failure_mode"), F.col(f"n_{i}").alias("n_failed"))
        for i, (g, _) in enumerate(active)
    ]
    return rolled.select(stratum_col, "is_total", "n_rows", F.inline(F.array(*rows)))


# --- stand-alone gates -----------------------------------------------------------------------------------------


def filter_ddg(df: DataFrame, column: str = "ddg_kcal_mol", limit: float = K.TRIAGE_DDG) -> DataFrame:
    """Keep missing values and values up to the limit; pass everything when the column is absent."""
    if column not in df.columns:
        return df
    return df.filter(Gate("ddg", (column,), "le", limit, "keep").kept(column))


def filter_class(
    df: DataFrame,
    label_col: str = "tier_a",
    confidence_col: str = "tier_a_confidence",
    minimum: float = K.GATE_CONFIDENCE,
    label: str = K.CLASS_FREE,
) -> DataFrame:
    flagged = df.withColumn("class_flag", S.flag_class(label_col))
    return flagged.filter((F.col(label_col) == label) & S.at_least(confidence_col, minimum))


def gate_composite(
    df: DataFrame,
    flag_col: str = "composite",
    label: str | None = None,
    label_col: str = "tier_a",
    min_confidence: float | None = None,
    confidence_col: str = "tier_a_confidence",
) -> DataFrame:
    out = df.filter(F.col(flag_col).cast("boolean"))
    if label is not None:
        out = out.filter(F.col(label_col) == label)
    if min_confidence is not None:
        out = out.filter(S.at_least(confidence_col, min_confidence))
    return out


def domain_gate_proxy(df: DataFrame, proxy_col: str, families: Sequence[str] = K.DOMAIN_FAMILIES) -> DataFrame:
    """Both domain flags taken from one precomputed boolean; rows without it are dropped."""
    proxy = F.coalesce(F.col(proxy_col).cast("boolean"), F.lit(False))
    flags = {f"gate_7_{f.lower()}": proxy for f in families}
    return df.withColumns({**flags, "gate_7_pass": proxy, "gate_7_source": F.lit(f"{proxy_col}_proxy")}).filter(
        "gate_7_pass"
    )


def domain_gate_hits(
    df: DataFrame,
    hits: DataFrame,
    key: str,
    families: Sequence[str] = K.DOMAIN_FAMILIES,
    threshold: float = K.GATE_E_VALUE,
) -> DataFrame:
    """Keep candidates with a hit below the threshold in every family."""
    strong = hits.filter(F.col("family").isin(*families) & (S.number("e_value") < threshold))
    found = strong.groupBy(key).agg(
        *[F.bool_or(F.col("family") == f).alias(f"gate_7_{f.lower()}") for f in families]
    )
    flags = [f"gate_7_{f.lower()}" for f in families]
    joined = df.join(found, key, "left").withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    every = F.lit(True)
    for f in flags:
        every = every & F.col(f)
    return joined.withColumn("gate_7_pass", every).filter("gate_7_pass")


def confidence_gate(
    df: DataFrame,
    plddt_col: str = "mean_plddt",
    ptm_col: str = "ptm",
    plddt_min: float = K.GATE_GLOBAL_PLDDT,
    ptm_min: float = K.PTM_MIN,
    flag: str = "pass_gate5",
) -> DataFrame:
    plddt = F.coalesce(S.number(plddt_col) >= plddt_min, F.lit(False))
    ptm = F.coalesce(S.number(ptm_col) >= ptm_min, F.lit(False))
    return df.withColumns({"pass_plddt": plddt, "pass_ptm": ptm}).withColumn(
        flag, F.col("pass_plddt") & F.col("pass_ptm")
    )


def prefilter(df: DataFrame, plddt_col: str = "esmfold_plddt", cutoff: float = K.TRIAGE_PLDDT) -> DataFrame:
    """First-tier verdict with the discard reason; NULL when the tier was not run."""
    value = S.number(plddt_col)
    reason = F.format_string(f"mean pLDDT %.1f < {cutoff}", value)
    return df.withColumns(
        {"esmfold_pass": value >= cutoff, "esmfold_discard_reason": F.when(value < cutoff, reason)}
    )


def identity_range(
    df: DataFrame, column: str, low: float = K.IDENTITY_RANGE[0], high: float = K.IDENTITY_RANGE[1], on_null: str = "keep"
) -> DataFrame:
    return df.filter(Gate("identity", (column,), "between", (low, high), on_null).kept(column))


def rmsd_check(rmsd: str | Column, limit: float = K.RMSD_MAX) -> Column:
    """Three-valued: NULL when the deviation is unknown."""
    return S.number(rmsd) <= limit


def size_gate(df: DataFrame, column: str = "total_aa", bounds: tuple[int, int] = K.SIZE_RANGE) -> DataFrame:
    return df.filter(F.col(column).between(*bounds))


def has_sequence(df: DataFrame, column: str = "protein_sequence") -> DataFrame:
    return df.filter(F.length(column) > 0)


def active_site_gate(
    df: DataFrame,
    mean_col: str = "site_mean",
    min_col: str = "site_min",
    found_col: str = "site_found",
    global_col: str = "mean_plddt",
    ptm_col: str = "ptm",
    threshold: float = K.GATE_SITE_PLDDT,
) -> DataFrame:
    """Confidence at the mapped positions, or the global mean (count -1) when none was found."""
    missing = F.coalesce(F.col(found_col), F.lit(0)) == 0
    mean = F.when(missing, F.col(global_col)).otherwise(F.col(mean_col))
    return df.withColumns(
        {
            "active_site_plddt": mean,
            "active_site_min": F.when(missing, F.col(global_col)).otherwise(F.col(min_col)),
            "cat_residues_sampled": F.when(missing, F.lit(-1)).otherwise(F.col(found_col).cast("int")),
            "pass_active_site": F.coalesce(mean >= threshold, F.lit(False)),
            "rank_score": mean * F.col(ptm_col),
        }
    )


# --- selections ------------------------------------------------------------------------------------------------


def select_designs(
    df: DataFrame,
    strategy: str | None = None,
    require_free: bool = True,
    top_k: int = 10,
    strategy_col: str = "strategy",
    label_col: str = "tier_a",
    score_col: str = "score",
    id_col: str = "design_id",
) -> DataFrame:
    if strategy:
        df = df.filter(F.col(strategy_col) == strategy)
    if require_free and label_col in df.columns:
        df = df.filter(F.col(label_col) == K.CLASS_FREE)
    order = [F.desc_nulls_last(score_col)] if score_col in df.columns else []
    return df.orderBy(*order, F.asc(id_col)).limit(top_k)


def filter_strategy(
    df: DataFrame,
    strategy: str,
    strategy_col: str = "strategy",
    score_col: str = "score",
    id_col: str = "design_id",
    allowed: Sequence[str] = K.STRATEGIES,
) -> DataFrame:
    """Rows of one stratum by score; an unknown or empty stratum is an error."""
    if strategy not in allowed:
        raise ValueError(f"{strategy_col} must be one of {sorted(allowed)}; got {strategy!r}")
    part = df.filter(F.col(strategy_col) == strategy)
    if part.isEmpty():
        raise ValueError(f"no rows for {strategy_col} {strategy!r}")
    return part.orderBy(F.desc_nulls_last(score_col), F.asc(id_col))


def search(
    df: DataFrame,
    text: str = "",
    strategy: str | None = None,
    min_score: float = 0.0,
    beaters_only: bool = False,
    sort: str = "score",
    ascending: bool = False,
    text_cols: Sequence[str] = ("design_id", "organism"),
    strategy_col: str = "strategy",
    score_col: str = "score",
    flag_col: str = "beats_lockpoint",
    id_col: str = "design_id",
) -> DataFrame:
    """Case-insensitive search over the text columns with score and flag filters."""
    out = df.filter(S.at_least(score_col, min_score))
    if strategy is not None:
        out = out.filter(F.col(strategy_col) == strategy)
    if beaters_only:
        out = out.filter(F.col(flag_col))
    if text:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        out = out.filter(hit)
    key = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    return out.orderBy(key, F.asc(id_col))


def display_projection(df: DataFrame, rounding: dict[str, int], text_cols: Sequence[str] = ()) -> DataFrame:
    """Rounded numbers and blank text instead of NULL, for export."""
    columns = {c: S.round_exact(F.col(c).cast("double"), d) for c, d in rounding.items()}
    columns.update({c: F.coalesce(F.col(c), F.lit("")) for c in text_cols})
    return df.withColumns(columns)


def beats_predicate(score_col: str = "score", threshold: float = K.LOCKPOINT_VERBATIM) -> Column:
    return F.coalesce(S.beats(score_col, threshold), F.lit(False))


def cargo_delivery_predicate(
    cargo_col: str = "S_Cargo", delivery_col: str = "S_Deliv", cargo: float = 1.0, delivery: float = 0.9
) -> Column:
    both = (S.number(cargo_col) == cargo) & (S.number(delivery_col) >= delivery)
    return F.coalesce(both, F.lit(False))
