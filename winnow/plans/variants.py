"""Variant selection and the chimera library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sequences import apply_mutations, novel_count, positional_identity
from winnow.functions.windows import window_load
from winnow.operators.aggregates import epitopes_removed
from winnow.operators.gates import identity_range
from winnow.operators.joins import generate_chimeras, slice_modules
from winnow.operators.ranking import dedupe_variants, sort_novel_first
from winnow.operators.sets import exclude_recoveries
from winnow.sources.catalog import load_registry, write_catalog, write_summary
from winnow.sources.fasta import write_fasta


def score_variants(
    proposals: DataFrame,
    parents: DataFrame | None = None,
    wild_type: str | None = None,
    loads: DataFrame | None = None,
    baseline: float = K.BASELINE_IMMUNO,
    key: str = "variant_id",
    mutations_col: str = "mutations_introduced",
) -> DataFrame:
    """Sequence, load, gain and cost of proposed mutation sets.

    The parent is one wild type, or a table (parent_id, sequence) joined by the proposals' parent_id. Measured
    loads (n1, n2 by variant) replace the window scan when given.
    """
    if wild_type is not None:
        based = proposals.withColumn("_parent", F.lit(wild_type))
    else:
        based = proposals.join(parents.select("parent_id", F.col("sequence").alias("_parent")), "parent_id")
    made = based.withColumn("protein_sequence", apply_mutations("_parent", mutations_col))
    if loads is not None:
        loaded = made.join(loads.select(key, "n1", "n2"), key, "left")
        base1, base2 = K.BASELINE_LOAD_CLASS_1, K.BASELINE_LOAD_CLASS_2
        removed = epitopes_removed(loaded, baseline1=base1, baseline2=base2)
    else:
        scanned = made.withColumns(
            {
                "_load": window_load("protein_sequence", positions=False),
                "_base": window_load("_parent", positions=False),
            }
        ).withColumns({"n1": F.col("_load.n1"), "n2": F.col("_load.n2")})
        removed = scanned.withColumns(
            {
                "n_mhc_i_epitopes_removed": F.greatest(F.lit(0), F.col("_base.n1") - F.col("n1")),
                "n_mhc_ii_epitopes_removed": F.greatest(F.lit(0), F.col("_base.n2") - F.col("n2")),
            }
        ).drop("_load", "_base")
    immuno = S.score_load("n1", "n2")
    cost = F.aggregate(F.col(mutations_col), F.lit(0.0), lambda acc, m: acc + m["ddg_pred"])
    return removed.drop("_parent").withColumns(
        {
            "total_mutations": F.size(mutations_col),
            "predicted_s_immuno": immuno,
            "predicted_s_immuno_delta": S.round_exact(immuno - baseline, 4),
            "predicted_ddg_total": S.round_exact(cost, 2),
        }
    ).withColumn("passes_gain", F.col("predicted_s_immuno_delta") >= K.MIN_IMMUNO_GAIN)


def select_variants(proposals: DataFrame, n: int = 50, **scoring) -> DataFrame:
    """Best variant of each mutation set by gain then cost, first n, relabelled."""
    return dedupe_variants(score_variants(proposals, **scoring), n)


def write_variants(
    variants: DataFrame, folder: str, scaffold: str = K.DEFAULT_PARENT, baseline: float = K.BASELINE_IMMUNO, sequence_col: str = "protein_sequence"
) -> None:
    """Parquet with the constants of the run, tagged FASTA and manifest; the latter two read the Parquet back."""
    constants = {"strategy": F.lit(K.STRATEGY_VARIANT), "scaffold_id": F.lit(scaffold), "s_immuno_wt_baseline": F.lit(float(baseline))}
    labelled = variants.withColumns(constants)
    write_catalog(labelled, f"{folder}/variants")
    stored = variants.sparkSession.read.schema(labelled.schema).parquet(f"{folder}/variants")
    tags = [("delta_s_immuno", "predicted_s_immuno_delta", "%+.4f"), ("n_mut", "total_mutations", "%d"), ("ddg", "predicted_ddg_total", "%.2f")]
    write_fasta(stored, f"{folder}/variants_fasta", "variant_id", sequence_col, tags, width=0)
    gain = F.col("predicted_s_immuno_delta")
    counts = {"n_passing": F.count_if(F.col("passes_gain")), "best_variant_id": F.max_by("variant_id", gain), "best_delta": F.max(gain)}
    write_summary(
        stored, f"{folder}/manifest", "variant_id", counts, scaffold_id=scaffold, threshold_delta=K.MIN_IMMUNO_GAIN, wt_s_immuno=float(baseline),
        rank_class_1=K.RANK_CLASS_1, rank_class_2=K.RANK_CLASS_2,
    )


def chimera_library(sequences: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Module slices of the scaffold sequences (id, sequence), combined and sized."""
    spark = sequences.sparkSession
    cut = slice_modules(sequences, load_registry(spark, "modules") if modules is None else modules)
    return generate_chimeras(
        cut, load_registry(spark, "cores"), load_registry(spark, "guides"), load_registry(spark, "linkers")
    )


def write_chimeras(designs: DataFrame, folder: str) -> None:
    write_catalog(designs, f"{folder}/designs")
    stored = designs.sparkSession.read.schema(designs.schema).parquet(f"{folder}/designs")
    write_fasta(stored, f"{folder}/designs_fasta", "design_id", "full_sequence", width=0)
    write_summary(stored, f"{folder}/manifest", "design_id", {}, strategy=K.STRATEGY_SWAP)


def score_redesigns(
    records: DataFrame, wild_type: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Redesigned sequences (id, sequence) with identity to the wild type, most novel first.

    Exact recoveries are dropped; identity bounds apply when given.
    """
    novel = exclude_recoveries(records, "sequence", wild_type)
    parent = F.lit(wild_type)
    scored = novel.withColumns(
        {
            "sequence_identity_to_wt": S.round_exact(positional_identity("sequence", parent), 4),
            "novel_residues_count": novel_count("sequence", parent),
        }
    )
    if low is not None and high is not None:
        scored = identity_range(scored, "sequence_identity_to_wt", low, high)
    return sort_novel_first(scored, "sequence_identity_to_wt", "id")
