"""Catalog release, version migration, expression table and hypothesis report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions import sequences as Q
from winnow.operators import checks as V
from winnow.operators.aggregates import delta_by_strategy
from winnow.operators.gates import beats_predicate, cargo_delivery_predicate
from winnow.operators.joins import membership_flag
from winnow.operators.ranking import beaters, by_score, diverse_top
from winnow.operators.scoring import add_evidence_flags, axis_contributions, migrate_parents, rename_values, rescore
from winnow.session import materialise, release
from winnow.sources.catalog import read_catalog, write_catalog, write_records_json
from winnow.sources.fasta import write_fasta
from winnow.sources.manifest import checksum_manifest, write_manifest

HEADER_TAGS = (
    ("strategy", "strategy", "%s"),
    ("score", "score", "%.4f"),
    ("length", "protein_length_aa", "%saa"),
    ("S_DSB", "S_DSB", "%.3f"),
    ("S_Immuno", "S_Immuno", "%.4f"),
    ("beats_lockpoint", "beats_lockpoint", "%s"),
)


def release_catalog(triaged: DataFrame, folder: str, threshold: float = K.LOCKPOINT_VERBATIM, k: int = 5) -> DataFrame:
    """Scorecard, subsets, FASTA, records and manifest.

    Every later sink reads the written scorecard; each subset is evaluated once, stored for its sinks and then deleted.
    """
    spark = triaged.sparkSession
    write_catalog(triaged, f"{folder}/catalog")
    stored = read_catalog(spark, f"{folder}/catalog", schema=triaged.schema)
    write_catalog(stored, f"{folder}/catalog_csv", fmt="csv")
    above = materialise(beaters(stored, threshold), "above")
    top = materialise(diverse_top(stored, k), "top")
    write_catalog(above, f"{folder}/beaters_csv", fmt="csv")
    write_catalog(top, f"{folder}/top_csv", fmt="csv")
    tags = [t for t in HEADER_TAGS if t[1] in stored.columns]
    for name, frame in (("all_designs", stored), ("beaters", above), ("top", top)):
        write_fasta(frame, f"{folder}/{name}_fasta", "design_id", "protein_sequence", tags)
    write_records_json(stored, f"{folder}/designs")
    for frame in (above, top):
        release(frame)
    manifest = checksum_manifest(spark, folder)
    write_manifest(manifest, f"{folder}/manifest")
    return stored


def migrate_catalog(catalog: DataFrame, id_col: str = "design_id", **rescoring) -> DataFrame:
    """Second profile, parents, evidence flags: 27 columns by score."""
    rescored = rescore(catalog, id_col, **rescoring)
    upgraded = add_evidence_flags(migrate_parents(rename_values(rescored, "parent_editor"), id_col))
    return upgraded.orderBy(*by_score("score_v012", id_col))


def write_migration(catalog: DataFrame, folder: str, rows: int | None = None, id_col: str = "design_id") -> DataFrame:
    """Write the migrated catalog and check what was written; the report of the checks is returned."""
    upgraded = migrate_catalog(catalog, id_col)
    write_catalog(upgraded, f"{folder}/catalog")
    written = read_catalog(catalog.sparkSession, f"{folder}/catalog", schema=upgraded.schema)
    delta_by_strategy(written).write.json(f"{folder}/delta_by_strategy")
    return V.check_invariants(written, rows, len(upgraded.columns))


def expression_table(
    catalog: DataFrame,
    top: DataFrame,
    threshold: float = K.LOCKPOINT_VERBATIM,
    score_col: str = "score",
    id_col: str = "design_id",
    sequence_col: str = "protein_sequence",
) -> DataFrame:
    """Coding sequence, GC share, motifs, mass and membership of every design above the threshold."""
    sheet_motifs = {n: s for n, s in K.RESTRICTION_SITES.items() if n != "SalI"}
    above = beaters(catalog, threshold, score_col, id_col)
    coded = above.withColumn("coding_dna", F.coalesce(Q.translate_codons(sequence_col), F.lit("")))
    table = coded.withColumns(
        {
            "gc_fraction": Q.gc_fraction("coding_dna"),
            "motif_hits": Q.motif_hits("coding_dna", sheet_motifs),
            "mass_kda": S.mass_kda(sequence_col),
            "orf": Q.build_orf(sequence_col, strict=False),
        }
    )
    return membership_flag(table, top, id_col, "in_top")


def expression_axes(catalog: DataFrame, threshold: float = K.LOCKPOINT_VERBATIM, score_col: str = "score", id_col: str = "design_id") -> DataFrame:
    return axis_contributions(beaters(catalog, threshold, score_col, id_col), id_col)


def hypothesis_results(
    triaged: DataFrame, stratum_col: str = "strategy", id_col: str = "design_id", score_col: str = "score"
) -> DataFrame:
    """test_id and verdict of the five hypotheses: the four counted ones in one pass, then the diversity of the top."""
    targeted = F.when(F.col(stratum_col) == "C", S.number("S_Immuno"))
    counts = triaged.agg(
        F.count_if(beats_predicate(score_col)).alias("n_beating"),
        F.count_if(cargo_delivery_predicate()).alias("n_joint"),
        F.max(targeted).alias("best"),
        F.count_if(F.col(stratum_col) == "B").alias("n_survivors"),
    )
    gain = F.col("best") - K.BASELINE_IMMUNO >= 0.10
    verdicts = {
        "H1": V.verdict(F.col("n_beating") >= 5),
        "H2": V.verdict(F.col("n_joint") >= 1),
        "H3": V.verdict(gain, F.col("best").isNotNull()),
        "H4": V.verdict(F.col("n_survivors") >= 10),
    }
    rows = [F.struct(F.lit(t).alias("test_id"), v.alias("verdict")) for t, v in verdicts.items()]
    top = V.hypothesis_diversity(
        triaged, score_col=score_col, stratum_col=stratum_col, id_col=id_col, sequence_col=None
    )
    return counts.select(F.inline(F.array(*rows))).unionByName(top.select("test_id", "verdict"))


def hypothesis_report(triaged: DataFrame, **columns) -> DataFrame:
    registry = V.hypothesis_registry(triaged.sparkSession)
    return V.rollup_verdicts(registry, hypothesis_results(triaged, **columns))
