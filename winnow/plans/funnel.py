"""Source funnel: catalogs to numbered candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from winnow import constants as K
from winnow.operators.gates import (
    SOURCE_GATES,
    apply_gates,
    domain_gate_hits,
    domain_gate_proxy,
    has_sequence,
    skip_gate,
)
from winnow.operators.joins import enrich_metadata, merge_sources
from winnow.operators.neighbours import novelty_gate
from winnow.operators.numbering import assign_ids
from winnow.operators.ranking import by_score, cap_per_genus
from winnow.operators.scoring import normalize_columns
from winnow.operators.sets import dedupe_by_source
from winnow.sources.catalog import write_catalog, write_summary
from winnow.sources.fasta import write_fasta


def ortholog_funnel(
    catalogs: Sequence[tuple[str, DataFrame]],
    embeddings: DataFrame | None = None,
    known_ids: DataFrame | None = None,
    hits: DataFrame | None = None,
    metadata: DataFrame | None = None,
    proxy_col: str = "is110_reclassified",
    max_per_genus: int = K.GATE_PER_GENUS,
    key: str = "uniprot_acc",
    vector_col: str = "embedding",
) -> DataFrame:
    """Union, gates 1-3, cap per genus, novelty, domains, sequences, ids.

    Gates on plain columns reach the scan; the cap stays ahead of the novelty and domain gates, as rows it drops
    must not be replaced by lower-ranked ones.
    """
    labelled = [(name, normalize_columns(df)) for name, df in catalogs]
    merged = merge_sources(labelled)
    if len(labelled) > 1:
        ties = sorted(f.name for f in merged.schema if f.name not in (key, "source") and not isinstance(f.dataType, MapType))
        merged = dedupe_by_source(merged, key, "source", [name for name, _ in labelled], ties)
    survivors = apply_gates(merged, SOURCE_GATES[:2])
    if metadata is not None:
        survivors = enrich_metadata(survivors, metadata, key)
    survivors = apply_gates(survivors, SOURCE_GATES[2:])
    survivors = cap_per_genus(survivors, id_col=key, limit=max_per_genus)

    if embeddings is None or known_ids is None:
        survivors = skip_gate(survivors, "6", "distance")
    else:
        survivors = novelty_gate(survivors, embeddings, known_ids, key, vector_col)

    if proxy_col in survivors.columns:
        survivors = domain_gate_proxy(survivors, proxy_col)
    elif hits is not None:
        survivors = domain_gate_hits(survivors, hits, key)
    else:
        survivors = skip_gate(survivors, "7")

    numbered = assign_ids(
        has_sequence(survivors), "B", key, by_score("composite_prob", key), order_columns=["composite_prob", key]
    )
    return numbered.withColumns(
        {"strategy": F.lit(K.STRATEGY_ORTHOLOG), "gate_5_status": F.lit(K.STRUCTURE_DEFERRED)}
    )


def write_funnel(candidates: DataFrame, folder: str) -> None:
    """Parquet first; FASTA and summary read that file back, so the funnel runs once."""
    write_catalog(candidates, f"{folder}/candidates")
    stored = candidates.sparkSession.read.schema(candidates.schema).parquet(f"{folder}/candidates")
    tags = [("organism", "organism", "%s")] if "organism" in stored.columns else []
    write_fasta(stored, f"{folder}/candidates_fasta", "design_id", "protein_sequence", tags, width=0)
    write_summary(
        stored,
        f"{folder}/gate_summary",
        "design_id",
        {
            "gate_6_applied": F.coalesce(F.bool_or(F.col("gate_6_pass").isNotNull()), F.lit(False)),
            "gate_7_applied": F.coalesce(F.bool_or(F.col("gate_7_pass").isNotNull()), F.lit(False)),
            "n_genera_represented": F.count_distinct("genus"),
        },
        gate_5_status=K.STRUCTURE_DEFERRED,
    )
