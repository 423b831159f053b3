"""One object over a data folder: the usual questions as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.operators.gates import SOURCE_GATES, Gate, apply_gates, select_designs
from winnow.operators.joins import enrich_metadata
from winnow.operators.ranking import cap_per_genus
from winnow.operators.scoring import normalize_columns
from winnow.plans.variants import chimera_library, score_redesigns, select_variants
from winnow.sources.catalog import load_registry, read_catalog
from winnow.sources.fasta import read_fasta


class Designer:
    """Catalog, chimeras, orthologs, variants and redesigns below one folder. Nothing is computed until an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def get_catalog(self) -> DataFrame:
        return read_catalog(self.spark, f"{self.folder}/catalog")

    def select_designs(self, strategy: str | None = None, require_free: bool = True, top_k: int = 10, **columns) -> DataFrame:
        return select_designs(self.get_catalog(), strategy, require_free, top_k, label_col="tier_a", **columns)

    def compose_chimera(self, scaffold: str, guide_module: str) -> DataFrame:
        """Designs whose catalytic modules come from the scaffold and whose guide is the module.

        Any registered scaffold may be asked for; one that contributes no catalytic core gives no design.
        """
        scaffolds = sorted(s[0] for s in K.SCAFFOLDS)
        if scaffold not in scaffolds:
            raise ValueError(f"unknown scaffold {scaffold!r}; available: {scaffolds}")
        guides = sorted({label for label, _ in K.RNA_MODULES})
        if guide_module not in guides:
            raise ValueError(f"unknown guide {guide_module!r}; available: {guides}")
        library = chimera_library(read_fasta(self.spark, f"{self.folder}/scaffolds").select("id", "sequence"))
        first = F.element_at("modules_used", 1)["source_scaffold"]
        return library.filter((first == scaffold) & (F.col("provenance.rna_module") == guide_module))

    def discover_orthologs(
        self,
        catalog: DataFrame,
        metadata: DataFrame | None = None,
        min_probability: float = K.GATE_PROBABILITY,
        max_per_genus: int = K.GATE_PER_GENUS,
    ) -> DataFrame:
        """Gates 1-4; any probability threshold keeps the length gate."""
        gates = (Gate("1", ("composite_prob",), "ge", min_probability), SOURCE_GATES[1])
        survivors = apply_gates(normalize_columns(catalog), gates)
        if metadata is not None:
            survivors = enrich_metadata(survivors, metadata)
        return cap_per_genus(apply_gates(survivors, SOURCE_GATES[2:]), limit=max_per_genus)

    def deimmunize(self, proposals: DataFrame, wild_type: str, n_variants: int = 50) -> DataFrame:
        """Best distinct variants among proposed mutation sets."""
        return select_variants(proposals, n_variants, wild_type=wild_type)

    def redesign_backbone(self, fasta: str, wild_type: str, bounds: Sequence[float] = K.IDENTITY_RANGE) -> DataFrame:
        return score_redesigns(read_fasta(self.spark, fasta).select("id", "sequence"), wild_type, *bounds)

    def modules(self) -> DataFrame:
        return load_registry(self.spark, "modules")
