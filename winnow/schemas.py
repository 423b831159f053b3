"""Explicit schemas of the published tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from winnow import constants as K


def _fields(kind, names) -> list[StructField]:
    return [StructField(n, kind, True) for n in names]


def catalog_schema(score_col: str = "score", flag_col: str = "beats_lockpoint") -> StructType:
    """Published catalog; score and flag column names are the caller's."""
    return StructType(
        [
            *_fields(StringType(), ["design_id", "strategy"]),
            *_fields(IntegerType(), ["protein_length_aa"]),
            *_fields(StringType(), ["tier_a"]),
            *_fields(BooleanType(), ["composite"]),
            *_fields(DoubleType(), ["composite_prob", *K.AXES, score_col]),
            *_fields(BooleanType(), [flag_col]),
            *_fields(DoubleType(), ["final_mean_plddt", "active_site_plddt", "ddg_kcal_mol"]),
            *_fields(StringType(), ["ddg_method", "stability_gate_status", "organism", "genus", "protein_name"]),
            *_fields(BooleanType(), ["gate_7_pf01548", "gate_7_pf02371", "gate_7_pass"]),
            *_fields(StringType(), ["protein_sequence"]),
        ]
    )


EMBEDDINGS = StructType(
    [StructField("uniprot_acc", StringType()), StructField("embedding", ArrayType(FloatType()))]
)
MUTATIONS = "array<struct<position:int,wt_aa:string,mut_aa:string,ddg_pred:double>>"
PREDICTIONS = "id string, statement string, threshold string"
BINDERS = "design_id string, pos int, allele string, peptide string, rank_el double, class string"
