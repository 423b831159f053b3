"""The facade over a data folder."""

import pytest

from winnow import constants as K
from winnow.api import Designer
from winnow.sources.catalog import write_catalog
from winnow.sources.fasta import write_fasta


def test_catalog_and_selection(spark, tmp_path):
    rows = [("a", "A", K.CLASS_FREE, 0.9), ("b", "A", K.CLASS_NUCLEASE, 0.95), ("c", "B", K.CLASS_FREE, 0.8)]
    write_catalog(spark.createDataFrame(rows, "design_id string, strategy string, tier_a string, score double"), f"{tmp_path}/catalog")
    designer = Designer(spark, str(tmp_path))
    assert designer.get_catalog().count() == 3
    assert [r["design_id"] for r in designer.select_designs().collect()] == ["a", "c"]
    assert [r["design_id"] for r in designer.select_designs("A", require_free=False).collect()] == ["b", "a"]


def test_chimeras_use_their_arguments(spark, tmp_path):
    lengths = {"IS621": 342, "Cre": 343, "IscB": 400, "Bxb1": 500, "phiC31": 613, "CAST_VK": 600}
    scaffolds = spark.createDataFrame([(k, "A" * n) for k, n in lengths.items()], "id string, s string")
    write_fasta(scaffolds, f"{tmp_path}/scaffolds", "id", "s")
    designer = Designer(spark, str(tmp_path))
    rows = designer.compose_chimera("phiC31", "IscB_omega").collect()
    assert len(rows) == 2 and {r["provenance"]["catalytic_core"] for r in rows} == {"phiC31_serine"}
    assert designer.compose_chimera("TwinPE", "IscB_omega").count() == 0
    for bad in (("none", "IscB_omega"), ("Cre", "none")):
        with pytest.raises(ValueError, match="available"):
            designer.compose_chimera(*bad)
    assert designer.modules().count() == len(K.MODULES)


def test_orthologs_keep_the_length_gate(spark, tmp_path):
    rows = [("a", 300, "G x", 0.9, True), ("b", 500, "G x", 0.9, True), ("c", None, "G y", 0.7, True), ("d", 300, None, 0.9, False)]
    df = spark.createDataFrame(rows, "accession string, length int, organism string, composite_prob double, composite boolean")
    meta = spark.createDataFrame([("c", 250, "H z")], "uniprot_acc string, protein_length_aa int, organism string")
    designer = Designer(spark, str(tmp_path))
    assert [r["uniprot_acc"] for r in designer.discover_orthologs(df).collect()] == ["a"]
    wide = designer.discover_orthologs(df, meta, min_probability=0.6)
    assert sorted(r["uniprot_acc"] for r in wide.collect()) == ["a", "c"]


def test_redesigns(spark, tmp_path):
    wild = "M" * 10
    rows = [("same", wild), ("near", "M" * 7 + "KKK"), ("far", "K" * 10), ("mid", "M" * 5 + "K" * 5)]
    write_fasta(spark.createDataFrame(rows, "id string, s string"), f"{tmp_path}/d", "id", "s")
    out = Designer(spark, str(tmp_path)).redesign_backbone(f"{tmp_path}/d", wild).collect()
    assert [(r["id"], r["sequence_identity_to_wt"], r["novel_residues_count"]) for r in out] == [("mid", 0.5, 5), ("near", 0.7, 3)]
