"""Readers, writers, plans and streams as round trips in temporary folders."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.plans import funnel, release, triage, variants
from winnow.schemas import catalog_schema
from winnow.session import checkpoint_root, materialise, release as release_frame, scratch_path
from winnow.sources import catalog, fasta, manifest, predictions
from winnow.streaming import incremental as T

# --- session ---------------------------------------------------------------------------------------------------


def test_scratch_is_below_the_checkpoint_folder(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_root(spark) + "/winnow/x-")
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and "winnow/five-" in df.inputFiles()[0]
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    release_frame(df)
    assert not os.path.exists(folder)


def test_executors_can_import_the_package(spark, tmp_path):
    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
from winnow.session import build_session
import winnow.functions.windows as W
spark = build_session("ship", "local[1]", **{"spark.ui.enabled": "false"})
df = spark.createDataFrame([("ABCDEFGHIKLMNPQ",)], "s string")
print("load", df.select(W.window_load("s")["n1"]).first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "load " in done.stdout, done.stderr[-2000:]


# --- catalogs --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_catalog_round_trip_turns_nan_into_null(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None)], "design_id string, score double")
    written = catalog.write_catalog(df, f"{tmp_path}/c", ["design_id", "score", "absent"], fmt)
    assert written == ["design_id", "score"]
    back = catalog.read_catalog(spark, f"{tmp_path}/c", fmt, df.schema)
    assert sorted(tuple(r) for r in back.filter("score IS NOT NULL").collect()) == [("a", 1.0)] and back.count() == 3
    if fmt == "parquet":
        plan = back.filter("score >= 0.5")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(score), GreaterThanOrEqual(score,0.5)]" in plan


def test_missing_catalog_has_a_hint(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="write_catalog"):
        catalog.read_catalog(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, f"{tmp_path}/none", "xml")


def test_catalog_schema_and_registries(spark):
    assert len(catalog_schema().names) == 27
    sizes = {n: catalog.load_registry(spark, n).count() for n in ("scaffolds", "modules", "cores", "guides", "linkers", "weights", "predictions", "alleles", "geometry")}
    assert sizes == {"scaffolds": 12, "modules": 14, "cores": 5, "guides": 3, "linkers": 2, "weights": 15, "predictions": 5, "alleles": 7, "geometry": 3}
    with pytest.raises(ValueError):
        catalog.load_registry(spark, "other")


def test_user_registry_is_typed(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "X", "total_aa": 304}\n')
    assert catalog.read_registry(spark, str(tmp_path / "r.json"), "id string, total_aa int").first()["total_aa"] == 304


def test_records_keep_nulls_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("b", float("nan")), ("a", 0.95)], "design_id string, score double")
    catalog.write_records_json(df, f"{tmp_path}/j")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()]
    assert sorted(lines, key=str) == [{"design_id": "a", "score": 0.95}, {"design_id": "b", "score": None}]
    catalog.write_summary(df, f"{tmp_path}/s", "design_id", {"n_up": F.count_if(F.col("score") > 0.9)}, limit=0.9)
    row = json.loads(spark.read.text(f"{tmp_path}/s/summary").first().value)
    assert row["n_designs"] == 2 and row["limit"] == 0.9
    assert [json.loads(r.value)["design_id"] for r in spark.read.text(f"{tmp_path}/s/ids").collect()] == ["a", "b"]


# --- FASTA -----------------------------------------------------------------------------------------------------


def test_fasta_variants(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x [strategy=A] [score=0.92] n_mut=3\nABC\nDEF\n>y\n\n>z tag=1 tag=2\r\nGH\r\nI\r\n")
    (tmp_path / "b.fasta").write_text("# only a comment\n# and another\n")
    (tmp_path / "c.fasta").write_text("# preamble\nfree text\n>w first=1\nQQ\n>#2 odd\nGGGG\n>;3\nTT\n")
    rows = {r["id"]: r for r in fasta.parse_header_tags(fasta.read_fasta(spark, str(tmp_path))).collect()}
    assert {k: r["sequence"] for k, r in rows.items()} == {"x": "ABCDEF", "y": "", "z": "GHI", "w": "QQ", "#2": "GGGG", ";3": "TT"}
    assert rows["x"]["tags"] == {"strategy": "A", "score": "0.92", "n_mut": "3"} and rows["z"]["tags"] == {"tag": "1"}


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "M" * 130, 0.5), ("b", "K" * 60, 0.25), ("c", None, 0.1), ("d", "", 0.1)], "id string, s string, score double")
    fasta.write_fasta(df, f"{tmp_path}/f", "id", "s", [("score", "score", "%.4f")])
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/f").collect())
    assert max(len(line) for line in text.splitlines()) == 60
    back = fasta.parse_header_tags(fasta.read_fasta(spark, f"{tmp_path}/f"), tags=["score"])
    assert sorted((r["id"], len(r["sequence"]), r["score"]) for r in back.collect()) == [("a", 130, "0.5000"), ("b", 60, "0.2500")]


# --- manifests -------------------------------------------------------------------------------------------------


def test_manifest_and_verification(spark, tmp_path):
    import hashlib

    for name, body in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.txt", b"three")):
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    made = manifest.checksum_manifest(spark, f"{tmp_path}/r")
    assert {r["path"]: r["sha256"] for r in made.collect()}["sub/b.txt"] == hashlib.sha256(b"two").hexdigest()
    manifest.write_manifest(made, f"{tmp_path}/m")
    (tmp_path / "r/a.txt").write_bytes(b"changed")
    (tmp_path / "r/c.txt").unlink()
    (tmp_path / "r/new.txt").write_bytes(b"x")
    again = manifest.checksum_manifest(spark, f"{tmp_path}/r")
    status = manifest.verify_checksums(again, manifest.read_manifest(spark, f"{tmp_path}/m"))
    assert dict(tuple(r) for r in status.collect()) == {"a.txt": "mismatched", "sub/b.txt": "ok", "c.txt": "missing", "new.txt": "extra"}


# --- predictor outputs -----------------------------------------------------------------------------------------


def atom(serial, name, res, x, y, z, b):
    return f"ATOM  {serial:5d} {name:^4s} ALA A{res:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00{b:6.2f}"


def test_structure_atoms(spark, tmp_path):
    lines = [atom(1, "N", 1, 0, 0, 0, 1), atom(2, "CA", 1, 1, 2, 3, 90.5), atom(3, "CA", 2, -1, 0, 0.5, 70), atom(4, "CA", 1, 9, 9, 9, 1), "ATOM      5  CA  ALA A xxx", "TER"]
    (tmp_path / "d_1.pdb").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in predictions.read_structure_atoms(spark, str(tmp_path)).collect())
    assert got == [("d_1", 1, 1.0, 2.0, 3.0, 90.5), ("d_1", 2, -1.0, 0.0, 0.5, 70.0)]


def test_confidence_json(spark, tmp_path):
    bodies = {
        "a": {"plddt": [0.5, 0.7], "ptm": 0.8},
        "b": {"complex_plddt": 71.5, "chains_ptm": [0.4, 0.1]},
        "c": {"plddt": 0.9, "chains_ptm": {"0": 0.3}},
        "d": {"plddt": []},
        "e": {"plddt": 1.0, "complex_ptm": 0.6},
    }
    for name, body in bodies.items():
        path = tmp_path / name / f"{name}.json"
        path.parent.mkdir()
        path.write_text(json.dumps(body, indent=1))
    got = {r["design_id"]: (r["mean_plddt"], r["ptm"]) for r in predictions.read_confidence_json(spark, str(tmp_path)).collect()}
    assert {k: tuple(round(x, 6) for x in v) for k, v in got.items()} == {"a": (60.0, 0.8), "b": (71.5, 0.4), "c": (90.0, 0.3), "d": (0.0, 0.0), "e": (100.0, 0.6)}


def test_binder_output(spark, tmp_path):
    def line(pos, allele, rank, n):
        tokens = [str(pos), allele, "PEPTIDE"] + ["x"] * n
        tokens[12 if n > 9 else 8] = str(rank)
        return "  " + "  ".join(tokens)

    one = ["# comment", "-----", "Pos HLA short", line(1, "A", 0.4, 12), line(1, "A", 0.1, 12), line(2, "A", 0.5, 12), line(3, "A", "bad", 12), line("x", "A", 0.1, 12)]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "d.txt").write_text("\n".join(one))
    got = predictions.read_binder_output(spark, f"{tmp_path}/i", "I").collect()
    assert [(r["pos"], r["rank_el"]) for r in got] == [(1, 0.4)]
    (tmp_path / "ii").mkdir()
    (tmp_path / "ii" / "d.txt").write_text("\n".join([line(4, "B", 10.0, 7), line(5, "B", 10.5, 7)]))
    assert [r["pos"] for r in predictions.read_binder_output(spark, f"{tmp_path}/ii", "II").collect()] == [4]


def test_domain_hits(spark, tmp_path):
    (tmp_path / "acc.tbl").write_text("# head\nPF01548.21 x q - 1e-30 9\nshort line\nPF02371.1 x q - none 9\n")
    assert [tuple(r) for r in predictions.read_domain_hits(spark, str(tmp_path)).collect()] == [("acc", "PF01548", 1e-30)]


# --- plans -----------------------------------------------------------------------------------------------------


def source_rows(spark):
    rows = [(f"ACC{i:06d}", "M" * (190 + i), 190 + i, f"Genus{i % 3} sp", 0.80 + i / 200, True, i != 20) for i in range(30)]
    return spark.createDataFrame(rows, "accession string, sequence string, length int, organism string, composite_prob double, composite boolean, is110_reclassified boolean")


def test_funnel(spark, tmp_path):
    out = funnel.ortholog_funnel([("main", source_rows(spark)), ("more", source_rows(spark))], max_per_genus=2)
    rows = sorted(out.collect(), key=lambda r: r["design_id"])
    assert [r["design_id"] for r in rows] == [f"B_{i + 1:03d}_ACC00002"[:14] for i in range(6)]
    assert {r["source"] for r in rows} == {"main"} and all(r["gate_6_pass"] is None for r in rows)
    assert [r["composite_prob"] for r in rows] == sorted((r["composite_prob"] for r in rows), reverse=True)
    funnel.write_funnel(out, f"{tmp_path}/f")
    assert fasta.read_fasta(spark, f"{tmp_path}/f/candidates_fasta").count() == 6


def designs(spark):
    rows = [(f"{s}{i}", s, K.CLASS_FREE, True, 60.0 + i, "MKT" * (80 + i)) for s in "ABCD" for i in range(4)]
    return spark.createDataFrame(rows, "design_id string, strategy string, tier_a string, composite boolean, mean_plddt double, protein_sequence string")


def test_triaged_ranking_and_release(spark, tmp_path):
    scored = triage.score_and_triage(designs(spark))
    assert scored.count() == 16
    assert triage.triaged_ranking(designs(spark), 5, guaranteed=True).select("strategy").distinct().count() >= 3
    assert triage.triaged_ranking(designs(spark), 6).count() == 6
    full = scored.withColumn("protein_length_aa", F.length("protein_sequence"))
    stored = release.release_catalog(full, f"{tmp_path}/r", threshold=0.5)
    assert stored.count() == 16
    listed = manifest.read_manifest(spark, f"{tmp_path}/r/manifest")
    assert listed.filter("path LIKE 'all_designs_fasta/%'").count() >= 1
    tags = fasta.parse_header_tags(fasta.read_fasta(spark, f"{tmp_path}/r/all_designs_fasta"), tags=["strategy"])
    assert tags.groupBy("strategy").count().filter("count = 4").count() == 4
    table = release.expression_table(full, full.limit(1), 0.5)
    row = table.filter("in_top").first()
    assert row["orf"].startswith("GCCACCATG") and row["mass_kda"] == len(row["protein_sequence"]) * 110 / 1000
    assert release.expression_axes(full, 0.5).count() == 7 * table.count()


def test_migration(spark, tmp_path):
    report = release.write_migration(designs(spark), f"{tmp_path}/m", 16)
    assert all(r["passed"] for r in report.collect())
    assert len(spark.read.parquet(f"{tmp_path}/m/catalog").columns) == 27


def test_structure_triage(spark):
    results = spark.createDataFrame([("a", "A", 300, 80.0, 0.9), ("b", "B", 300, 90.0, 0.6), ("c", "B", 300, 90.0, 0.4), ("d", "A", 5, 72.0, 0.9)], "design_id string, strategy string, seq_len int, mean_plddt double, ptm double")
    rows = [(d, r, 0.0, 0.0, 0.0, b) for d, b in (("a", 74.9), ("b", 75.0)) for r in range(1, 301)]
    atoms = spark.createDataFrame(rows, "design_id string, res_seq int, x double, y double, z double, b double")
    out = {r["design_id"]: r for r in triage.structure_triage(results, atoms).collect()}
    assert set(out) == {"a", "b", "d"} and not out["a"]["pass_active_site"] and out["b"]["pass_active_site"]
    assert out["d"]["cat_residues_sampled"] == -1 and out["d"]["active_site_plddt"] == 72.0
    picked = triage.structure_triage(results, atoms, {"A": "all", "B": 1})
    assert sorted(r["design_id"] for r in picked.collect()) == ["a", "b", "d"]


def test_variant_selection(spark):
    change = "struct<position:int,wt_aa:string,mut_aa:string,ddg_pred:double>"
    wild = "MWFLLIVWWFYLLKKWWFLLIVWWFY"
    rows = [("v1", [(2, "W", "A", 1.0)]), ("v2", [(2, "W", "A", 0.5)]), ("v3", [(2, "W", "A", 1.0), (3, "F", "D", 1.0)])]
    df = spark.createDataFrame(rows, f"variant_id string, mutations_introduced array<{change}>")
    out = sorted(variants.select_variants(df, 5, wild_type=wild).collect(), key=lambda r: r["variant_id"])
    assert [r["variant_id"] for r in out] == ["C_001", "C_002"]
    assert {r["predicted_ddg_total"] for r in out} == {0.5, 2.0}
    assert all(r["n_mhc_i_epitopes_removed"] >= 0 for r in out)
    loads = spark.createDataFrame([("v1", 5, 52)], "variant_id string, n1 int, n2 int")
    row = variants.score_variants(df.filter("variant_id = 'v1'"), wild_type=wild, loads=loads).first()
    assert (row["predicted_s_immuno"], row["predicted_s_immuno_delta"], row["passes_gain"]) == (0.8777, 0.1183, True)
    assert (row["n_mhc_i_epitopes_removed"], row["n_mhc_ii_epitopes_removed"]) == (10, 40)


def test_write_chimeras(spark, tmp_path):
    lengths = {"IS621": 342, "Cre": 343, "IscB": 400, "Bxb1": 500, "phiC31": 613, "CAST_VK": 600}
    library = variants.chimera_library(spark.createDataFrame([(k, "A" * n) for k, n in lengths.items()], "id string, sequence string"))
    variants.write_chimeras(library, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c/manifest/summary").first()["n_designs"] == 30


# --- streams ---------------------------------------------------------------------------------------------------

EVENTS = "id int, v double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_score_reads_new_files_only(spark, tmp_path):
    src, sink, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    put(spark, src, "a", [(1, 1.0), (2, -1.0)])

    def run():
        T.drain(T.incremental_score(T.read_new_files(spark, src, EVENTS), lambda d: d.filter("v > 0"), sink, ck))
        return sorted(r["id"] for r in spark.read.parquet(sink).collect())

    assert run() == [1] and run() == [1]
    put(spark, src, "b", [(3, 1.0)])
    assert run() == [1, 3]


def test_upsert_skips_known_ids_and_replays(spark, tmp_path):
    src, table = f"{tmp_path}/in", f"{tmp_path}/table"
    put(spark, src, "a", [(1, 1.0), (1, 2.0), (2, 1.0)])

    def run(checkpoint):
        stream = T.read_new_files(spark, src, EVENTS)
        T.drain(T.foreach_batch_upsert(stream, lambda d: d, table, f"{tmp_path}/{checkpoint}", "id"))
        return sorted(r["id"] for r in spark.read.parquet(table).collect())

    assert run("ck") == [1, 2]
    put(spark, src, "b", [(2, 5.0), (3, 1.0)])
    assert run("ck") == [1, 2, 3]
    assert run("ck") == [1, 2, 3]
    # another checkpoint counts its batches from 0 again, and reads both files once more
    put(spark, src, "c", [(3, 5.0), (100, 1.0), (101, 1.0)])
    assert run("other") == [1, 2, 3, 100, 101]
    put(spark, src, "d", [(100, 5.0), (102, 1.0)])
    assert run("ck") == [1, 2, 3, 100, 101, 102]


def test_upsert_keeps_all_rows_of_two_sources(spark, tmp_path):
    table = f"{tmp_path}/table"
    for name, ids in (("a", range(5)), ("b", range(100, 103))):
        put(spark, f"{tmp_path}/{name}", "f", [(i, 1.0) for i in ids])
        stream = T.read_new_files(spark, f"{tmp_path}/{name}", EVENTS)
        T.drain(T.foreach_batch_upsert(stream, lambda d: d, table, f"{tmp_path}/ck-{name}", "id"))
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [*range(5), 100, 101, 102]


def test_upsert_does_not_hide_a_table_without_the_key(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "other").write.parquet(f"{tmp_path}/table")
    put(spark, f"{tmp_path}/in", "f", [(1, 1.0)])
    stream = T.read_new_files(spark, f"{tmp_path}/in", EVENTS)
    with pytest.raises(Exception):
        T.drain(T.foreach_batch_upsert(stream, lambda d: d, f"{tmp_path}/table", f"{tmp_path}/ck", "id"))


class _Bare:
    """Just enough of a session to ask for the scratch folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})()


def test_unset_folder_is_refused_on_a_cluster():
    bare = _Bare("local[2]")
    assert checkpoint_root(bare) == checkpoint_root(bare)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Bare("yarn"))


def test_hypothesis_report_agrees_with_single_tests(spark):
    from winnow.operators import checks as V

    scored = triage.score_and_triage(designs(spark)).withColumn("protein_length_aa", F.length("protein_sequence"))
    scored = scored.withColumn("genus", F.lit("G"))
    got = {r["test_id"]: r["verdict"] for r in release.hypothesis_results(scored).collect()}
    single = [
        V.hypothesis_count_above(scored),
        V.hypothesis_existence(scored),
        V.hypothesis_best_gain(scored),
        V.hypothesis_survivors(scored),
        V.hypothesis_diversity(scored),
    ]
    assert got == {r["test_id"]: r["verdict"] for t in single for r in t.select("test_id", "verdict").collect()}
    empty = {r["test_id"]: r["verdict"] for r in release.hypothesis_results(scored.limit(0)).collect()}
    assert empty["H3"] == "NOT_EVALUABLE" and empty["H1"] == "FAIL"
