"""Gates, joins, aggregates, ranking, sets and checks on small frames with nulls, ties and empty input."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.operators import aggregates as A
from winnow.operators import checks as V
from winnow.operators import gates as G
from winnow.operators import joins as J
from winnow.operators import neighbours as N
from winnow.operators import numbering as R1
from winnow.operators import ranking as R
from winnow.operators import scoring as P
from winnow.operators import sets as U
from winnow.sources.catalog import load_registry

FEW = {"max_examples": 6, "deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}


def tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


# --- scoring ---------------------------------------------------------------------------------------------------


def test_normalize_columns_keeps_existing_targets(spark):
    df = spark.createDataFrame([("a", 1, 2)], "accession string, length int, protein_length_aa int")
    assert P.normalize_columns(df).columns == ["uniprot_acc", "length", "protein_length_aa"]
    assert P.first_present(df, ["x", "length"]) == "length" and P.first_present(df, ["x"]) is None


def test_rescore_defaults_and_unrounded_flags(spark):
    df = spark.createDataFrame([("d1", "C", 0.8777, 0.792)], "design_id string, strategy string, S_Immuno double, S_Mature double")
    row = P.rescore(df).first()
    old = 0.25 + 0.9891 * 0.1 + 0.2 + 0.94 * 0.15 + 0.8777 * 0.1 + 0.15 + 0.792 * 0.05
    assert row["score_v010"] == round(old, 4) and row["S_Energy_v012"] == 1.0 and row["parent_editor"] == ""
    assert row["beats_v010_lockpoint"] and len(row) == 25


def test_contributions_sum_to_score_and_deltas(spark):
    df = spark.createDataFrame([("a", *[0.1 * i for i in range(7)]), ("b", *[None] * 7)], "design_id string, " + ", ".join(f"{x} double" for x in K.AXES))
    sums = P.axis_contributions(df, "design_id").groupBy("design_id").agg(F.sum("contribution").alias("s"))
    scores = P.weighted_score(df).select("design_id", "score")
    for r in sums.join(scores, "design_id").collect():
        assert r["s"] == pytest.approx(r["score"])
    delta = P.contribution_delta(df, "design_id").groupBy("design_id").agg(F.sum("delta").alias("s"))
    both = P.rescore(df).join(delta, "design_id").filter("design_id = 'a'").first()
    assert both["s"] == pytest.approx(both["score_v012"] - both["score_v010"], abs=2e-4)


def test_score_batch_rows(spark):
    rows = [
        ("A_1", "A_domain_swap", K.CLASS_FREE, 1.0, True, 1.0, None, "M" * 260),
        ("C_1", "C_deimm", K.CLASS_FREE, 1.0, True, 1.0, 0.8777, "M" * 260),
        ("C_2", "C_deimm", K.CLASS_FREE, 1.0, True, 1.0, None, "W" * 260),
        ("B_1", "B_ortholog", K.CLASS_NUCLEASE, 0.5, False, 0.5, None, "G" * 20),
    ]
    schema = "design_id string, strategy string, tier_a string, tier_a_confidence double, composite boolean, composite_prob double, predicted_s_immuno double, protein_sequence string"
    out = {r["design_id"]: r for r in P.score_batch(spark.createDataFrame(rows, schema), parent_sequence="M" * 260).collect()}
    assert out["C_1"]["S_Mature"] == 0.792 and out["C_2"]["S_Mature"] == 0.0  # no identity to the parent
    assert out["C_1"]["score"] == round(0.25 + 0.1 + 0.2 + 0.15 + 0.08777 + 0.15 + 0.0396, 4)
    assert out["C_1"]["beats_lockpoint"] and out["B_1"]["S_DSB"] == 0.0 and out["B_1"]["S_Spec"] == 0.5
    assert out["C_2"]["S_Immuno"] == 0.7594
    assert out["B_1"]["S_Immuno"] == round(0.7594 * (1 + 0.7594 * 0.1), 4)


def test_score_batch_without_optional_columns(spark):
    out = P.score_batch(spark.createDataFrame([("x", "MK")], "design_id string, protein_sequence string")).first()
    assert out["S_Cargo"] == 1.0 and out["S_Prog"] == 1.0 and out["S_Mature"] == 0.0


def test_migration_helpers(spark):
    df = spark.createDataFrame([("IS622",), ("X",)], "parent_editor string")
    assert ids(P.rename_values(df, "parent_editor"), "parent_editor") == ["ISCro4", "X"]
    assert P.count_values(df, "parent_editor", ["IS622"]).first()[0] == 1


# --- gates -----------------------------------------------------------------------------------------------------

SCHEMA = "id string, strategy string, mean_plddt double, ddg_kcal_mol double, active_site_pass boolean, tier_a string, score double"
ROWS = [
    ("ok", "A", 50.0, 5.0, True, K.CLASS_FREE, 0.0),
    ("low", "A", 49.9, 5.0, True, K.CLASS_FREE, 0.5),
    ("nan", "B", float("nan"), 1.0, True, K.CLASS_FREE, 0.5),
    ("noddg", "B", 80.0, None, True, K.CLASS_FREE, 0.5),
    ("nosite", "C", 80.0, 1.0, None, K.CLASS_FREE, 0.5),
    ("badsite", "C", 80.0, 1.0, False, K.CLASS_FREE, 0.5),
    ("label", "D", 80.0, 1.0, True, None, 0.5),
    ("noscore", "D", 80.0, 1.0, True, K.CLASS_FREE, None),
]


def test_triage_null_rules_and_first_failure(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(ids(G.apply_gates(df, G.TRIAGE_GATES))) == ["nosite", "ok"]
    failed = dict(tuples(G.apply_gates(df, G.TRIAGE_GATES, "annotate"), "id", "first_failed_gate"))
    assert failed == {"ok": None, "low": "A", "nan": "A", "noddg": "B", "nosite": None, "badsite": "C", "label": "D", "noscore": "E"}


def test_missing_gate_columns_skip_or_fail(spark):
    df = spark.createDataFrame([("a", 80.0)], "id string, mean_plddt double")
    active, skipped = G.resolve_gates(df, G.TRIAGE_GATES)
    assert [g.name for g, _ in active] == ["A"] and skipped == ["B", "C", "D", "E"]
    assert ids(G.apply_gates(df, G.TRIAGE_GATES)) == ["a"]
    with pytest.raises(ValueError, match="needs one of the columns"):
        G.apply_gates(df, G.STRUCTURE_GATES)


def test_funnel_is_monotone_and_modes_list_empty_strata(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    report = G.funnel_report(df, G.TRIAGE_GATES).orderBy("step").collect()
    assert [r["n_output"] for r in report] == [6, 5, 4, 3, 2]
    assert all(a["n_output"] == b["n_input"] for a, b in zip(report, report[1:]))
    modes = tuples(G.failure_modes(df, G.TRIAGE_GATES, "strategy"), "strategy", "failure_mode", "n_failed", "is_total")
    assert ("A", "A", 1, False) in modes and ("A", "B", 0, False) in modes and (None, "A", 2, True) in modes
    assert len(modes) == 25
    assert G.funnel_report(df.limit(0), G.TRIAGE_GATES).first()["n_output"] == 0


def test_standalone_filters(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert "noddg" in ids(G.filter_ddg(df)) and G.filter_ddg(df.drop("ddg_kcal_mol")).count() == 8
    classes = spark.createDataFrame([("a", K.CLASS_FREE, 0.8), ("b", K.CLASS_FREE, 0.79), ("c", K.CLASS_UNKNOWN, 1.0), ("d", K.CLASS_FREE, float("nan"))], "id string, tier_a string, tier_a_confidence double")
    assert ids(G.filter_class(classes)) == ["a"]
    share = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.76), ("d", None)], "id string, i double")
    assert ids(G.identity_range(share, "i")) == ["a", "b", "d"] and ids(G.identity_range(share, "i", on_null="drop")) == ["a", "b"]
    assert ids(G.size_gate(spark.createDataFrame([("a", 250), ("b", 1200), ("c", 249), ("d", None)], "id string, total_aa int"))) == ["a", "b"]
    assert ids(G.has_sequence(spark.createDataFrame([("a", "M"), ("b", ""), ("c", None)], "id string, protein_sequence string"))) == ["a"]


def test_domain_gates(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "acc string")
    hits = spark.createDataFrame([("a", "PF01548", 1e-20), ("a", "PF02371", 1e-11), ("b", "PF01548", 1e-20), ("b", "PF02371", 1e-10)], "acc string, family string, e_value double")
    assert ids(G.domain_gate_hits(df, hits, "acc"), "acc") == ["a"]
    proxy = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "acc string, ok boolean")
    assert ids(G.domain_gate_proxy(proxy, "ok"), "acc") == ["a"]
    skipped = G.skip_gate(df, "6", "distance")
    assert skipped.count() == 3 and skipped.first()["gate_6_pass"] is None


def test_prefilter_and_confidence(spark):
    df = spark.createDataFrame([("a", 49.96), ("b", 50.0), ("c", None)], "id string, esmfold_plddt double")
    rows = {r["id"]: r for r in G.prefilter(df).collect()}
    assert rows["a"]["esmfold_pass"] is False and rows["a"]["esmfold_discard_reason"] == "mean pLDDT 50.0 < 50.0"
    assert rows["b"]["esmfold_pass"] and rows["c"]["esmfold_pass"] is None
    gate = G.confidence_gate(spark.createDataFrame([(70.0, 0.5), (69.0, 0.9), (None, 0.9)], "mean_plddt double, ptm double"))
    assert [r["pass_gate5"] for r in gate.collect()] == [True, False, False]


def test_selections(spark):
    df = spark.createDataFrame([("a", "A", 0.9, "Vibrio X", True), ("b", "A", 0.9, None, False), ("c", "B", 0.5, "vibrio y", False)], "design_id string, strategy string, score double, organism string, beats_lockpoint boolean")
    assert ids(G.filter_strategy(df, "A"), "design_id") == ["a", "b"]
    for bad in ("Z", "C"):
        with pytest.raises(ValueError):
            G.filter_strategy(df, bad)
    assert ids(G.search(df, "VIBRIO"), "design_id") == ["a", "c"]
    assert ids(G.search(df, "", beaters_only=True), "design_id") == ["a"]
    assert ids(G.search(df, "", sort="score", ascending=True), "design_id") == ["c", "a", "b"]
    assert ids(G.select_designs(df, "A", top_k=1), "design_id") == ["a"]


# --- joins -----------------------------------------------------------------------------------------------------


def test_enrich_metadata(spark):
    df = spark.createDataFrame([("a", 10, "G sp"), ("b", None, None), ("c", None, "H x"), (None, None, None)], "uniprot_acc string, protein_length_aa int, organism string")
    meta = spark.createDataFrame([("a", 99, "No"), ("b", 20, "Q z")], "uniprot_acc string, protein_length_aa int, organism string")
    got = tuples(J.enrich_metadata(df, meta), "uniprot_acc", "protein_length_aa", "organism", "genus")
    assert got == sorted([("a", 10, "G sp", "G"), ("b", 20, "Q z", "Q"), ("c", None, "H x", "H"), (None, None, "Unknown", "Unknown")], key=str)


def test_membership_done_and_lookup(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    members = spark.createDataFrame([("b",), ("b",)], "k string")
    assert tuples(J.membership_flag(df, members, "k", "f"), "k", "f") == [("a", False), ("b", True), ("c", False)]
    assert sorted(ids(J.skip_done(df, [members, members.limit(0)], "k"), "k")) == ["a", "c"]
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert J.lookup_required(df, dim, "k").count() == 3
    with pytest.raises(Exception, match="unknown k: c"):
        J.lookup_required(df, dim.limit(2), "k").collect()


def test_compare_versions_keeps_both_sides(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 2.5), (3, 3.0)], "k int, v double")
    assert tuples(J.compare_versions(old, new, "k", ["v"]), "k", "v_delta") == [(1, None), (2, 0.5), (3, None)]


def atoms(spark, places):
    rows = [(d, r, float(x), 0.0, 0.0, float(b)) for d, r, x, b in places]
    return spark.createDataFrame(rows, "design_id string, res_seq int, x double, y double, z double, b double")


def test_geometry(spark):
    refs = spark.createDataFrame([("R", [1, 2], [(1, 2, 10.0)]), ("S", [5], [])], "reference_id string, residues array<int>, pairs array<struct<r1:int,r2:int,dist:double>>")
    df = spark.createDataFrame([("near", "R"), ("far", "R"), ("part", "R"), ("none", "R"), ("lone", "S"), ("weak", "S")], "design_id string, reference_id string")
    a = atoms(spark, [("near", 1, 0, 9), ("near", 2, 11.5, 9), ("far", 1, 0, 9), ("far", 2, 11.6, 9), ("part", 1, 0, 9), ("lone", 5, 0, 50), ("weak", 5, 0, 49)])
    got = {r["design_id"]: r for r in J.check_geometry(df, a, refs).collect()}
    assert got["near"]["active_site_valid"] and got["near"]["active_site_max_dev"] == 1.5
    assert got["far"]["active_site_valid"] is False and got["far"]["active_site_max_dev"] == 1.6
    assert got["part"]["active_site_valid"] is False and got["part"]["active_site_missing_residues"] == [2]
    assert got["none"]["active_site_valid"] is None and got["none"]["active_site_missing_residues"] == []
    assert got["lone"]["active_site_valid"] and got["weak"]["active_site_valid"] is False
    assert got["near"]["catalytic_residue_plddt"] == {1: 9.0, 2: 9.0} and got["part"]["catalytic_residue_plddt"] == {}
    structures = atoms(spark, [("R", 1, 0, 9), ("R", 2, 11.6, 9), ("R", 7, 50, 9)]).withColumnRenamed("design_id", "reference_id")
    own = J.derive_references(refs, structures)
    assert {r["reference_id"]: [tuple(p) for p in r["pairs"]] for r in own.collect()} == {"R": [(1, 2, 11.6)], "S": []}
    got = {r["design_id"]: r for r in J.check_geometry(df, a, own).collect()}
    assert got["near"]["active_site_max_dev"] == 0.1 and got["far"]["active_site_max_dev"] == 0.0


def test_block_product_fills_the_grid_whichever_side_is_small(spark):
    few = spark.range(5).withColumnRenamed("id", "a")
    many = spark.range(400).withColumnRenamed("id", "b")
    for left, right in ((few, many), (many, few)):
        out = J.block_product(left, right, blocks=40)
        assert out.count() == 2000 and out.distinct().count() == 2000


def test_default_chimera_library(spark):
    from winnow.plans.variants import chimera_library

    lengths = {"IS621": 342, "Cre": 343, "Lambda_Int": 356, "IscB": 400, "Bxb1": 500, "phiC31": 613, "CAST_VK": 600}
    out = chimera_library(spark.createDataFrame([(k, "A" * n) for k, n in lengths.items()], "id string, sequence string"))
    rows = sorted(out.collect(), key=lambda r: r["design_id"])
    assert len(rows) == 30 and rows[0]["design_id"] == "A_001_IS621_full_composite_IS621_bRNA_rigid"
    assert min(r["total_aa"] for r in rows) == 262 and max(r["total_aa"] for r in rows) == 110 + 111 + 600 + 20
    first = rows[0]
    assert [m["position_in_chimera"] for m in first["modules_used"]] == [1, 2, 3]
    assert [(x["junction_index"], x["sequence"]) for x in first["linkers"]] == [(1, "EAAAKEAAAK"), (2, "EAAAKEAAAK")]
    assert first["provenance"]["sequence_repeat"] and first["guide_template"] == K.GUIDE_RULES[0][1]


def test_slice_clamps_to_length(spark):
    seqs = spark.createDataFrame([("s", "ABCDEFG")], "id string, sequence string")
    mods = spark.createDataFrame([("m", "s", 3, 99), ("n", "s", 2, 3), ("o", "t", 1, 2)], "name string, source_scaffold string, start_residue int, end_residue int")
    assert tuples(J.slice_modules(seqs, mods), "name", "sequence") == [("m", "CDEFG"), ("n", "BC"), ("o", None)]


# --- neighbours ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 1])
def test_novelty_gate(spark, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    e = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0]), ("near", [1.0, 0.1]), ("far", [-1.0, -1.0]), ("zero", [0.0, 0.0])], "uniprot_acc string, embedding array<double>")
    known = spark.createDataFrame([("k1",), ("k2",), ("absent",)], "uniprot_acc string")
    df = spark.createDataFrame([("near",), ("far",), ("zero",), ("novector",)], "uniprot_acc string")
    got = tuples(N.novelty_gate(df, e, known), "uniprot_acc", "gate_6_distance", "gate_6_pass")
    assert got == [("far", 1.7071, True), ("novector", None, None), ("zero", 1.0, True)]
    nothing = N.novelty_gate(df, e, known.limit(0))
    assert nothing.count() == 4 and nothing.filter("gate_6_pass IS NOT NULL").count() == 0


@settings(**FEW)
@given(st.lists(st.text(alphabet="ABé", max_size=6), max_size=7))
def test_mean_pairwise_identity_matches_pairs(spark, texts):
    values = []
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            longest = max(len(a), len(b))
            values.append(sum(x == y for x, y in zip(a, b)) / longest if longest else 0.0)
    got = N.mean_pairwise_identity(spark.createDataFrame([(t,) for t in texts], "s string"), "s").first()
    assert got["n_pairs"] == len(values)
    assert got["mean_identity"] == (pytest.approx(sum(values) / len(values)) if values else None)


# --- ranks and medians -----------------------------------------------------------------------------------------


@settings(**FEW)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=30))
def test_medians_match_sorting(spark, rows):
    df = spark.createDataFrame([(g, None if v is None else v / 2) for g, v in rows], "g string, v double")
    expected = {}
    for g in {g for g, _ in rows}:
        values = sorted(v / 2 for k, v in rows if k == g and v is not None)
        if values:
            n = len(values)
            expected[g] = (values[(n - 1) // 2] + values[n // 2]) / 2
    got = {r["g"]: r["median"] for r in R1.medians(df, ["g"], "v").collect() if r["median"] is not None}
    assert got == expected


def test_rank_in_group_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    expected = {}
    for g in {r[1] for r in rows}:
        part = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        expected.update({r[0]: i + 1 for i, r in enumerate(part)})
    for narrow in ({}, {"order_columns": ["v", "id"]}):
        got = R1.rank_in_group(df, ["g"], order, **narrow)
        assert got.columns == ["id", "g", "v", "rank"]
        assert {r["id"]: r["rank"] for r in got.collect()} == expected
    overall = sorted(r["rank"] for r in R1.rank_in_group(df, [], order).collect())
    assert overall == list(range(1, 601))


def test_assign_ids(spark):
    df = spark.createDataFrame([("ACCESSION1", 0.9), ("B", 0.95), ("C", 0.9)], "acc string, p double")
    got = R1.assign_ids(df, "B", "acc", [F.desc("p"), F.asc("acc")])
    assert sorted(ids(got, "design_id")) == ["B_001_B", "B_002_ACCESSIO", "B_003_C"]


# --- aggregates ------------------------------------------------------------------------------------------------


def test_breakdown_and_statistics(spark):
    df = spark.createDataFrame([("A", 0.93, 10, "g"), ("A", 0.5, 20, "h"), ("B", None, None, None), ("A", float("nan"), 30, "g")], "strategy string, score double, protein_length_aa int, genus string")
    got = tuples(A.strategy_breakdown(df), "strategy", "n", "n_beating", "best", "median")
    assert got == [("A", 3, 1, 0.93, pytest.approx(0.715)), ("B", 1, 0, None, None)]
    row = A.subset_statistics(df.filter("strategy = 'A'")).first()
    assert (row["length_min"], row["length_max"], row["length_median"], row["n_genera"]) == (10, 30, 20.0, 2)
    assert A.subset_statistics(df.limit(0)).count() == 0


def test_best_row_ties_and_missing(spark):
    df = spark.createDataFrame([("A", "y", 1.0), ("A", "x", 1.0), ("A", "z", float("nan")), ("B", "w", None)], "s string, id string, v double")
    assert tuples(A.best_row(df, ["s"], "v", "id", ["v", "id"]), "s", "id", "v")[0] == ("A", "x", 1.0)


def test_positions_summary_and_binders(spark):
    a = atoms(spark, [("d", 11, 0, 80), ("d", 60, 0, 60), ("e", 1, 0, 5)])
    wanted = spark.createDataFrame([("d", [11, 60, 99]), ("e", [11])], "design_id string, positions array<int>")
    got = tuples(A.confidence_at_positions(a, wanted), "design_id", "site_mean", "site_min", "site_found")
    assert got == [("d", 70.0, 60.0, 2), ("e", 0.0, 0.0, 0)]
    b = spark.createDataFrame([("d", 1, "I", 0.4), ("d", 1, "I", 0.1), ("d", 2, "I", 0.5), ("d", 3, "II", 10.0), ("e", 1, "II", 10.1)], "design_id string, pos int, class string, rank_el double")
    assert tuples(A.binder_load(b), "design_id", "n1", "n2", "weighted_load") == [("d", 1, 1, 1.5), ("e", 0, 0, 0.0)]


def test_rank_intervals_and_presence(spark):
    df = spark.createDataFrame([("a", "A", 1.0), ("b", "B", 0.5), ("c", "B", 0.49)], "design_id string, strategy string, score double")
    rows = {r["design_id"]: r for r in A.rank_intervals(df, iterations=100).collect()}
    assert rows["a"]["rank_low"] == rows["a"]["rank_high"] == 1.0 and rows["b"]["rank_low"] == 2.0 and rows["c"]["rank_high"] == 3.0
    assert tuples(A.top_presence(df, iterations=50, top=1), "strategy", "top_probability") == [("A", 1.0), ("B", 0.0)]
    again = A.rank_intervals(df.repartition(5), iterations=100).collect()
    assert {r["design_id"]: r for r in again} == rows


def test_ceiling_and_counterfactuals(spark):
    axes = ", ".join(f"{a} double" for a in K.PROFILE_V012)
    df = spark.createDataFrame([("B", 1.0, 0.989, 1.0, 0.9, 0.759, 1.0, 0.0, 1.0)], "strategy string, " + axes)
    assert A.score_ceiling(df).first()["score_ceiling"] == pytest.approx(0.92677)
    row = A.counterfactuals(df, {"mature": {"S_Mature": 1.0}}, threshold=0.93).first()
    assert (row["n_observed"], row["n_scenario"], row["n_more"], row["n_fail_axis_only"]) == (0, 1, 1, 1)


# --- ranking ---------------------------------------------------------------------------------------------------

RELEASED = [("c1", "C", 0.9673), ("c2", "C", 0.9586), ("d1", "D", 0.9353), ("d2", "D", 0.9319), ("d3", "D", 0.9319), ("a1", "A", 0.9209), ("b1", "B", 0.9168)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "design_id string, strategy string, score double")


def test_diverse_top_released_five(spark):
    out = sorted(R.diverse_top(ranked(spark, RELEASED)).collect(), key=lambda r: r["rank"])
    assert [r["design_id"] for r in out] == ["c1", "c2", "d1", "d2", "a1"]
    assert [r["diversity_enforced"] for r in out] == [False] * 4 + [True]


def test_diverse_top_edges(spark):
    few = ranked(spark, RELEASED[:2])
    assert R.diverse_top(few).count() == 2 and R.diverse_top(few.limit(0)).count() == 0
    null = ranked(spark, [("x", None, 1.0), ("y", None, 0.9), ("z", "A", 0.1)])
    assert sorted(ids(R.diverse_top(null, 2, 2), "design_id")) == ["x", "z"]


def test_swap_replaces_fourth_of_a_crowd(spark):
    rows = [(f"d{i}", "D", 1.0 - i / 10) for i in range(6)] + [("a", "A", 0.05), ("b", "B", 0.01)]
    out = {r["design_id"]: r for r in R.swap_top(ranked(spark, rows), "score", "strategy", "design_id").collect()}
    assert [i for i, _ in sorted(((k, r["diversity_rank"]) for k, r in out.items()), key=lambda x: x[1])] == ["d0", "d1", "d2", "d4", "a", "d3", "d5", "b"]
    assert out["a"]["diversity_note"] == "anti_mode_collapse: replaced rank-4 D with A" and out["d3"]["diversity_note"] == ""


def test_swap_leaves_mixed_or_short_tops(spark):
    mixed = ranked(spark, [("a", "A", 5.0), ("b", "A", 4.0), ("c", "A", 3.0), ("d", "B", 2.0), ("e", "B", 1.0), ("f", "C", 0.5)])
    out = R.swap_top(mixed, "score", "strategy", "design_id")
    assert [r["design_id"] for r in sorted(out.collect(), key=lambda r: r["diversity_rank"])] == list("abcdef")
    short = ranked(spark, [(x, "A", float(i)) for i, x in enumerate("abcd")])
    assert R.swap_top(short, "score", "strategy", "design_id").filter("diversity_note <> ''").count() == 0
    lonely = ranked(spark, [(f"a{i}", "A", float(i)) for i in range(9)])
    assert R.enforce_diversity(lonely, 5).count() == 5


def test_pad_can_displace_only_the_newcomer(spark):
    rows = [(f"d{i}", "D", 1.0 - i / 10) for i in range(8)] + [("a", "A", 0.05)]
    out = R.enforce_diversity(ranked(spark, rows), top_k=5, min_per_strategy=5)
    assert [r["design_id"] for r in sorted(out.collect(), key=lambda r: r["diversity_rank"])] == ["d0", "d1", "d2", "d3", "d4"]


def test_caps_and_tiers(spark):
    df = spark.createDataFrame([("a", 0.9, None, "G x"), ("b", 0.9, None, "G y"), ("c", 0.8, "G", None), ("d", 0.1, None, None)], "uniprot_acc string, composite_prob double, genus string, organism string")
    assert tuples(R.cap_per_genus(df, limit=2), "uniprot_acc", "genus") == [("a", "G"), ("b", "G"), ("d", "Unknown")]
    rows = ranked(spark, RELEASED)
    rules = {"A": "all", "B": "all", "C": 1, "D": F.col("score") < 0.9353}
    got = R.tiered_selection(rows, "strategy", rules, R.by_score("score", "design_id"))
    assert sorted(ids(got, "design_id")) == ["a1", "b1", "c1", "d2", "d3"]
    top = R.top_by_product(rows.withColumn("two", F.lit(2.0)), "score", "two", "design_id", 2)
    assert {r["cutoff"] for r in top.collect()} == {2 * 0.9586}


def test_dedupe_variants(spark):
    m = "struct<position:int,mut_aa:string>"
    rows = [("v1", [(1, "A"), (2, "B")], 0.1, 1.0), ("v2", [(2, "B"), (1, "A")], 0.2, 5.0), ("v3", [(1, "C")], 0.2, 1.0)]
    df = spark.createDataFrame(rows, f"variant_id string, mutations_introduced array<{m}>, predicted_s_immuno_delta double, predicted_ddg_total double")
    got = tuples(R.dedupe_variants(df, 5), "variant_id", "predicted_ddg_total")
    assert got == [("C_001", 1.0), ("C_002", 5.0)]


def test_nearest_misses(spark):
    axes = ", ".join(f"{a} double" for a in K.AXES)
    rows = [("a", 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 0.0), ("b", 1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 0.0), ("c",) + (1.0,) * 7]
    df = spark.createDataFrame(rows, "design_id string, " + axes)
    out = R.nearest_misses(P.weighted_score(df)).collect()
    assert [(r["design_id"], r["barrier_axis"]) for r in out] == [("a", "S_Mature"), ("b", "S_Cargo")]
    assert out[0]["margin"] == pytest.approx(0.92 - 0.929)


# --- sets ------------------------------------------------------------------------------------------------------


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3.0), ("z", 4.0)], "k string, b double")
    merged = U.union_sources([("one", a), ("two", b)])
    assert tuples(U.dedupe_by_source(merged, "k", "source", ["two", "one"]), "k", "source") == [("x", "two"), ("y", "one"), ("z", "two")]
    assert ids(U.id_difference(a, b, "k"), "k") == ["y"] and ids(U.id_intersection(a, b, "k"), "k") == ["x"]
    s = spark.createDataFrame([("WT",), ("V",), (None,)], "s string")
    assert U.exclude_recoveries(s, "s", "WT").count() == 2
    assert U.exclude_known_sequences(s, spark.createDataFrame([("V",)], "s string"), "s").count() == 2


# --- hypotheses and checks -------------------------------------------------------------------------------------


def test_hypotheses(spark):
    df = spark.createDataFrame([(f"d{i}", "C" if i < 2 else "D", 0.93 - (i > 4) * 0.003, 0.8777 if i == 0 else 0.7, 1.0, 0.9) for i in range(8)], "design_id string, strategy string, score double, S_Immuno double, S_Cargo double, S_Deliv double")
    h1 = V.hypothesis_count_above(df).first()
    assert (h1["verdict"], h1["n_beating"], h1["n_beating_calibrated"]) == ("PASS", 5, 8)
    assert sorted(ids(V.beaters_calibrated_only(df), "design_id")) == ["d5", "d6", "d7"]
    assert V.hypothesis_existence(df).first()["verdict"] == "PASS"
    h3 = V.hypothesis_best_gain(df).first()
    assert (h3["verdict"], h3["best_design"], h3["delta"]) == ("PASS", "d0", 0.1183)
    assert V.hypothesis_best_gain(df, "Z").first()["verdict"] == "NOT_EVALUABLE"
    h5 = V.hypothesis_diversity(df.withColumn("protein_sequence", F.col("design_id"))).first()
    assert h5["verdict"] == "FAIL" and h5["n_distinct"] == 2 and h5["mean_identity"] == 0.5


@pytest.mark.parametrize(
    "verdicts,text",
    [
        (["PASS"] * 5, "all"),
        (["PASS"] * 4 + ["NOT_EVALUABLE"], "four_evaluated"),
        (["PASS"] * 4, "four_evaluated"),
        (["PASS"] * 4 + ["FAIL"], "four"),
        (["PASS"] * 3 + ["FAIL"], "three"),
        ([], "rework"),
    ],
)
def test_rollup(spark, verdicts, text):
    rows = spark.createDataFrame([(f"H{i + 1}", v) for i, v in enumerate(verdicts)], "test_id string, verdict string")
    assert V.rollup_verdicts(V.hypothesis_registry(spark), rows).first()["policy"] == K.ROLLUP_TEXT[text]


def test_invariants_and_contract(spark):
    df = spark.createDataFrame([("a", True, False, "X"), ("b", None, True, "IS622")], "design_id string, intrinsic_cargo_mechanism boolean, cell_based_evidence boolean, parent_editor string")
    got = {r["check"]: (r["observed"], r["passed"]) for r in V.check_invariants(df, 2, 4).collect()}
    assert got["row_count"] == (2, True) and got["all_true(intrinsic_cargo_mechanism)"] == (1, False)
    assert got["all_false(cell_based_evidence)"] == (1, False) and got["forbidden(parent_editor)"] == (1, False) and got["column_count"][1]
    contract = spark.createDataFrame([("a", "A", 1.1), ("b", "Q", None)], "design_id string, strategy string, score double")
    got = {r["check"]: r["passed"] for r in V.check_contract(contract).collect()}
    assert got == {"required_columns": False, "in_range(score)": False, "allowed(strategy)": False, "no_nulls(score)": False}


def test_profiles(spark):
    rows = tuples(V.validate_profiles(load_registry(spark, "weights")), "profile", "weight_sum", "n_axes", "valid")
    assert rows == [("v010", 1.0, 7, True), ("v012", 1.0, 8, True)]
    assert V.profile_table(spark).count() == 15
