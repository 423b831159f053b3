"""Scalar, sequence and window functions on hand-computed values."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions import sequences as Q
from winnow.functions import windows as W
from winnow.functions.sqlfuncs import register_sql

ARROW = {"max_examples": 8, "deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}


def one(spark, expression, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]


def column(df, name="v"):
    return [r[name] for r in df.collect()]


def test_round_exact_follows_the_binary_value(spark):
    rng = random.Random(5)
    values = [1 - (n - 260) / 640 * 0.35 for n in range(261, 900, 3)] + [rng.randint(0, 10**5) / 1e5 for _ in range(500)]
    got = column(spark.createDataFrame([(v,) for v in values], "x double").select(S.round_exact(F.col("x"), 4).alias("v")))
    assert got == [round(v, 4) for v in values]
    odd = [None, float("inf"), float("-inf"), -0.12345, -2.5, 0.5, 1.5, 1e300, 2.0**53 + 2, 0.00005]
    frame = spark.createDataFrame([(v,) for v in odd], "x double")
    assert column(frame.select(S.round_exact(F.col("x"), 4).alias("v"))) == [None if v is None else v if abs(v) > 1e16 else round(v, 4) for v in odd]
    assert column(frame.filter("abs(x) < 3").select(S.round_exact(F.col("x"), 0).alias("v"))) == [round(v) for v in odd if v is not None and abs(v) < 3]


def test_weighted_score_golden_values(spark):
    rows = [(0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (1.0,) * 7, (1.0, 1.0, 1.0, 1.0, 0.8777, 1.0, 0.5), (None,) * 7]
    df = spark.createDataFrame(rows + [(float("nan"),) + (1.0,) * 6], ", ".join(f"{a} double" for a in K.AXES))
    got = column(df.select(S.weighted(K.PROFILE_V010).alias("v")))
    assert got == pytest.approx([0.325, 1.0, 0.96277, 0.0, 0.75])


def test_beats_is_strict(spark):
    df = spark.createDataFrame([(0.930,), (0.929,), (None,), (float("nan"),)], "score double")
    assert column(df.select(S.beats("score").alias("v"))) == [True, False, None, None]
    cal = spark.createDataFrame([(0.926,), (0.9255,)], "score double")
    assert column(cal.select(S.beats("score", K.LOCKPOINT_CALIBRATED).alias("v"))) == [True, False]
    assert S.recalibrated(0.929, 0.7594, 0.7243, 0.10) == pytest.approx(0.92549)


def test_axis_rules(spark):
    labels = spark.createDataFrame(
        [(K.CLASS_FREE, True), (K.CLASS_FREE, False), (K.CLASS_NUCLEASE, True), (K.CLASS_UNKNOWN, True), (None, None)],
        "label string, composite boolean",
    )
    got = labels.select(S.score_class("label"), S.score_cargo("label", "composite"), S.flag_class("label")).collect()
    assert [tuple(r) for r in got] == [
        (1.0, 1.0, "PASS"),
        (1.0, 0.85, "PASS"),
        (0.0, 0.0, "DSB_NUCLEASE_DISCARD"),
        (0.5, 0.0, "UNCLASSIFIED_MANUAL_REVIEW"),
        (0.5, 0.0, "PASS"),
    ]
    lengths = spark.createDataFrame([(n,) for n in (0, 130, 260, 580, 900, 1050, 1200, 1201, None)], "n int")
    assert column(lengths.select(S.score_length("n").alias("v"))) == pytest.approx(
        [0.8, 0.9, 1.0, 0.825, 0.65, 0.325, 0.0, 0.0, None]
    )
    loads = spark.createDataFrame([(15, 92), (5, 52), (400, 0), (None, 3)], "a int, b int")
    assert column(loads.select(S.score_load("a", "b").alias("v"))) == [0.7594, 0.8777, 0.0, None]
    assert one(spark, S.score_density(F.lit(7), F.lit(100))) == pytest.approx(0.8)


def test_immuno_and_maturity(spark):
    df = spark.createDataFrame(
        [(0.5, "B", 10.0), (None, "C_deimm", 10.0), (None, "B", 50.0), (float("nan"), "C_deimm", 1.0)],
        "m double, s string, w double",
    )
    expected = [0.5, 0.7594, 0.7594 * (1 + (0.7594 - 1.0) * 0.1), 0.7594]
    assert column(df.select(S.score_immuno("m", "s", "w").alias("v"))) == pytest.approx(expected)
    rows = [("A_x", None), ("B_x", 1.0), ("C_x", 0.80), ("C_x", 0.79), ("C_x", None), ("D_x", None), ("Z", 1.0)]
    df = spark.createDataFrame(rows, "s string, i double")
    assert column(df.select(S.score_maturity("s", "i").alias("v"))) == [0, 0, 0.792, 0, 0.792, 0.396, 0]


def test_identifiers(spark):
    ids = ["A_001_x", "D001_x", "d8_is621_ProtMPNN_3", "D8PEA4", "IS621_deimm_v2", "Q9ABC", "D9_IS621_x"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert column(df.select(S.strategy_from_id("id").alias("v"))) == ["A", "D", "D", "B", "C", "B", "B"]
    assert column(df.select(S.strategy_from_id("id", "second").alias("v"))) == ["A", "B", "D", "B", "C", "B", "D"]
    rows = [("x", "A"), ("D12_IS621_ProtMPNN_1", "D"), ("D8PEA4", "D"), ("Q9", "B"), ("v", "C")]
    df = spark.createDataFrame(rows, "id string, s string")
    assert column(df.select(S.parent_of("id", "s").alias("v"))) == ["IS621", "IS621", "D8PEA4", "Q9", "IS621"]
    df = spark.createDataFrame([("Homo sapiens",), ("  ",), (None,), ("Vibrio",)], "o string")
    assert column(df.select(S.genus_of("o").alias("v"))) == ["Homo", "Unknown", "Unknown", "Vibrio"]


def test_mutation_cost(spark):
    def cost(wt, mut, cap=5.0):
        polar, mass = set(K.POLAR_RESIDUES), K.RESIDUE_MASS
        step = 0.3 + (0.8 if (wt in polar) != (mut in polar) else 0.0)
        return round(min(step + abs(mass.get(wt, 115) - mass.get(mut, 115)) / 30.0 * 0.5, cap), 2)

    pairs = [(a, b) for a in "GWKDX" for b in "ACDWY"]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert column(df.select(S.mutation_cost("a", "b").alias("v"))) == [cost(a, b) for a, b in pairs]
    changes = F.array(
        F.struct(F.lit("G").alias("wt_aa"), F.lit("W").alias("mut_aa")),
        F.struct(F.lit("K").alias("wt_aa"), F.lit("R").alias("mut_aa")),
    )
    assert one(spark, S.mutation_total(changes)) == pytest.approx(round(0.3 + 2.15 + 0.3 + 28 / 60, 2))
    assert one(spark, S.mutation_total(F.array().cast("array<struct<wt_aa:string,mut_aa:string>>"))) == 0.0


def test_stability_and_measurement(spark):
    df = spark.createDataFrame([(3.1, None), (5.0, 1.0), (None, -0.6), (None, None), (float("nan"), 6.0)], "a double, b double")
    value, method = S.choose_measurement([("first", "a"), ("second", "b")])
    flags = S.stability_flags(value)
    got = [tuple(r) for r in df.select(value, method, *flags.values()).collect()]
    assert got == [
        (3.1, "first", True, False, False),
        (5.0, "first", True, False, False),
        (-0.6, "second", False, False, True),
        (None, "none", False, False, None),
        (6.0, "second", True, True, False),
    ]


def test_rule_tables(spark):
    df = spark.createDataFrame([("IS621_bRNA_extended",), ("omega_RNA_binding",), ("Cas12k_compact_RNP",), ("other",)], "m string")
    assert column(df.select(S.guide_template("m").alias("v"))) == [K.GUIDE_RULES[0][1], K.GUIDE_RULES[1][1], K.GUIDE_RULES[2][1], "N" * 20]
    df = spark.createDataFrame([("GS", 9), ("GS", 1), ("EAAAK", 10), ("x", 5)], "k string, n int")
    assert column(df.select(S.linker_sequence("k", "n").alias("v"))) == ["GGGGS" * 2, "GGGGS", "EAAAK" * 2, None]
    assert column(df.select(S.linker_band("k").alias("v")))[3] == "unknown"


def test_codons_and_orf(spark):
    df = spark.createDataFrame([("MA",), ("mXa",), ("",), (None,), ("M*",)], "s string")
    assert column(df.select(Q.translate_codons("s").alias("v"))) == ["ATGGCC", "ATGNNNGCC", "", None, "ATGTGA"]
    assert one(spark, Q.build_orf(F.lit("MA"))) == "GCCACCATGGCCTGA"
    assert one(spark, Q.build_orf(F.lit("ma"), prefix=False, suffix=False)) == "ATGGCC"
    assert one(spark, Q.build_orf(F.lit("AM"), strict=False)) is None
    for bad in ("AM", ""):
        with pytest.raises(Exception, match="does not start with M"):
            one(spark, Q.build_orf(F.lit(bad)))


def test_dna_scans(spark):
    df = spark.createDataFrame([("GCGCAT",), ("gc",), ("",), (None,)], "s string")
    assert column(df.select(Q.gc_fraction("s").alias("v"))) == pytest.approx([4 / 6, 1.0, 0.0, 0.0])
    df = spark.createDataFrame([("GGATCCGAATTC",), ("aaagaattcaaa",), ("ACGTACGT",)], "s string")
    assert column(df.select(Q.motif_hits("s").alias("v"))) == [["BamHI", "EcoRI"], ["EcoRI"], []]
    assert one(spark, Q.wrap_text(F.lit("A" * 120), 60)) == "A" * 60 + "\n" + "A" * 60
    assert one(spark, Q.wrap_text(F.lit("A" * 61), 60)) == "A" * 60 + "\nA"


def test_kmer_windows_guard_short_texts(spark):
    df = spark.createDataFrame([(1, "ABCD"), (2, "AB"), (3, "ABC"), (4, None)], "id int, s string")
    got = sorted(tuple(r) for r in Q.kmer_windows(df, "id", "s", 3).collect())
    assert got == [(1, 1, "ABC"), (1, 2, "BCD"), (3, 1, "ABC")]


def load_by_hand(text):
    out = []
    for k, limit in (K.WINDOW_CLASS_1, K.WINDOW_CLASS_2):
        w = [K.WINDOW_WEIGHTS.get(c, K.WINDOW_WEIGHT_OTHER) for c in text]
        out.append([i + 1 for i in range(len(text) - k + 1) if sum(w[i : i + k]) > limit * k])
    return out


@settings(**ARROW)
@given(st.lists(st.text(alphabet="ACDEFGHIKLMNPQRSTVWYXéa", max_size=60), min_size=1, max_size=5))
def test_window_load_matches_hand_count(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").withColumn("l", W.window_load("s"))
    for row in df.collect():
        p1, p2 = load_by_hand(row["s"])
        assert (row["l"]["positions1"], row["l"]["positions2"]) == (p1, p2)
        assert (row["l"]["n1"], row["l"]["n2"]) == (len(p1), len(p2))
        assert row["l"]["weighted_load"] == len(p1) + 0.5 * len(p2)


def test_window_load_ties_and_null(spark):
    # nine residues of weight 43 on average are not above the threshold
    tie = "KKKKKKRRR"
    df = spark.createDataFrame([(tie,), (None,), ("",)], "s string").withColumn("l", W.window_load("s"))
    rows = df.collect()
    assert rows[0]["l"]["n1"] == (1 if sum(K.WINDOW_WEIGHTS[c] for c in tie) > 387 else 0)
    assert rows[1]["l"]["n1"] is None and rows[2]["l"]["n1"] == 0


def surface_by_hand(text, frozen):
    core = {i + 1 for i, c in enumerate(text) if c in K.SURFACE_RESIDUES and i + 1 not in frozen}
    wide = core | {p - 1 for p in core} | {p + 1 for p in core}
    return sorted(p for p in wide if 1 <= p <= len(text) and p not in frozen)


@settings(**ARROW)
@given(st.text(alphabet="GPACKLW", max_size=40), st.sets(st.integers(1, 45), max_size=6))
def test_mutable_positions(spark, text, frozen):
    df = spark.createDataFrame([(text,)], "s string")
    assert column(df.select(W.mutable_positions("s", frozen).alias("v")))[0] == surface_by_hand(text, frozen)


def test_substitution_scan_matches_rescoring(spark):
    texts = {1: "MKWFLLIVGAPYWHKDEFRSTLLW", 2: "GGG", 3: "KW"}
    df = spark.createDataFrame(list(texts.items()), "id int, s string")
    frozen = (3, 9)
    got = {(r["id"], r["position"], r["mut"]): r for r in W.substitution_scan(df, "id", "s", frozen, block=5).collect()}
    expected = set()
    for i, text in texts.items():
        before = load_by_hand(text)
        for p in surface_by_hand(text, set(frozen)):
            for a in K.SCAN_ALPHABET:
                if a == text[p - 1]:
                    continue
                after = load_by_hand(text[: p - 1] + a + text[p:])
                change = len(after[0]) - len(before[0]) + 0.5 * (len(after[1]) - len(before[1]))
                row = got.get((i, p, a))
                crossed = (text[p - 1] in K.POLAR_RESIDUES) != (a in K.POLAR_RESIDUES)
                size = abs(K.RESIDUE_MASS[text[p - 1]] - K.RESIDUE_MASS[a]) / 30.0 * 0.5
                cost = round(0.3 + (0.8 if crossed else 0.0) + size, 2)
                if cost > K.SINGLE_COST_CAP:
                    assert row is None
                    continue
                expected.add((i, p, a))
                assert row["load_delta"] == change and row["wt"] == text[p - 1] and row["cost"] == cost
    assert expected == set(got) and got


def test_identity_family(spark):
    rows = [("ABCD", "ABXD"), ("ABCD", "AB"), ("", "A"), (None, "A"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert column(df.select(Q.positional_identity("a", "b").alias("v"))) == [0.75, 0.5, 0.0, None, None]
    assert column(df.select(Q.novel_count("a", "b").alias("v")))[:2] == [1, 0]


def test_mutations_apply_in_order(spark):
    changes = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).alias("mut_aa")) for p, a in ((1, "W"), (3, "K"), (1, "Y"))])
    assert one(spark, Q.apply_mutations(F.lit("ABCD"), changes)) == "YBKD"
    again = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).alias("mut_aa")) for p, a in ((3, "K"), (1, "W"), (3, "K"))])
    assert one(spark, Q.mutation_fingerprint(again)) == "00000001W|00000003K"


def test_mapped_positions(spark):
    df = spark.createDataFrame([("A", 304), ("D", 100), ("B", 300), ("X", 300)], "s string, n int")
    got = column(df.select(Q.mapped_positions("s", "n").alias("v")))
    near = sorted({max(1, min(300, round(p / 342 * 300) + d)) for p in K.CATALYTIC_POSITIONS for d in (-1, 0, 1)})
    assert got == [[11, 60, 102, 105, 241], [11, 60], near, []]


def test_cosine_distance_zero_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, -1.0], [1.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert column(df.select(Q.cosine_distance("a", "b").alias("v"))) == pytest.approx([1.0, 1.0, 1.0])
    assert column(df.select(Q.cosine_distance("a", "b", "norm").alias("v"))) == pytest.approx([1.0, 0.0, 1.0])


def test_assemble_parts(spark):
    assert one(spark, Q.assemble_parts(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit("-"))) == "A-B-C"
    assert one(spark, Q.assemble_parts(F.array(F.lit("A")), F.lit("-"))) == "A"


def test_sql_functions(spark):
    assert "score_length" in register_sql(spark)
    row = spark.sql("SELECT beats(0.929D) a, beats_calibrated(0.926D) b, score_load(15, 92) c, score_density(7, 100) d, gc_fraction('GCGCAT') e, score_length(580) f").first()
    assert (row["a"], row["b"]) == (False, True)
    assert [row[c] for c in "cdef"] == pytest.approx([0.7594, 0.8, 4 / 6, 0.825])


def test_best_substitutions_of_parts_match_the_scan(spark, monkeypatch):
    """Counts by difference of weights give what re-scoring each substitution gives, across parts of a text too."""
    monkeypatch.setattr(W, "PART", 16)
    text = "".join("KREDQNSTHYLVIMFWYACGP"[(i * i + 3 * i) % 21] for i in range(90))
    scanner = W._Scan((3, 40), W.K.SURFACE_RESIDUES, W.K.SCAN_ALPHABET, 5.0, W.K.SINGLE_COST_CAP, 7)
    weight = lambda t: [W.K.WINDOW_WEIGHTS.get(c, W.K.WINDOW_WEIGHT_OTHER) for c in t]
    above = lambda t, k, limit: sum(sum(weight(t)[i : i + k]) > limit * k for i in range(len(t) - k + 1))
    rows = []
    for places, letters, costs, change1, change2 in scanner.blocks(text):
        for p, a, cost, c1, c2 in zip(places.tolist(), letters.tolist(), costs.tolist(), change1.tolist(), change2.tolist()):
            changed = text[:p] + scanner.letters[a] + text[p + 1 :]
            assert (c1, c2) == tuple(above(changed, *rule) - above(text, *rule) for rule in (W.K.WINDOW_CLASS_1, W.K.WINDOW_CLASS_2))
            rows.append((c1 + 0.5 * c2, cost, p, a, c1, c2))
    for n in (1, 5, len(rows) + 3):
        allowed, lowering, kept = scanner.best(text, n)
        assert (allowed, lowering) == (len(rows), sum(r[0] < 0 for r in rows))
        assert [tuple(r) for r in kept.T.tolist()] == sorted(rows)[:n]


def test_substitutions_are_counted_once_for_each_difference_of_weights(monkeypatch):
    """The work of a scan does not grow with letters times windows: one row of counts for each difference, for all places."""
    asked = []
    real = W._sliding
    monkeypatch.setattr(W, "_sliding", lambda hits, k: asked.append(hits.nbytes) or real(hits, k))
    scanner = W._Scan((), W.K.SURFACE_RESIDUES, W.K.SCAN_ALPHABET, 5.0, W.K.SINGLE_COST_CAP, 4096)
    scanner.best("KREWYFLIVM" * 1000, 1)
    assert len(asked) == 2 and sum(asked) < 10_100 * 2 * (len(scanner.deltas) + 1)


def test_places_are_lists_without_objects():
    found = W._lists([np.array([1, 5], dtype=np.int32), W._NONE, W._NONE], np.array([False, True, False]))
    assert found.to_pylist() == [[1, 5], None, []] and found.type == pa.list_(pa.int32())


@pytest.mark.parametrize("k,piece", [(1, 4), (3, 4), (9, 2048), (5, 2)])
def test_kmer_windows_across_pieces_and_wide_characters(spark, k, piece):
    texts = ["a𝔸b\nc𝔹𝔹def" * 3, "é" * 11, "ab", "", None]
    got = sorted(tuple(r) for r in Q.kmer_windows(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", "s", k, piece).collect())
    assert got == sorted((i, at + 1, t[at : at + k]) for i, t in enumerate(texts) if t for at in range(len(t) - k + 1))


def test_rows_of_windows_carry_no_text(spark):
    """Neither the pieces of a text nor a piece itself is copied to each of its rows."""
    df = spark.createDataFrame([(1, "abcdef")], "id int, s string")
    plan = Q.kmer_windows(df, "id", "s", 3)._jdf.queryExecution().optimizedPlan()
    steps = [plan]
    while steps[-1].children().nonEmpty():
        steps.append(steps[-1].children().head())
    generates = [s for s in steps if s.nodeName() == "Generate"]
    assert len(generates) == 2
    for step in generates:
        names = [step.output().apply(i).name() for i in range(step.output().size())]
        assert len(names) <= 4 and "s" not in names and (step is generates[1] or "_text" not in names)
