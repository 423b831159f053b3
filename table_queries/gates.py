"""Gates, funnels and selections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, query, sql_round, table
from winnow import constants as K
from winnow.operators import gates as G


@query("G1_probability", f"WITH {DESIGNS} SELECT design_id, composite_prob FROM designs WHERE composite_prob >= 0.85e0")
def g1(spark, folder):
    return G.apply_gates(designs(spark, folder), G.SOURCE_GATES[:1]).select("design_id", "composite_prob")


@query(
    "G2_composite",
    f"""WITH {DESIGNS} SELECT design_id FROM designs WHERE composite AND tier_a = '{K.CLASS_FREE}'
    AND tier_a_confidence >= 0.8e0""",
)
def g2(spark, folder):
    return G.gate_composite(designs(spark, folder), label=K.CLASS_FREE, min_confidence=0.80).select("design_id")


@query(
    "G3_length",
    f"WITH {DESIGNS} SELECT design_id, protein_length_aa FROM designs WHERE protein_length_aa BETWEEN 200 AND 400",
)
def g3(spark, folder):
    return G.apply_gates(designs(spark, folder), G.SOURCE_GATES[2:]).select("design_id", "protein_length_aa")


@query(
    "G4_structure",
    f"WITH {DESIGNS} SELECT design_id FROM designs WHERE mean_plddt >= 70 AND ptm * 100e0 >= 75",
)
def g4(spark, folder):
    df = designs(spark, folder).withColumns(
        {"af3_mean_plddt": F.col("mean_plddt"), "af3_active_site_plddt": F.col("ptm") * 100.0}
    )
    return G.apply_gates(df, G.STRUCTURE_GATES).select("design_id")


@query(
    "G5_domain_proxy",
    """SELECT doc_id, true AS gate_7_pf01548, true AS gate_7_pf02371, true AS gate_7_pass,
      'reviewed_proxy' AS gate_7_source FROM documents JOIN labels USING (doc_id) WHERE quality = 1""",
)
def g5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    labelled = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    flagged = labelled.select("doc_id", (F.col("quality") == 1).alias("reviewed"))
    return G.domain_gate_proxy(flagged, "reviewed").drop("reviewed")


@query(
    "G6_domain_hits",
    """SELECT o_orderkey, true AS gate_7_a, true AS gate_7_r, true AS gate_7_pass FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.05e0)
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05e0)""",
)
def g6(spark, folder):
    hits = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("family"), F.col("l_discount").alias("e_value")
    )
    orders = table(spark, folder, "orders").select("o_orderkey")
    return G.domain_gate_hits(orders, hits, "o_orderkey", ("A", "R"), 0.05)


@query(
    "G7_skip_gate",
    "SELECT s_suppkey, NULL::BOOLEAN AS gate_6_pass, NULL::DOUBLE AS gate_6_distance FROM supplier",
)
def g7(spark, folder):
    return G.skip_gate(table(spark, folder, "supplier").select("s_suppkey"), "6", "distance")


FLAGS = f"""flags AS (SELECT *, mean_plddt >= 50 AS a, coalesce(ddg_kcal_mol <= 5, false) AS b,
  coalesce(active_site_pass, true) AS c, tier_a = '{K.CLASS_FREE}' AS d, score >= 0 AS e FROM designs)"""
FIRST = "CASE WHEN NOT a THEN 'A' WHEN NOT b THEN 'B' WHEN NOT c THEN 'C' WHEN NOT d THEN 'D' WHEN NOT e THEN 'E' END"


@query(
    "G8_apply_gates",
    f"WITH {DESIGNS}, {FLAGS} SELECT design_id, score FROM flags WHERE a AND b AND c AND d AND e",
)
def g8(spark, folder):
    return G.apply_gates(designs(spark, folder), G.TRIAGE_GATES).select("design_id", "score")


@query(
    "G8_apply_gates_annotate",
    f"""WITH {DESIGNS}, {FLAGS} SELECT design_id, a AS gate_A_pass, b AS gate_B_pass, c AS gate_C_pass, d AS gate_D_pass,
      e AS gate_E_pass, {FIRST} AS first_failed_gate FROM flags""",
)
def g8_annotate(spark, folder):
    out = G.apply_gates(designs(spark, folder), G.TRIAGE_GATES, "annotate")
    return out.select("design_id", *[f"gate_{x}_pass" for x in "ABCDE"], "first_failed_gate")


@query(
    "G9_filter_ddg",
    f"WITH {DESIGNS} SELECT design_id, ddg_kcal_mol FROM designs WHERE ddg_kcal_mol IS NULL OR ddg_kcal_mol <= 5",
)
def g9(spark, folder):
    return G.filter_ddg(designs(spark, folder)).select("design_id", "ddg_kcal_mol")


@query(
    "G10_filter_class",
    f"""WITH {DESIGNS} SELECT design_id, 'PASS' AS class_flag FROM designs WHERE tier_a = '{K.CLASS_FREE}'
    AND tier_a_confidence >= 0.8e0""",
)
def g10(spark, folder):
    return G.filter_class(designs(spark, folder)).select("design_id", "class_flag")


@query(
    "G11_identity_range",
    """SELECT doc_id, quality * 0.6e0 AS identity FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NULL OR quality * 0.6e0 BETWEEN 0.5e0 AND 0.75e0""",
)
def g11(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return G.identity_range(docs.select("doc_id", (F.col("quality") * 0.6).alias("identity")), "identity")


@query(
    "G12_rmsd_check",
    f"WITH {DESIGNS} SELECT design_id, ddg_kcal_mol <= 1.5e0 AS passes FROM designs",
)
def g12(spark, folder):
    return designs(spark, folder).select("design_id", G.rmsd_check("ddg_kcal_mol").alias("passes"))


@query(
    "G13_confidence_gate",
    f"""WITH {DESIGNS} SELECT design_id, mean_plddt >= 70 AS pass_plddt, ptm >= 0.5e0 AS pass_ptm,
      mean_plddt >= 70 AND ptm >= 0.5e0 AS pass_gate5 FROM designs""",
)
def g13(spark, folder):
    return G.confidence_gate(designs(spark, folder)).select("design_id", "pass_plddt", "pass_ptm", "pass_gate5")


@query(
    "G14_prefilter",
    """SELECT event_id, value >= 50 AS esmfold_pass,
      CASE WHEN value < 50 THEN 'mean pLDDT ' || printf('%.1f', value) || ' < 50.0' END AS esmfold_discard_reason
    FROM (SELECT event_id, round(value) AS value FROM events)""",
)
def g14(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.round("value").alias("value"))
    return G.prefilter(events, "value").drop("value")


@query(
    "G15_active_site_gate",
    """WITH x AS (SELECT doc_id, n_chars % 100 AS g, CASE WHEN n_chars % 4 <> 0 THEN n_chars % 90 + 10 END AS m,
      CASE WHEN n_chars % 4 <> 0 THEN n_chars % 80 END AS lo, CASE WHEN n_chars % 4 <> 0 THEN 5 ELSE 0 END AS f FROM documents)
    SELECT doc_id, coalesce(m, g)::DOUBLE AS active_site_plddt, coalesce(lo, g)::DOUBLE AS active_site_min,
      CASE WHEN f = 0 THEN -1 ELSE f END AS cat_residues_sampled, coalesce(m, g) >= 75 AS pass_active_site,
      coalesce(m, g) * 0.5e0 AS rank_score FROM x""",
)
def g15(spark, folder):
    n = F.col("n_chars")
    found = n % 4 != 0
    df = table(spark, folder, "documents").select(
        "doc_id",
        (n % 100).cast("double").alias("mean_plddt"),
        F.lit(0.5).alias("ptm"),
        F.when(found, n % 90 + 10).cast("double").alias("site_mean"),
        F.when(found, n % 80).cast("double").alias("site_min"),
        F.when(found, 5).otherwise(0).alias("site_found"),
    )
    return G.active_site_gate(df).select(
        "doc_id", "active_site_plddt", "active_site_min", "cat_residues_sampled", "pass_active_site", "rank_score"
    )


@query("G16_size_gate", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 250 AND 1200")
def g16(spark, folder):
    return G.size_gate(table(spark, folder, "documents").select("doc_id", "n_chars"), "n_chars")


@query(
    "G17_has_sequence",
    "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0",
)
def g17(spark, folder):
    from table_queries.base import sequences

    return G.has_sequence(sequences(spark, folder), "sequence").select(F.col("id").alias("doc_id"))


@query(
    "G18_select_designs",
    f"""WITH {DESIGNS} SELECT design_id, score FROM designs WHERE strategy = 'C' AND tier_a = '{K.CLASS_FREE}'
    ORDER BY score DESC, design_id LIMIT 10""",
)
def g18(spark, folder):
    return G.select_designs(designs(spark, folder), "C").select("design_id", "score")


@query("G19_filter_strategy", f"WITH {DESIGNS} SELECT design_id, score FROM designs WHERE strategy = 'D'")
def g19(spark, folder):
    return G.filter_strategy(designs(spark, folder), "D").select("design_id", "score")


@query(
    "G20_search",
    f"""WITH {DESIGNS} SELECT design_id, organism, {sql_round('score', 4)} AS score FROM designs
    WHERE score >= 0.6e0 AND strategy = 'C' AND (contains(lower(design_id), 's1 s') OR contains(lower(organism), 's1 s'))""",
)
def g20(spark, folder):
    df = designs(spark, folder).withColumn("beats_lockpoint", F.col("score") > 0.929)
    found = G.search(df, "S1 S", "C", 0.6)
    return G.display_projection(found, {"score": 4}, ["organism"]).select("design_id", "organism", "score")


@query(
    "G21_hypothesis_predicates",
    f"""WITH {DESIGNS} SELECT strategy, count(*) FILTER (score > 0.8e0) AS n_above,
      count(*) FILTER (S_Cargo = 1 AND S_Deliv >= 0.9e0) AS n_joint FROM designs GROUP BY strategy""",
)
def g21(spark, folder):
    return designs(spark, folder).groupBy("strategy").agg(
        F.count_if(G.beats_predicate("score", 0.8)).alias("n_above"),
        F.count_if(G.cargo_delivery_predicate()).alias("n_joint"),
    )
