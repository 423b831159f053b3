"""Projections and scalar rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, num, query, sql_length, sql_round, sql_weighted, table
from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sqlfuncs import register_sql
from winnow.operators import scoring
from winnow.operators.numbering import assign_ids
from winnow.sources.catalog import load_registry


@query("P1_normalize_columns", "SELECT p_partkey AS uniprot_acc, p_size AS protein_length_aa, p_name FROM part")
def p1(spark, folder):
    raw = table(spark, folder, "part").select(
        F.col("p_partkey").alias("accession"), F.col("p_size").alias("length"), "p_name"
    )
    return scoring.normalize_columns(raw)


@query("P2_first_present", "SELECT doc_id, n_chars AS value FROM documents")
def p2(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", F.col(scoring.first_present(df, ["protein_length_aa", "n_chars", "text"])).alias("value"))


@query("P3_weighted_score", f"WITH {DESIGNS} SELECT design_id, {sql_weighted(K.PROFILE_V010)} AS score FROM designs")
def p3(spark, folder):
    return scoring.weighted_score(designs(spark, folder).drop("score")).select("design_id", "score")


_RAW = f"""WITH {DESIGNS},
r AS (SELECT *, 1e0 AS S_Energy, {sql_weighted(K.PROFILE_V010)} AS o FROM designs),
n AS (SELECT *, {sql_weighted(K.PROFILE_V012)} AS w FROM r), f AS (SELECT *, w - o AS x FROM n)"""


@query(
    "P4_rescore",
    f"""{_RAW} SELECT design_id, strategy, '' AS parent_editor,
      {', '.join(f'{a} AS {a}_v010' for a in K.PROFILE_V010)},
      {', '.join(f'{a} AS {a}_v012' for a in K.PROFILE_V012)},
      {sql_round('o', 4)} AS score_v010, {sql_round('w', 4)} AS score_v012, {sql_round('x', 4)} AS score_delta,
      o > 0.929e0 AS beats_v010_lockpoint, w > 0.957e0 AS beats_v012_lockpoint,
      '0.1.2' AS score_version, '{K.USE_CASE}' AS profile FROM f""",
)
def p4(spark, folder):
    return scoring.rescore(designs(spark, folder))


_CONTRIB = " UNION ALL ".join(
    f"SELECT design_id, '{a}' AS axis, {a} AS value, {num(w)} AS weight, {a} * {num(w)} AS contribution FROM designs"
    for a, w in K.PROFILE_V010.items()
)


@query("P5_axis_contributions", f"WITH {DESIGNS} {_CONTRIB}")
def p5(spark, folder):
    return scoring.axis_contributions(designs(spark, folder), "design_id")


@query(
    "P6_beats",
    f"""WITH {DESIGNS} SELECT design_id, score > 0.929e0 AS verbatim, score > 0.9255e0 AS calibrated,
      score > 0.957e0 AS later, score > 0.929e0 + (0.7243e0 - 0.7594e0) * 0.1e0 AS recalibrated FROM designs""",
)
def p6(spark, folder):
    moved = S.recalibrated(0.929, 0.7594, 0.7243, 0.10)
    return designs(spark, folder).select(
        "design_id",
        S.beats("score").alias("verbatim"),
        S.beats("score", K.LOCKPOINT_CALIBRATED).alias("calibrated"),
        S.beats("score", K.LOCKPOINT_V012).alias("later"),
        S.beats("score", moved).alias("recalibrated"),
    )


@query(
    "P8_score_class",
    f"""WITH {DESIGNS} SELECT tier_a, S_DSB AS value, count(*) AS n FROM designs GROUP BY ALL""",
)
def p8(spark, folder):
    return designs(spark, folder).groupBy("tier_a", S.score_class("tier_a").alias("value")).agg(F.count("*").alias("n"))


@query(
    "P9_score_cargo",
    f"WITH {DESIGNS} SELECT tier_a, composite, S_Cargo AS value, count(*) AS n FROM designs GROUP BY ALL",
)
def p9(spark, folder):
    return (
        designs(spark, folder)
        .groupBy("tier_a", "composite", S.score_cargo("tier_a", "composite").alias("value"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "P10_score_length",
    f"SELECT doc_id, {sql_length('n_chars')} AS value FROM documents",
)
def p10(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.score_length("n_chars").alias("value"))


_LOAD = "least(1e0, greatest(0e0, 1e0 - (o.n1 + o.n2 * 0.5e0) / 253.5e0))"


@query(
    "P11_score_load",
    f"""WITH o AS (SELECT p_partkey, p_size AS n1, p_size * 7 % 101 AS n2 FROM part),
    x AS (SELECT p_partkey, {_LOAD} AS v FROM o) SELECT p_partkey, {sql_round('v', 4)} AS value FROM x""",
)
def p11(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").alias("n1"), (F.col("p_size") * 7 % 101).alias("n2")
    )
    return part.select("p_partkey", S.score_load("n1", "n2").alias("value"))


@query(
    "P12_score_density",
    """SELECT o_orderkey, least(1e0, greatest(0e0, 1e0 - ((o_custkey % 97)::DOUBLE / (o_orderkey % 301 + 60)) / 0.35e0))
       AS value FROM orders""",
)
def p12(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 97).alias("n"), (F.col("o_orderkey") % 301 + 60).alias("length")
    )
    return orders.select("o_orderkey", S.score_density("n", "length").alias("value"))


_PROXY = "least(1e0, greatest(0e0, (1e0 + (0.7594e0 - n_chars / 50e0) * 0.1e0) * 0.7594e0))"


@query(
    "P13_score_immuno",
    f"""SELECT d.doc_id, coalesce(l.quality * 0.5e0, CASE WHEN d.lang = 'en' THEN 0.7594e0 ELSE {_PROXY} END) AS value
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def p13(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    strategy = F.when(F.col("lang") == "en", "C_deimm").otherwise("B_ortholog")
    return docs.select("doc_id", S.score_immuno(F.col("quality") * 0.5, strategy, "n_chars").alias("value"))


@query(
    "P14_score_maturity",
    f"""WITH {DESIGNS} SELECT design_id, CASE WHEN strategy = 'D' THEN 0.396e0
      WHEN strategy = 'C' THEN CASE WHEN S_Spec >= 0.8e0 THEN 0.792e0 ELSE 0e0 END ELSE 0e0 END AS value FROM designs""",
)
def p14(spark, folder):
    return designs(spark, folder).select("design_id", S.score_maturity("strategy", "S_Spec").alias("value"))


@query(
    "P15_score_proxies",
    f"""WITH {DESIGNS} SELECT design_id, {sql_round('S_Spec', 4)} AS specificity, {sql_round('S_Prog', 4)} AS programmability
    FROM designs""",
)
def p15(spark, folder):
    return designs(spark, folder).select(
        "design_id",
        S.proxy_specificity("tier_a_confidence", "composite_prob").alias("specificity"),
        S.proxy_programmability("composite_prob", "composite").alias("programmability"),
    )


def batch_input(spark, folder):
    """documents as unscored candidates with their whole text as sequence."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.select(
        F.concat(F.lit("D"), "doc_id").alias("design_id"),
        F.when(F.col("lang") == "en", "B_ortholog").when(F.col("lang") == "fr", "C_deimm").otherwise("D_protmpnn")
        .alias("strategy"),
        F.when(F.col("quality") == 1, K.CLASS_FREE).when(F.col("quality") == 0, K.CLASS_NUCLEASE)
        .otherwise(K.CLASS_UNKNOWN).alias("tier_a"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("composite"),
        (F.lit(1.0) - F.col("n_chars") % 40 / 100.0).alias("tier_a_confidence"),
        (F.lit(1.0) - F.col("n_chars") % 20 / 100.0).alias("composite_prob"),
        F.when(F.col("n_chars") % 3 == 0, F.col("n_chars") % 100 / 100.0).alias("predicted_s_immuno"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("protein_sequence"),
        "source",
    )


# the window load of a text: windows whose weights sum above k x threshold
_W = " ".join(f"WHEN '{a}' THEN {w}" for a, w in K.WINDOW_WEIGHTS.items())
SQL_LOADS = f"""
ch AS (SELECT design_id, unnest(range(1, length(protein_sequence) + 1)) AS pos, protein_sequence AS s FROM batch),
w AS (SELECT design_id, pos, CASE s[pos] {_W} ELSE 30 END AS w FROM ch),
sums AS (SELECT design_id, pos,
    sum(w) OVER a AS s9, count(*) OVER a AS c9, sum(w) OVER b AS s15, count(*) OVER b AS c15
  FROM w WINDOW a AS (PARTITION BY design_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING),
    b AS (PARTITION BY design_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
loads AS (SELECT design_id, count(*) FILTER (c9 = 9 AND s9 > 43 * 9)::INTEGER AS n1,
    count(*) FILTER (c15 = 15 AND s15 > 38 * 15)::INTEGER AS n2 FROM sums GROUP BY design_id)"""

SQL_BATCH = f"""
batch AS (SELECT 'D' || doc_id AS design_id,
    CASE lang WHEN 'en' THEN 'B_ortholog' WHEN 'fr' THEN 'C_deimm' ELSE 'D_protmpnn' END AS strategy,
    CASE quality WHEN 1 THEN '{K.CLASS_FREE}' WHEN 0 THEN '{K.CLASS_NUCLEASE}' ELSE '{K.CLASS_UNKNOWN}' END AS tier_a,
    coalesce(toxic, 0) = 0 AS composite,
    1e0 - (n_chars % 40) / 100e0 AS tier_a_confidence, 1e0 - (n_chars % 20) / 100e0 AS composite_prob,
    CASE WHEN n_chars % 3 = 0 THEN (n_chars % 100) / 100e0 END AS predicted_s_immuno,
    upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS protein_sequence, source
  FROM documents LEFT JOIN labels USING (doc_id)),
{SQL_LOADS},
b0 AS (SELECT batch.*, length(protein_sequence) AS n, coalesce(n1, 0) + coalesce(n2, 0) * 0.5e0 AS load
  FROM batch LEFT JOIN loads USING (design_id)),
b1 AS (SELECT *, CASE tier_a WHEN '{K.CLASS_FREE}' THEN 1e0 WHEN '{K.CLASS_NUCLEASE}' THEN 0e0 ELSE 0.5e0 END AS S_DSB,
    least(1e0, tier_a_confidence * 0.9e0 + composite_prob * 0.1e0) AS spec,
    CASE WHEN tier_a = '{K.CLASS_FREE}' AND composite THEN 1e0 WHEN tier_a = '{K.CLASS_FREE}' THEN 0.85e0
      ELSE 0e0 END AS S_Cargo,
    {sql_length('n')} AS deliv,
    coalesce(predicted_s_immuno, CASE WHEN strategy = 'C_deimm' THEN 0.7594e0 ELSE
      least(1e0, greatest(0e0, (1e0 + (0.7594e0 - load / 50e0) * 0.1e0) * 0.7594e0)) END) AS immuno,
    least(1e0, composite_prob * 0.8e0 + (CASE WHEN composite THEN 1e0 ELSE 0e0 END) * 0.2e0) AS prog,
    CASE WHEN strategy LIKE 'D%' THEN 0.792e0 * 0.5e0 WHEN strategy LIKE 'C%' THEN 0.792e0 ELSE 0e0 END AS mature
  FROM b0),
b2 AS (SELECT *, {sql_round('spec', 4)} AS S_Spec, {sql_round('prog', 4)} AS S_Prog FROM b1),
b3 AS (SELECT *, S_DSB * 0.25e0 + S_Spec * 0.1e0 + S_Cargo * 0.2e0 + deliv * 0.15e0 + immuno * 0.1e0 + S_Prog * 0.15e0
    + mature * 0.05e0 AS total FROM b2),
scored AS (SELECT *, {sql_round('total', 4)} AS score, {sql_round('deliv', 4)} AS S_Deliv,
    {sql_round('immuno', 4)} AS S_Immuno, {sql_round('mature', 4)} AS S_Mature FROM b3)"""


@query(
    "P16_score_batch",
    f"""WITH {SQL_BATCH} SELECT design_id, S_DSB, S_Spec, S_Cargo, S_Deliv, S_Immuno, S_Prog, S_Mature, score,
      score > 0.929e0 AS beats_lockpoint, 'local_axis_implementations' AS score_method FROM scored""",
)
def p16(spark, folder):
    return scoring.score_batch(batch_input(spark, folder)).select(
        "design_id", *K.AXES, "score", "beats_lockpoint", "score_method"
    )


_IDS = """ids AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'A_' || p_name WHEN 'SMALL' THEN 'D0' || p_name
  WHEN 'LARGE' THEN 'D8_IS621_ProtMPNN_' || p_size WHEN 'ECONOMY' THEN 'IS621_deimm_' || p_size
  WHEN 'MEDIUM' THEN 'D9_IS621_' || p_size ELSE p_name END AS id FROM part)"""


def _ids(spark, folder):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    text = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("A_"), name))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("D0"), name))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("D8_IS621_ProtMPNN_"), size))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("IS621_deimm_"), size))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("D9_IS621_"), size))
        .otherwise(name)
    )
    return table(spark, folder, "part").select("p_partkey", text.alias("id"))


_FIRST = """CASE WHEN upper(id) LIKE 'A\\_%' ESCAPE '\\' THEN 'A' WHEN upper(id) LIKE 'D0%' OR contains(upper(id), 'PROTMPNN')
  THEN 'D' WHEN contains(upper(id), 'DEIMM') THEN 'C' ELSE 'B' END"""
_SECOND = """CASE WHEN upper(id) LIKE 'A\\_%' ESCAPE '\\' THEN 'A' WHEN contains(upper(id), 'PROTMPNN')
  OR (upper(id) LIKE 'D%' AND contains(upper(id), '_IS621_')) THEN 'D' WHEN contains(upper(id), 'DEIMM') THEN 'C'
  ELSE 'B' END"""


@query("P17_strategy_from_id", f"WITH {_IDS} SELECT p_partkey, {_FIRST} AS first, {_SECOND} AS second FROM ids")
def p17(spark, folder):
    return _ids(spark, folder).select(
        "p_partkey", S.strategy_from_id("id").alias("first"), S.strategy_from_id("id", "second").alias("second")
    )


_PARENT = f"""CASE WHEN {_FIRST} IN ('A', 'C') OR ({_FIRST} = 'D' AND regexp_matches(id, '(?i)^D\\d+_IS621_ProtMPNN_'))
  THEN 'IS621' ELSE id END"""


@query("P18_parent_of", f"WITH {_IDS} SELECT p_partkey, {_PARENT} AS parent FROM ids")
def p18(spark, folder):
    return _ids(spark, folder).select("p_partkey", S.parent_of("id", S.strategy_from_id("id")).alias("parent"))


@query(
    "P19_rename_values",
    """SELECT CASE p_type WHEN 'SMALL' THEN 'COMPACT' ELSE p_type END AS p_type, count(*) AS n,
       count(*) FILTER (p_type = 'SMALL') AS n_changed FROM part GROUP BY 1""",
)
def p19(spark, folder):
    part = table(spark, folder, "part").withColumn("old", F.col("p_type"))
    return (
        scoring.rename_values(part, "p_type", {"SMALL": "COMPACT"})
        .groupBy("p_type")
        .agg(F.count("*").alias("n"), F.count_if(F.col("old") == "SMALL").alias("n_changed"))
    )


@query(
    "P20_add_evidence_flags",
    "SELECT s_suppkey, true AS intrinsic_cargo_mechanism, false AS cell_based_evidence FROM supplier",
)
def p20(spark, folder):
    return scoring.add_evidence_flags(table(spark, folder, "supplier").select("s_suppkey"))


@query(
    "P21_genus_of",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'Unknown' ELSE split_part(p_name, ' ', 1) END AS genus FROM part""",
)
def p21(spark, folder):
    name = F.when(F.col("p_size") % 10 != 0, F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", S.genus_of(name).alias("genus"))


@query(
    "P22_assign_ids",
    """SELECT o_orderkey, printf('B_%03d_%s', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey),
       substr(o_orderkey::VARCHAR, 1, 8)) AS design_id FROM orders""",
)
def p22(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return assign_ids(orders, "B", "o_orderkey", order, order_columns=["o_totalprice", "o_orderkey"]).select("o_orderkey", "design_id")


_MASS = " ".join(f"WHEN '{r}' THEN {m}" for r, m in K.RESIDUE_MASS.items())


def sql_step(wt: str, mut: str) -> str:
    polar = f"contains('{K.POLAR_RESIDUES}', {wt}) <> contains('{K.POLAR_RESIDUES}', {mut})"
    mass = f"abs((CASE {wt} {_MASS} ELSE 115 END) - (CASE {mut} {_MASS} ELSE 115 END))"
    return f"((0.3e0 + CASE WHEN {polar} THEN 0.8e0 ELSE 0e0 END) + {mass} / 30e0 * 0.5e0)"


_PAIR = "s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark)"


@query(
    "P23_mutation_cost",
    f"""WITH {_PAIR}, c AS (SELECT item_id, unnest(range(1, length(s))) AS pos, s FROM s),
    x AS (SELECT item_id, pos, least({sql_step("s[pos]", "s[pos + 1]")}, 5e0) AS v FROM c)
    SELECT item_id, pos::INTEGER AS pos, {sql_round('v', 2)} AS cost FROM x""",
)
def p23(spark, folder):
    from table_queries.base import sequences
    from winnow.functions.sequences import kmer_windows

    pairs = kmer_windows(sequences(spark, folder, "benchmark"), "id", "sequence", 2)
    cost = S.mutation_cost(F.substring("window", 1, 1), F.substring("window", 2, 1))
    return pairs.select(F.col("id").alias("item_id"), F.col("start").alias("pos"), cost.alias("cost"))


@query(
    "P24_mutation_total",
    f"""WITH {_PAIR}, m AS (SELECT item_id, [{{'wt': s[1], 'mut': s[2]}}, {{'wt': s[3], 'mut': s[4]}}, {{'wt': s[5], 'mut': s[6]}}]
      AS m FROM s),
    x AS (SELECT item_id, ((0e0 + {sql_step('m[1].wt', 'm[1].mut')}) + {sql_step('m[2].wt', 'm[2].mut')})
      + {sql_step('m[3].wt', 'm[3].mut')} AS v FROM m)
    SELECT item_id, {sql_round('v', 2)} AS total FROM x""",
)
def p24(spark, folder):
    from table_queries.base import sequences

    def one(i):
        return F.struct(F.substring("sequence", i, 1).alias("wt_aa"), F.substring("sequence", i + 1, 1).alias("mut_aa"))

    df = sequences(spark, folder, "benchmark").withColumn("m", F.array(one(1), one(3), one(5)))
    return df.select(F.col("id").alias("item_id"), S.mutation_total("m").alias("total"))


@query(
    "P25_stability_flags",
    f"""WITH {DESIGNS} SELECT design_id, coalesce(ddg_kcal_mol > 3, false) AS stability_warning,
      coalesce(ddg_kcal_mol > 5, false) AS ddg_hard_gate_fail, ddg_kcal_mol < -0.5e0 AS ddg_stabilizing FROM designs""",
)
def p25(spark, folder):
    return designs(spark, folder).select("design_id", *[c.alias(n) for n, c in S.stability_flags("ddg_kcal_mol").items()])


@query(
    "P26_choose_measurement",
    """SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END,
        CASE WHEN event_type IN ('click', 'purchase') THEN value / 2e0 END,
        CASE WHEN event_type <> 'error' THEN value / 4e0 END) AS ddg_kcal_mol,
      CASE event_type WHEN 'purchase' THEN 'structural' WHEN 'click' THEN 'learned' WHEN 'error' THEN 'none'
        ELSE 'proxy' END AS ddg_method FROM events""",
)
def p26(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    events = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "purchase", value).alias("m1"),
        F.when(kind.isin("click", "purchase"), value / 2.0).alias("m2"),
        F.when(kind != "error", value / 4.0).alias("m3"),
    )
    options = [("structural", "m1"), ("learned", "m2"), ("proxy", "m3")]
    return scoring.stability_columns(events, options).select("event_id", "ddg_kcal_mol", "ddg_method")


@query("P27_mass_kda", "SELECT doc_id, length(text) * 110 / 1000e0 AS mass FROM documents")
def p27(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.mass_kda("text").alias("mass"))


@query(
    "P28_lookup_rules",
    f"""SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'red') THEN 'first'
        WHEN contains(p_name, 'widget') THEN 'second' END AS template,
      CASE WHEN p_type = 'SMALL' THEN repeat('GGGGS', greatest(1, p_size // 4))
        WHEN p_type = 'LARGE' THEN repeat('EAAAK', greatest(1, p_size // 5)) END AS linker,
      CASE p_type WHEN 'SMALL' THEN '{K.LINKER_BAND['GS']}' WHEN 'LARGE' THEN '{K.LINKER_BAND['EAAAK']}'
        ELSE 'unknown' END AS band FROM part""",
)
def p28(spark, folder):
    kind = F.when(F.col("p_type") == "SMALL", "GS").when(F.col("p_type") == "LARGE", "EAAAK").otherwise("natural")
    rules = [(("ring", "red"), "first"), (("widget",), "second")]
    return table(spark, folder, "part").select(
        "p_partkey",
        S.lookup_contains("p_name", rules, None).alias("template"),
        S.linker_sequence(kind, "p_size").alias("linker"),
        S.linker_band(kind).alias("band"),
    )


@query(
    "P30_flag_class",
    f"""WITH {DESIGNS} SELECT design_id, CASE tier_a WHEN 'UNCLASSIFIED' THEN 'UNCLASSIFIED_MANUAL_REVIEW'
      WHEN 'DSB_NUCLEASE' THEN 'DSB_NUCLEASE_DISCARD' ELSE 'PASS' END AS class_flag FROM designs""",
)
def p30(spark, folder):
    return designs(spark, folder).select("design_id", S.flag_class("tier_a").alias("class_flag"))


_DELTA = " UNION ALL ".join(
    f"""SELECT design_id, '{a}' AS axis, {num(K.PROFILE_V010.get(a, 0))} AS weight_old, {num(w)} AS weight_new,
    {'1e0' if a == 'S_Energy' else a} * {num(w)} - {'1e0' if a == 'S_Energy' else a} * {num(K.PROFILE_V010.get(a, 0))} AS delta
    FROM designs"""
    for a, w in K.PROFILE_V012.items()
)


@query("P32_contribution_delta", f"WITH {DESIGNS} {_DELTA}")
def p32(spark, folder):
    return scoring.contribution_delta(designs(spark, folder), "design_id")


@query(
    "SQL_functions",
    f"""WITH {DESIGNS} SELECT design_id, score > 0.929e0 AS above, score > 0.9255e0 AS above_calibrated, S_Deliv AS length_score,
      least(1e0, greatest(0e0, 1e0 - (protein_length_aa::DOUBLE / 2000e0) / 0.35e0)) AS density, {sql_round('x', 4)} AS load,
      CASE WHEN length(organism) > 0 THEN (length(organism) - length(regexp_replace(upper(organism), '[GC]', '', 'g')))::DOUBLE
        / length(organism) ELSE 0e0 END AS gc
      FROM (SELECT *, least(1e0, greatest(0e0, 1e0 - (protein_length_aa / 7e0 + 31e0 * 0.5e0) / 253.5e0)) AS x FROM designs)""",
)
def sql_functions(spark, folder):
    register_sql(spark)
    return designs(spark, folder).select(
        "design_id",
        F.expr("beats(score)").alias("above"),
        F.expr("beats_calibrated(score)").alias("above_calibrated"),
        F.expr("score_length(protein_length_aa)").alias("length_score"),
        F.expr("score_density(protein_length_aa, 2000)").alias("density"),
        F.expr("score_load(protein_length_aa / 7.0D, 31)").alias("load"),
        F.expr("gc_fraction(organism)").alias("gc"),
    )


@query(
    "S15_load_registry",
    f"""WITH {DESIGNS}, c AS ({_CONTRIB}) SELECT axis, count(*) AS n, round(sum(contribution), 6) AS total FROM c GROUP BY axis""",
)
def s15(spark, folder):
    weights = load_registry(spark, "weights").filter("profile = 'v010'").select("axis", "weight")
    axes = designs(spark, folder).unpivot("design_id", list(K.AXES), "axis", "value")
    return (
        axes.join(F.broadcast(weights), "axis")  # eight rows per profile
        .groupBy("axis")
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("weight")), 6).alias("total"))
    )


