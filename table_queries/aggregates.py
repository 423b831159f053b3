"""Reports and what-if aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, query, sql_round, sql_weighted, table
from table_queries.gates import FIRST, FLAGS
from table_queries.joins import SQL_ATOMS, atom_lines
from winnow import constants as K
from winnow.operators import aggregates as A
from winnow.operators import checks as V
from winnow.operators.gates import TRIAGE_GATES, apply_gates, confidence_gate, failure_modes, funnel_report
from winnow.operators.scoring import rescore
from winnow.sources.predictions import parse_atoms

_STEPS = ["true", "a", "a AND b", "a AND b AND c", "a AND b AND c AND d", "a AND b AND c AND d AND e"]


def _step(i: int) -> str:
    before, after = f"count(*) FILTER ({_STEPS[i - 1]})", f"count(*) FILTER ({_STEPS[i]})"
    return f"SELECT {i} AS step, '{'ABCDE'[i - 1]}' AS gate, {before} AS n_input, {after} AS n_output, {before} - {after} AS n_removed FROM flags"


@query("A1_funnel_report", f"WITH {DESIGNS}, {FLAGS} " + " UNION ALL ".join(_step(i) for i in range(1, 6)))
def a1(spark, folder):
    return funnel_report(designs(spark, folder), TRIAGE_GATES)


@query(
    "A2_failure_modes",
    f"""WITH {DESIGNS}, {FLAGS}, f AS (SELECT strategy, {FIRST} AS mode FROM flags),
    m AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS failure_mode),
    r AS (SELECT strategy, false AS is_total, count(*) AS n_rows FROM f GROUP BY 1
      UNION ALL SELECT NULL, true, count(*) FROM f)
    SELECT r.strategy, is_total, n_rows, failure_mode,
      (SELECT count(*) FROM f WHERE mode = failure_mode AND (is_total OR f.strategy = r.strategy)) AS n_failed FROM r, m""",
)
def a2(spark, folder):
    return failure_modes(designs(spark, folder), TRIAGE_GATES, "strategy")


@query(
    "A3_strategy_breakdown",
    f"""WITH {DESIGNS} SELECT strategy, count(*) AS n, count(*) FILTER (score > 0.8e0) AS n_beating, max(score) AS best,
      median(score) AS median FROM designs GROUP BY strategy""",
)
def a3(spark, folder):
    return A.strategy_breakdown(designs(spark, folder), threshold=0.8)


_DELTA = f"""WITH {DESIGNS}, e AS (SELECT *, 1e0 AS S_Energy FROM designs),
d AS (SELECT strategy, ({sql_weighted(K.PROFILE_V012)}) - score AS x FROM e),
r AS (SELECT strategy, {sql_round('x', 4)} AS delta FROM d)"""


@query(
    "A4_delta_by_strategy",
    f"""{_DELTA} SELECT strategy, false AS is_total, median(delta) AS median, round(avg(delta), 9) AS mean, count(*) AS count
    FROM r GROUP BY strategy UNION ALL SELECT NULL, true, median(delta), round(avg(delta), 9), count(*) FROM r""",
)
def a4(spark, folder):
    out = A.delta_by_strategy(rescore(designs(spark, folder)))
    return out.withColumn("mean", F.round("mean", 9))


@query(
    "A5_subset_statistics",
    f"""WITH {DESIGNS} SELECT count(*) AS n, min(protein_length_aa) AS length_min, max(protein_length_aa) AS length_max,
      round(avg(protein_length_aa), 6) AS length_mean, median(protein_length_aa) AS length_median,
      count(DISTINCT genus) AS n_genera, min(score) AS score_min, max(score) AS score_max FROM designs WHERE strategy = 'B'""",
)
def a5(spark, folder):
    out = A.subset_statistics(designs(spark, folder).filter("strategy = 'B'"))
    return out.withColumn("length_mean", F.round("length_mean", 6))


@query("A6_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def a6(spark, folder):
    return A.value_counts(table(spark, folder, "part"), "p_brand")


@query(
    "A7_gate_pass_counts",
    f"WITH {DESIGNS}, {FLAGS} "
    + " UNION ALL ".join(
        f"SELECT 'gate_{g.upper()}_pass' AS gate, count(*) FILTER ({g}) AS n_pass, count(*) AS n_rows FROM flags"
        for g in "abcde"
    ),
)
def a7(spark, folder):
    return A.gate_pass_counts(apply_gates(designs(spark, folder), TRIAGE_GATES, "annotate"))


@query(
    "A8_confidence_statistics",
    f"""WITH {SQL_ATOMS} SELECT design_id, round(avg(b), 9) AS mean_plddt, min(b) AS min_plddt, max(b) AS max_plddt,
      count(b) AS n_residues, string_agg(printf('%.2f', b), ',' ORDER BY res_seq) AS per_residue FROM atoms GROUP BY design_id""",
)
def a8(spark, folder):
    out = A.confidence_statistics(parse_atoms(atom_lines(spark, folder)))
    text = F.array_join(F.transform("per_residue", lambda b: F.format_string("%.2f", b)), ",")
    return out.withColumns({"mean_plddt": F.round("mean_plddt", 9), "per_residue": text})


@query(
    "A8_confidence_at_positions",
    f"""WITH {SQL_ATOMS} SELECT vec_id AS design_id, coalesce(round(avg(b), 9), 0) AS site_mean, coalesce(min(b), 0) AS site_min,
      count(b) AS site_found FROM embeddings LEFT JOIN atoms ON design_id = vec_id AND res_seq IN (11, 60, 102, 105, 241)
      AND embeddings.label <> 3 GROUP BY vec_id""",
)
def a8_positions(spark, folder):
    sites = F.when(F.col("label") != 3, F.array(*[F.lit(p) for p in K.CATALYTIC_POSITIONS])).otherwise(
        F.array().cast("array<int>")
    )
    wanted = table(spark, folder, "embeddings").select(F.col("vec_id").alias("design_id"), sites.alias("positions"))
    out = A.confidence_at_positions(parse_atoms(atom_lines(spark, folder)), wanted)
    return out.withColumn("site_mean", F.round("site_mean", 9))


@query(
    "A9_active_site_summary",
    f"""WITH {DESIGNS} SELECT strategy, count(*) AS total, count(*) FILTER (mean_plddt >= 75) AS n_pass,
      count(*) FILTER (NOT mean_plddt >= 75) AS n_fail, round(avg(mean_plddt), 6) AS mean_value, min(mean_plddt) AS min_value,
      max(mean_plddt) AS max_value FROM designs GROUP BY strategy""",
)
def a9(spark, folder):
    df = designs(spark, folder).withColumn("passed", F.col("mean_plddt") >= 75)
    out = A.active_site_summary(df, value_col="mean_plddt", flag_col="passed")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "A10_pass_rate",
    f"""WITH {DESIGNS}, c AS (SELECT count(*) AS total, count(*) FILTER (mean_plddt >= 70 AND ptm >= 0.5e0) AS n_pass FROM designs),
    r AS (SELECT *, n_pass / total::DOUBLE AS x FROM c)
    SELECT total, n_pass, total - n_pass AS n_fail, {sql_round('x', 4)} AS pass_rate FROM r""",
)
def a10(spark, folder):
    return A.pass_rate(confidence_gate(designs(spark, folder)), "pass_gate5")


@query(
    "A11_dedupe_first",
    """SELECT l_partkey, l_linenumber, l_quantity, l_orderkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey) = 1""",
)
def a11(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_partkey", "l_linenumber", "l_quantity", "l_orderkey", F.struct("l_orderkey", "l_suppkey").alias("line")
    )
    return A.dedupe_first(rows, ["l_partkey", "l_linenumber"], "line").drop("line")


@query(
    "A12_best_row",
    f"""WITH {DESIGNS} SELECT strategy, S_Immuno, design_id, score FROM designs
    QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY S_Immuno DESC, design_id) = 1""",
)
def a12(spark, folder):
    return A.best_row(designs(spark, folder), ["strategy"], "S_Immuno", "design_id", ["S_Immuno", "design_id", "score"])


@query(
    "A13_distinct_sources",
    """WITH t AS (SELECT label FROM embeddings ORDER BY vec_id DESC LIMIT 5)
    SELECT count(DISTINCT label) AS n_distinct, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS sources,
      count(DISTINCT label) >= 3 AS passes FROM t""",
)
def a13(spark, folder):
    top = table(spark, folder, "embeddings").orderBy(F.desc("vec_id")).limit(5)
    return A.distinct_sources(top, "label").withColumn("sources", F.array_join("sources", ","))


@query(
    "A14_epitopes_removed",
    """SELECT p_partkey, greatest(0, 15 - p_size) AS n_mhc_i_epitopes_removed,
      greatest(0, 92 - p_size * 3) AS n_mhc_ii_epitopes_removed FROM part""",
)
def a14(spark, folder):
    counts = table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").alias("n1"), (F.col("p_size") * 3).alias("n2")
    )
    return A.epitopes_removed(counts).drop("n1", "n2")


@query("A15_fallback_rows", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def a15(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return A.fallback_rows(docs.withColumn("rna_fallback", F.col("toxic") == 1)).select("doc_id")


def _u(tag: str) -> str:
    return f"""((('0x' || substr(md5(s_suppkey || '|' || i || '|42|{tag}'), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0)"""


_NOISY = f"""WITH base AS (SELECT s_suppkey, s_nationkey % 4 AS stratum, (s_acctbal + 1000) / 11000e0 AS score FROM supplier),
c AS (SELECT *, unnest(range(1, 1001)) AS i FROM base),
n AS (SELECT *, score + sqrt(ln({_u('u')}) * -2e0) * cos({_u('v')} * 6.283185307179586e0) * 0.02e0 AS noisy FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY noisy DESC, s_suppkey) AS rank FROM n)"""


def _suppliers(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") % 4).alias("stratum"), ((F.col("s_acctbal") + 1000) / 11000.0).alias("score")
    )


@query(
    "A16_rank_intervals",
    f"""{_NOISY} SELECT s_suppkey, round(quantile_cont(rank, 0.025), 6) AS rank_low, round(quantile_cont(rank, 0.975), 6) AS rank_high,
      round(avg(rank), 6) AS rank_mean FROM r GROUP BY s_suppkey""",
)
def a16(spark, folder):
    out = A.rank_intervals(_suppliers(spark, folder), "s_suppkey", "score")
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("rank_low", "rank_high", "rank_mean")])


@query(
    "A16_top_presence",
    f"""{_NOISY}, h AS (SELECT stratum, count(DISTINCT i) AS n FROM r WHERE rank <= 5 GROUP BY 1)
    SELECT DISTINCT base.stratum, coalesce(n, 0) / 1000e0 AS top_probability FROM base LEFT JOIN h USING (stratum)""",
)
def a16_top(spark, folder):
    return A.top_presence(_suppliers(spark, folder), "s_suppkey", "score", "stratum")


@query(
    "A17_score_ceiling",
    f"""WITH {DESIGNS}, e AS (SELECT *, 1e0 AS S_Energy FROM designs) SELECT strategy, max({sql_weighted(K.PROFILE_V012)}) AS best_observed,
      max({sql_weighted(K.PROFILE_V012, {'S_Deliv': 1.0})}) AS score_ceiling FROM e GROUP BY strategy""",
)
def a17(spark, folder):
    return A.score_ceiling(designs(spark, folder).withColumn("S_Energy", F.lit(1.0)))


_SCENARIOS = {"full maturity": {"S_Mature": 1.0}, "full delivery": {"S_Deliv": 1.0}, "both": {"S_Mature": 1.0, "S_Deliv": 1.0}}


def _scenario(name: str, axes: dict) -> str:
    passes = f"({sql_weighted(K.PROFILE_V010, axes)}) > 0.85e0"
    return f"""SELECT '{name}' AS scenario, count(*) FILTER (score > 0.85e0) AS n_observed, count(*) FILTER ({passes}) AS n_scenario,
    count(*) FILTER ({passes}) - count(*) FILTER (score > 0.85e0) AS n_more,
    count(*) FILTER ({passes} AND NOT score > 0.85e0) AS n_fail_axis_only FROM designs"""


@query("A18_counterfactuals", f"WITH {DESIGNS} " + " UNION ALL ".join(_scenario(n, a) for n, a in _SCENARIOS.items()))
def a18(spark, folder):
    return A.counterfactuals(designs(spark, folder), _SCENARIOS, threshold=0.85)


# --- hypotheses and checks -------------------------------------------------------------------------------------

_T = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END"
H1 = f"""SELECT 'H1' AS test_id, {_T.format('count(*) FILTER (score > 0.929e0) >= 5')} AS verdict,
  count(*) FILTER (score > 0.929e0) AS n_beating, count(*) FILTER (score > 0.9255e0) AS n_beating_calibrated,
  {_T.format('count(*) FILTER (score > 0.9255e0) >= 5')} AS verdict_calibrated FROM designs"""
H2 = f"""SELECT 'H2' AS test_id, {_T.format('count(*) FILTER (S_Cargo = 1 AND S_Deliv >= 0.9e0) >= 1')} AS verdict,
  count(*) FILTER (S_Cargo = 1 AND S_Deliv >= 0.9e0) AS n_satisfying FROM designs"""
H3 = f"""SELECT 'H3' AS test_id, {_T.format('S_Immuno - 0.7594e0 >= 0.1e0')} AS verdict, design_id AS best_design,
  S_Immuno AS best_value, round(S_Immuno - 0.7594e0, 4) AS delta, round(S_Immuno - 0.7243e0, 4) AS delta_secondary
  FROM designs WHERE strategy = 'C' ORDER BY S_Immuno DESC, design_id LIMIT 1"""
ENDS = f"""ends AS (SELECT {sql_round('low', 4)} AS round_low, {sql_round('high', 4)} AS round_high
  FROM (SELECT min(score) AS low, max(score) AS high FROM designs WHERE strategy = 'B'))"""
H4 = f"""SELECT 'H4' AS test_id, {_T.format('count(*) >= 10')} AS verdict, count(*) AS n_survivors,
  min(protein_length_aa) AS length_min, max(protein_length_aa) AS length_max, round(avg(protein_length_aa), 1) AS length_mean,
  count(DISTINCT genus) AS n_genera, round_low AS score_min, round_high AS score_max
  FROM designs, ends WHERE strategy = 'B' GROUP BY round_low, round_high"""


@query("V1_count_test", f"WITH {DESIGNS} {H1}")
def v1(spark, folder):
    return V.hypothesis_count_above(designs(spark, folder))


@query(
    "V1_calibrated_only",
    f"WITH {DESIGNS} SELECT design_id, score FROM designs WHERE score > 0.9255e0 AND NOT score > 0.929e0",
)
def v1_only(spark, folder):
    return V.beaters_calibrated_only(designs(spark, folder)).select("design_id", "score")


@query("V2_existence_test", f"WITH {DESIGNS} {H2}")
def v2(spark, folder):
    return V.hypothesis_existence(designs(spark, folder))


@query("V3_best_gain_test", f"WITH {DESIGNS} {H3}")
def v3(spark, folder):
    return V.hypothesis_best_gain(designs(spark, folder))


@query("V4_survivor_test", f"WITH {DESIGNS}, {ENDS} {H4}")
def v4(spark, folder):
    return V.hypothesis_survivors(designs(spark, folder))


@query(
    "V5_diversity_test",
    f"""WITH {DESIGNS}, t AS (SELECT * FROM designs ORDER BY score DESC, design_id LIMIT 5)
    SELECT 'H5' AS test_id, {_T.format('count(DISTINCT strategy) >= 3')} AS verdict, count(DISTINCT strategy) AS n_distinct,
      string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS sources, false AS diversity_enforced FROM t""",
)
def v5(spark, folder):
    out = V.hypothesis_diversity(designs(spark, folder), sequence_col=None, enforce=False)
    return out.withColumn("sources", F.array_join("sources", ","))


@query(
    "V6_rollup_verdicts",
    f"""WITH {DESIGNS}, {ENDS}, v AS (SELECT verdict FROM ({H1}) UNION ALL SELECT verdict FROM ({H2})
      UNION ALL SELECT verdict FROM ({H4})),
    c AS (SELECT count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'FAIL') AS n_fail FROM v)
    SELECT n_pass, n_fail, 5 - n_pass - n_fail AS n_not_evaluable,
      CASE WHEN n_pass = 3 THEN '{K.ROLLUP_TEXT['three']}' ELSE '{K.ROLLUP_TEXT['rework']}' END AS policy FROM c""",
)
def v6(spark, folder):
    d = designs(spark, folder)
    results = [V.hypothesis_count_above(d), V.hypothesis_existence(d), V.hypothesis_survivors(d)]
    rows = results[0].select("test_id", "verdict")
    for r in results[1:]:
        rows = rows.unionByName(r.select("test_id", "verdict"))
    return V.rollup_verdicts(V.hypothesis_registry(spark), rows)


@query(
    "V6_rollup_policies",
    f"""WITH v AS (SELECT r_regionkey, t, CASE WHEN t <= CASE r_regionkey WHEN 0 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 4 END
      THEN 'PASS' WHEN r_regionkey = 1 THEN 'NOT_EVALUABLE' ELSE 'FAIL' END AS verdict
      FROM region, (SELECT unnest([1, 2, 3, 4, 5]) AS t)),
    c AS (SELECT r_regionkey, count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'FAIL') AS n_fail,
      count(*) FILTER (verdict = 'NOT_EVALUABLE') AS n_not_evaluable FROM v GROUP BY r_regionkey)
    SELECT *, CASE r_regionkey WHEN 0 THEN '{K.ROLLUP_TEXT['all']}' WHEN 1 THEN '{K.ROLLUP_TEXT['four_evaluated']}'
      WHEN 2 THEN '{K.ROLLUP_TEXT['four']}' WHEN 3 THEN '{K.ROLLUP_TEXT['three']}' ELSE '{K.ROLLUP_TEXT['rework']}' END AS policy FROM c""",
)
def v6_policies(spark, folder):
    """Every policy text: five sets of verdicts, one per region."""
    registry = V.hypothesis_registry(spark)
    passing = F.when(F.col("r_regionkey") == 0, 5).when(F.col("r_regionkey") == 3, 3).when(F.col("r_regionkey") == 4, 2).otherwise(4)
    verdict = F.when(F.substring("test_id", 2, 1).cast("int") <= passing, "PASS").when(F.col("r_regionkey") == 1, "NOT_EVALUABLE").otherwise("FAIL")
    tests = registry.select(F.col("id").alias("test_id"))
    results = table(spark, folder, "region").crossJoin(F.broadcast(tests)).withColumn("verdict", verdict)
    out = None
    for key in range(5):  # the regions of the table
        one = V.rollup_verdicts(registry, results.filter(F.col("r_regionkey") == key)).withColumn("r_regionkey", F.lit(key))
        out = one if out is None else out.unionByName(one)
    kind = table(spark, folder, "region").schema["r_regionkey"].dataType
    return out.withColumn("r_regionkey", F.col("r_regionkey").cast(kind))


def _entry(name: str, observed: str, expected: str) -> str:
    return f"SELECT '{name}' AS check, ({observed})::BIGINT AS observed, ({expected})::BIGINT AS expected, ({observed}) = ({expected}) AS passed"


@query(
    "V7_check_invariants",
    " UNION ALL ".join(
        [
            _entry("row_count", "SELECT count(*) FROM orders", "100"),
            _entry("all_true(intrinsic_cargo_mechanism)", "SELECT count(*) FROM orders WHERE NOT o_totalprice > 2000", "0"),
            _entry("all_false(cell_based_evidence)", "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'", "0"),
            _entry("forbidden(parent_editor)", "0", "0"),
            _entry("column_count", "4", "4"),
        ]
    ),
)
def v7(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") > 2000).alias("intrinsic_cargo_mechanism"),
        (F.col("o_orderstatus") == "P").alias("cell_based_evidence"),
        F.col("o_orderpriority").alias("parent_editor"),
    )
    return V.check_invariants(df, 100, 4)


_OUT = "SELECT count(*) FROM designs WHERE NOT {} BETWEEN 0 AND 1"


@query(
    "V8_check_contract",
    f"WITH {DESIGNS} "
    + " UNION ALL ".join(
        [
            _entry("required_columns", "0", "0"),
            _entry("in_range(score)", _OUT.format("score"), "0"),
            *[_entry(f"in_range({a})", _OUT.format(a), "0") for a in K.AXES],
            _entry("allowed(strategy)", "SELECT count(*) FROM designs WHERE strategy NOT IN ('A', 'B', 'C', 'D')", "0"),
            _entry("no_nulls(score)", "SELECT count(*) FROM designs WHERE score IS NULL", "0"),
            _entry("n_beating", "SELECT count(*) FROM designs WHERE score > 0.929e0", "16"),
        ]
    ),
)
def v8(spark, folder):
    extra = [V.count_where("n_beating", F.col("score") > 0.929, 16)]
    return V.check_contract(designs(spark, folder), extra=extra)


@query(
    "V9_validate_profiles",
    """WITH p AS (SELECT l_returnflag AS profile, 'S' || l_linenumber AS axis, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    w AS (SELECT profile, axis, q / sum(q) OVER (PARTITION BY profile) * CASE profile WHEN 'R' THEN 1.1e0 ELSE 1e0 END AS weight FROM p)
    SELECT profile, round(sum(weight), 6) AS weight_sum, count(*) AS n_axes, abs(sum(weight) - 1) < 1e-6 AS valid
    FROM w GROUP BY profile""",
)
def v9(spark, folder):
    from pyspark.sql import Window

    li = table(spark, folder, "lineitem")
    totals = li.groupBy(F.col("l_returnflag").alias("profile"), F.concat(F.lit("S"), "l_linenumber").alias("axis")).agg(
        F.sum("l_quantity").alias("q")
    )
    share = F.col("q") / F.sum("q").over(Window.partitionBy("profile"))
    weights = totals.withColumn("weight", share * F.when(F.col("profile") == "R", 1.1).otherwise(1.0))
    return V.validate_profiles(weights, [f"S{i}" for i in range(1, 8)])


