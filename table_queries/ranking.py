"""Caps, top-k and diversity rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, num, query, table
from winnow import constants as K
from winnow.operators import ranking as R


@query(
    "W1_cap_per_genus",
    f"""WITH {DESIGNS} SELECT design_id, genus, composite_prob FROM designs
    QUALIFY row_number() OVER (PARTITION BY genus ORDER BY composite_prob DESC, design_id) <= 5""",
)
def w1(spark, folder):
    return R.cap_per_genus(designs(spark, folder), id_col="design_id").select("design_id", "genus", "composite_prob")


@query(
    "W1_cap_per_customer",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def w1_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.cap_per_group(orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(
    "W2_top_by_product",
    f"""WITH {DESIGNS}, t AS (SELECT design_id, mean_plddt * ptm AS rank_score FROM designs WHERE strategy = 'B'
      ORDER BY rank_score DESC, design_id LIMIT 150)
    SELECT design_id, rank_score, row_number() OVER (ORDER BY rank_score DESC, design_id) AS rank,
      min(rank_score) OVER () AS cutoff FROM t""",
)
def w2(spark, folder):
    part = designs(spark, folder).filter("strategy = 'B'")
    return R.top_by_product(part, "mean_plddt", "ptm", "design_id").select("design_id", "rank_score", "rank", "cutoff")


@query(
    "W3_tiered_selection",
    f"""WITH {DESIGNS} SELECT design_id, strategy FROM designs WHERE strategy IN ('A', 'C')
    UNION ALL SELECT design_id, strategy FROM designs WHERE strategy = 'D' AND ptm <= 0.75e0
    UNION ALL SELECT design_id, strategy FROM (SELECT * FROM designs WHERE strategy = 'B' ORDER BY score DESC, design_id LIMIT 150)""",
)
def w3(spark, folder):
    rules = {"A": "all", "B": 150, "C": "all", "D": F.col("ptm") <= 0.75}
    order = R.by_score("score", "design_id")
    return R.tiered_selection(designs(spark, folder), "strategy", rules, order).select("design_id", "strategy")


# parts by price, with the first brand made to crowd the top
CROWD = """crowd AS (SELECT p_partkey AS id, CASE WHEN p_retailprice >= 999 THEN 'Brand#1' ELSE p_brand END AS brand,
  p_retailprice AS score FROM part),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM crowd)"""


def crowd(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_retailprice") >= 999, "Brand#1").otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_retailprice").alias("score"),
    )


SWAPPED = f"""{CROWD},
top AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rank) AS k, count(*) OVER (PARTITION BY brand) AS c
  FROM ranked WHERE rank <= 5),
out AS (SELECT id, brand, rank FROM top WHERE c >= 4 AND k = 4),
alt AS (SELECT r.id, r.brand, r.score, out.id AS out_id, out.rank AS out_rank, out.brand AS out_brand
  FROM ranked r, out WHERE r.rank > 5 AND r.brand <> out.brand ORDER BY r.rank LIMIT 1),
placed AS (SELECT r.id, r.brand, r.score,
    CASE WHEN r.id IN (SELECT id FROM alt) THEN 0 WHEN r.id IN (SELECT out_id FROM alt) THEN 1
      WHEN rank <= 5 THEN 0 ELSE 1 END AS block,
    coalesce((SELECT 'anti_mode_collapse: replaced rank-' || out_rank || ' ' || out_brand || ' with ' || alt.brand
      FROM alt WHERE alt.id = r.id), '') AS diversity_note FROM ranked r),
swapped AS (SELECT id, brand, score, diversity_note, row_number() OVER (ORDER BY block, score DESC, id) AS diversity_rank FROM placed)"""


@query("W4_swap_top", f"WITH {SWAPPED} SELECT * FROM swapped WHERE diversity_rank <= 50")
def w4(spark, folder):
    return R.swap_top(crowd(spark, folder), "score", "brand", "id")


@query(
    "W5_enforce_diversity",
    f"""WITH {SWAPPED}, r0 AS (SELECT * FROM swapped WHERE diversity_rank <= 50),
    have AS (SELECT brand, count(*) AS n FROM r0 GROUP BY brand),
    best AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, id) AS k FROM crowd),
    extra AS (SELECT best.id, best.brand, best.score, '' AS diversity_note FROM best LEFT JOIN have USING (brand)
      WHERE k <= 5 AND coalesce(n, 0) < 5 AND id NOT IN (SELECT id FROM r0)),
    both_ AS (SELECT id, brand, score, diversity_note FROM r0 UNION ALL SELECT * FROM extra)
    SELECT id, brand, score, diversity_note, row_number() OVER (ORDER BY score DESC, id) AS diversity_rank FROM both_
    QUALIFY diversity_rank <= 50""",
)
def w5(spark, folder):
    return R.enforce_diversity(crowd(spark, folder), score_col="score", stratum_col="brand", id_col="id")


@query(
    "W6_diverse_top",
    f"""WITH {CROWD}, top AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rank) AS k FROM ranked WHERE rank <= 5),
    need AS (SELECT greatest(0, 3 - count(DISTINCT brand)) AS n FROM top),
    arrive AS (SELECT id, brand, score FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rank) AS k FROM ranked
      WHERE brand NOT IN (SELECT brand FROM top)) WHERE k = 1
      QUALIFY row_number() OVER (ORDER BY score DESC, id) <= (SELECT n FROM need)),
    leave AS (SELECT id FROM top WHERE k > 1 QUALIFY row_number() OVER (ORDER BY rank DESC) <= (SELECT count(*) FROM arrive)),
    kept AS (SELECT id, brand, score, false AS diversity_enforced FROM top WHERE id NOT IN (SELECT id FROM leave)
      UNION ALL SELECT id, brand, score, true FROM arrive)
    SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kept""",
)
def w6(spark, folder):
    return R.diverse_top(crowd(spark, folder), 5, 3, "score", "brand", "id")


@query(
    "W7_catalog_rank",
    f"WITH {DESIGNS} SELECT design_id, row_number() OVER (ORDER BY score DESC, design_id) AS rank FROM designs",
)
def w7(spark, folder):
    return R.catalog_rank(designs(spark, folder).select("design_id", "score")).select("design_id", "rank")


@query("W8_beaters", f"WITH {DESIGNS} SELECT design_id, score FROM designs WHERE score > 0.85e0")
def w8(spark, folder):
    return R.beaters(designs(spark, folder).select("design_id", "score"), 0.85)


@query("W9_top_k", f"WITH {DESIGNS} SELECT design_id, score FROM designs ORDER BY score DESC, design_id LIMIT 20")
def w9(spark, folder):
    return R.top_k(designs(spark, folder).select("design_id", "score"), 20)


@query("W10_sort_variants", "SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_size, p_partkey")
def w10(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size")
    return R.sort_variants(part, "p_retailprice", "p_size", "p_partkey")


@query(
    "W11_dedupe_variants",
    """WITH v AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber || l_returnflag))) AS f,
      max(l_quantity) AS gain, min(l_quantity) AS cost FROM lineitem GROUP BY l_orderkey),
    u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY f ORDER BY gain DESC, cost, l_orderkey) = 1),
    t AS (SELECT *, row_number() OVER (ORDER BY gain DESC, cost, l_orderkey) AS rank FROM u)
    SELECT printf('C_%03d', rank) AS variant_id, gain AS predicted_s_immuno_delta, cost AS predicted_ddg_total FROM t WHERE rank <= 50""",
)
def w11(spark, folder):
    change = F.struct(F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("mut_aa"))
    variants = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("variant_id")).agg(
        F.collect_list(change).alias("mutations_introduced"),
        F.max("l_quantity").alias("predicted_s_immuno_delta"),
        F.min("l_quantity").alias("predicted_ddg_total"),
    )
    return R.dedupe_variants(variants, 50).drop("mutations_introduced")


@query("W12_sort_novel_first", "SELECT l_partkey, l_suppkey, min(l_discount) AS identity FROM lineitem GROUP BY 1, 2")
def w12(spark, folder):
    pairs = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_discount").alias("identity"))
    return R.sort_novel_first(pairs, "identity", "l_partkey")


_GAPS = ", ".join(f"(1e0 - {a}) * {num(w)}" for a, w in K.PROFILE_V010.items())
_NAMES = ", ".join(f"'{a}'" for a in K.PROFILE_V010)


@query(
    "W13_nearest_misses",
    f"""WITH {DESIGNS}, t AS (SELECT * FROM designs WHERE score <= 0.929e0 ORDER BY score DESC, design_id LIMIT 10),
    g AS (SELECT *, [{_GAPS}] AS gaps FROM t)
    SELECT design_id, score - 0.929e0 AS margin, list_max(gaps) AS barrier_gap,
      [{_NAMES}][list_position(gaps, list_max(gaps))] AS barrier_axis FROM g""",
)
def w13(spark, folder):
    return R.nearest_misses(designs(spark, folder)).select("design_id", "margin", "barrier_gap", "barrier_axis")
