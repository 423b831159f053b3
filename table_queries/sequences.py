"""Sequence, window and vector functions over the text and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import query, sequences, sql_letters, sql_round, table
from table_queries.scalars import sql_step
from winnow import constants as K
from winnow.functions import sequences as Q
from winnow.functions import windows as W
from winnow.operators.aggregates import binder_load
from winnow.operators.joins import slice_modules
from winnow.operators.neighbours import mean_pairwise_identity

DOCS = f"docs AS (SELECT doc_id, {sql_letters('text')} AS s FROM documents)"
BENCH = f"bench AS (SELECT item_id, {sql_letters('text')} AS s FROM benchmark)"
CODON_CASE = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in K.CODONS.items())
WEIGHT_CASE = " ".join(f"WHEN '{a}' THEN {w}" for a, w in K.WINDOW_WEIGHTS.items())


@query(
    "Q1_translate_codons",
    f"""WITH {DOCS}, c AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS pos, s FROM docs),
    t AS (SELECT doc_id, string_agg(CASE s[pos] {CODON_CASE} ELSE 'NNN' END, '' ORDER BY pos) AS dna FROM c GROUP BY doc_id)
    SELECT doc_id, length(coalesce(dna, '')) AS n, md5(coalesce(dna, '')) AS digest FROM docs LEFT JOIN t USING (doc_id)""",
)
def q1(spark, folder):
    dna = sequences(spark, folder).select("id", Q.translate_codons("sequence").alias("dna"))
    return dna.select(F.col("id").alias("doc_id"), F.length("dna").alias("n"), F.md5("dna").alias("digest"))


@query(
    "Q2_gc_fraction",
    """SELECT doc_id, CASE WHEN length(u) > 0 THEN
      (length(u) - length(regexp_replace(u, '[GC]', '', 'g'))) / length(u)::DOUBLE ELSE 0e0 END AS gc
    FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents)""",
)
def q2(spark, folder):
    return table(spark, folder, "documents").select("doc_id", Q.gc_fraction("text").alias("gc"))


_MOTIFS = {"act": "TION", "bee": "ERES", "cee": "THIN", "dee": "THER", "eel": "ANDE", "eff": "MENT"}
_HITS = " , ".join(f"CASE WHEN contains(s, '{m}') THEN '{n}' END" for n, m in sorted(_MOTIFS.items()))


@query(
    "Q3_motif_hits",
    f"WITH {DOCS} SELECT doc_id, concat_ws(',', {_HITS}) AS hits FROM docs",
)
def q3(spark, folder):
    df = sequences(spark, folder)
    return df.select(F.col("id").alias("doc_id"), F.concat_ws(",", Q.motif_hits("sequence", _MOTIFS)).alias("hits"))


@query(
    "Q4_build_orf",
    f"""WITH {DOCS}, c AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS pos, s FROM docs),
    t AS (SELECT doc_id, string_agg(CASE s[pos] {CODON_CASE} ELSE 'NNN' END, '' ORDER BY pos) AS dna FROM c GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN s LIKE 'T%' THEN 'GCCACC' || 'ATG' || dna || 'TGA' END) AS orf,
      md5(CASE WHEN s LIKE 'M%' THEN 'GCCACC' || dna || 'TGA' END) AS strict
    FROM docs LEFT JOIN t USING (doc_id)""",
)
def q4(spark, folder):
    df = sequences(spark, folder)
    leading = F.when(F.col("sequence").startswith("T"), F.concat(F.lit("M"), "sequence"))
    return df.select(
        F.col("id").alias("doc_id"),
        F.md5(Q.build_orf(leading, strict=False)).alias("orf"),
        F.md5(Q.build_orf("sequence", strict=False)).alias("strict"),
    )


@query(
    "Q5_wrap_text",
    f"""WITH {DOCS} SELECT doc_id, md5(rtrim(regexp_replace(s, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM docs""",
)
def q5(spark, folder):
    return sequences(spark, folder).select(F.col("id").alias("doc_id"), F.md5(Q.wrap_text("sequence")).alias("digest"))


@query(
    "Q6_kmer_windows",
    f"""WITH {DOCS}, w AS (SELECT doc_id, pos, substr(s, pos, 9) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 7)) AS pos FROM docs))
    SELECT doc_id, count(*) AS n, sum(pos * ascii(w[1]))::BIGINT AS firsts, sum(pos * ascii(w[5]))::BIGINT AS middles,
      sum(pos * ascii(w[9]))::BIGINT AS lasts FROM w GROUP BY doc_id""",
)
def q6(spark, folder):
    """All windows of all documents, compared by their number and by sums over position and letters."""
    windows = Q.kmer_windows(sequences(spark, folder), "id", "sequence", 9)
    letter = lambda k: F.sum(F.col("start").cast("long") * F.ascii(F.substring("window", k, 1)))
    return windows.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), letter(1).alias("firsts"), letter(5).alias("middles"), letter(9).alias("lasts")
    )


_WINDOWS = f"""
ch AS (SELECT id, unnest(range(1, length(s) + 1)) AS pos, s FROM src),
w AS (SELECT id, pos, CASE s[pos] {WEIGHT_CASE} ELSE 30 END AS w FROM ch),
sums AS (SELECT id, pos, sum(w) OVER a AS s9, count(*) OVER a AS c9, sum(w) OVER b AS s15, count(*) OVER b AS c15
  FROM w WINDOW a AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING),
    b AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
loads AS (SELECT id, count(*) FILTER (c9 = 9 AND s9 > 43 * 9)::INTEGER AS n1,
    count(*) FILTER (c15 = 15 AND s15 > 38 * 15)::INTEGER AS n2,
    coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (c9 = 9 AND s9 > 43 * 9), '') AS p1,
    coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (c15 = 15 AND s15 > 38 * 15), '') AS p2 FROM sums GROUP BY id)"""


@query(
    "Q7_window_load",
    f"""WITH src AS (SELECT doc_id AS id, {sql_letters('text')} AS s FROM documents), {_WINDOWS}
    SELECT src.id AS doc_id, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n1, 0) + coalesce(n2, 0) * 0.5e0 AS load,
      md5(coalesce(p1, '')) AS starts1, md5(coalesce(p2, '')) AS starts2 FROM src LEFT JOIN loads USING (id)""",
)
def q7(spark, folder):
    load = sequences(spark, folder).withColumn("l", W.window_load("sequence"))
    return load.select(
        F.col("id").alias("doc_id"),
        "l.n1",
        "l.n2",
        F.col("l.weighted_load").alias("load"),
        F.md5(F.array_join("l.positions1", ",")).alias("starts1"),
        F.md5(F.array_join("l.positions2", ",")).alias("starts2"),
    )


@query(
    "Q8_binder_load",
    """WITH b AS (SELECT l_suppkey AS design_id, l_partkey AS pos, l_quantity / 50e0 AS r1, l_quantity AS r2, l_linestatus FROM lineitem),
    n AS (SELECT design_id, count(DISTINCT pos) FILTER (l_linestatus = 'O' AND r1 < 0.5e0)::INTEGER AS n1,
      count(DISTINCT pos) FILTER (l_linestatus = 'F' AND r2 <= 10)::INTEGER AS n2 FROM b GROUP BY design_id)
    SELECT *, n1 + n2 * 0.5e0 AS weighted_load FROM n""",
)
def q8(spark, folder):
    first = F.col("l_linestatus") == "O"
    binders = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("design_id"),
        F.col("l_partkey").alias("pos"),
        F.when(first, "I").otherwise("II").alias("class"),
        F.when(first, F.col("l_quantity") / 50.0).otherwise(F.col("l_quantity")).alias("rank_el"),
    )
    return binder_load(binders)


_SURFACE = "KREDQNSTHYLVIMFWY"
_FROZEN = ", ".join(str(p) for p in K.FROZEN_POSITIONS)
_OPEN = f"""
fz AS (SELECT unnest([{_FROZEN}]) AS pos),
chars AS (SELECT id, unnest(range(1, length(s) + 1)) AS pos, s FROM src),
core AS (SELECT id, pos FROM chars WHERE contains('{_SURFACE}', s[pos]) AND pos NOT IN (SELECT pos FROM fz)),
wide AS (SELECT id, pos FROM core UNION SELECT id, pos - 1 FROM core UNION SELECT id, pos + 1 FROM core),
open AS (SELECT wide.id, wide.pos FROM wide JOIN src USING (id)
  WHERE pos BETWEEN 1 AND length(s) AND pos NOT IN (SELECT pos FROM fz))"""


@query(
    "Q9_mutable_positions",
    f"""WITH src AS (SELECT doc_id AS id, {sql_letters('text')} AS s FROM documents), {_OPEN},
    g AS (SELECT id, count(*) AS n, string_agg(pos, ',' ORDER BY pos) AS p FROM open GROUP BY id)
    SELECT src.id AS doc_id, coalesce(n, 0)::INTEGER AS n, md5(coalesce(p, '')) AS digest FROM src LEFT JOIN g USING (id)""",
)
def q9(spark, folder):
    df = sequences(spark, folder).withColumn("p", W.mutable_positions("sequence"))
    return df.select(F.col("id").alias("doc_id"), F.size("p").alias("n"), F.md5(F.array_join("p", ",")).alias("digest"))


@query(
    "Q10_slice_modules",
    f"""WITH {DOCS} SELECT p_partkey AS name, doc_id AS source_scaffold, p_size AS start_residue, p_size * 3 AS end_residue,
      substr(s, p_size, p_size * 2 + 1) AS sequence FROM part LEFT JOIN docs ON p_partkey % 1500 = doc_id
      WHERE doc_id IS NOT NULL""",
)
def q10(spark, folder):
    modules = table(spark, folder, "part").select(
        F.col("p_partkey").alias("name"),
        (F.col("p_partkey") % 1500).alias("source_scaffold"),
        F.col("p_size").alias("start_residue"),
        (F.col("p_size") * 3).alias("end_residue"),
    )
    return slice_modules(sequences(spark, folder), modules).filter(F.col("sequence").isNotNull())


_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT conv_id, turn, a, b, unnest(range(1, greatest(least(length(a), length(b)), 1) + 1)) AS pos FROM pairs),
hits AS (SELECT conv_id, turn, count(*) FILTER (a[pos] = b[pos] AND pos <= least(length(a), length(b))) AS n,
  any_value(length(a)) AS la, any_value(length(b)) AS lb FROM m GROUP BY ALL)"""


def _turn_pairs(spark, folder):
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return turns.select("conv_id", "turn", F.col("text").alias("a")).join(following, ["conv_id", "turn"])


@query(
    "Q11_positional_identity",
    f"WITH {_PAIRS} SELECT conv_id, turn, n / greatest(la, lb)::DOUBLE AS identity FROM hits WHERE greatest(la, lb) > 0",
)
def q11(spark, folder):
    pairs = _turn_pairs(spark, folder)
    return pairs.select("conv_id", "turn", Q.positional_identity("a", "b").alias("identity")).filter(
        F.col("identity").isNotNull()
    )


@query(
    "Q12_mean_pairwise_identity",
    f"""WITH {BENCH}, p AS (SELECT a.s AS a, b.s AS b FROM bench a JOIN bench b ON a.item_id < b.item_id),
    i AS (SELECT list_sum(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: (a[i] = b[i])::INTEGER))
      / greatest(length(a), length(b)) AS x FROM p)
    SELECT count(*) AS n_pairs, round(avg(x), 9) AS mean_identity FROM i""",
)
def q12(spark, folder):
    return mean_pairwise_identity(sequences(spark, folder, "benchmark"), "sequence").withColumn(
        "mean_identity", F.round("mean_identity", 9)
    )


@query(
    "Q12_mean_pairwise_identity_documents",
    f"""WITH {DOCS}, ch AS (SELECT length(s) AS len, s, unnest(range(1, length(s) + 1)) AS pos FROM docs),
    cells AS (SELECT pos, s[pos] AS c, len, count(*) AS k FROM ch GROUP BY ALL),
    shared AS (SELECT len, k * (k - 1) / 2 + k * coalesce(sum(k) OVER (PARTITION BY pos, c ORDER BY len
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM cells),
    n AS (SELECT count(*) * (count(*) - 1) // 2 AS n_pairs FROM docs)
    SELECT n_pairs, round((SELECT sum(m / len) FROM shared) / n_pairs, 9) AS mean_identity FROM n""",
)
def q12_documents(spark, folder):
    return mean_pairwise_identity(sequences(spark, folder), "sequence").withColumn(
        "mean_identity", F.round("mean_identity", 9)
    )


@query(
    "Q13_apply_mutations",
    f"""WITH {DOCS}, one AS (SELECT doc_id, 'W' || substr(s, 2) AS s FROM docs WHERE length(s) >= 5),
    two AS (SELECT doc_id, substr(s, 1, 4) || 'K' || substr(s, 6) AS s FROM one)
    SELECT doc_id, md5('Y' || substr(s, 2)) AS digest FROM two""",
)
def q13(spark, folder):
    def change(position, residue):
        return F.struct(F.lit(position).alias("position"), F.lit(residue).alias("mut_aa"))

    df = sequences(spark, folder).filter(F.length("sequence") >= 5)
    changes = F.array(change(1, "W"), change(5, "K"), change(1, "Y"))
    return df.select(F.col("id").alias("doc_id"), F.md5(Q.apply_mutations("sequence", changes)).alias("digest"))


@query("Q14_novel_count", f"WITH {_PAIRS} SELECT conv_id, turn, (lb - n)::INTEGER AS novel FROM hits")
def q14(spark, folder):
    return _turn_pairs(spark, folder).select("conv_id", "turn", Q.novel_count("a", "b").alias("novel"))


_ALTS = ", ".join(f"'{a}'" for a in K.SCAN_ALPHABET)
_W_OF = "CASE {} " + WEIGHT_CASE + " ELSE 30 END"
SQL_SCAN = f"""
src AS (SELECT item_id AS id, {sql_letters('text')} AS s FROM benchmark),
{_WINDOWS},
{_OPEN},
alts AS (SELECT unnest([{_ALTS}]) AS mut),
tries AS (SELECT open.id, open.pos, src.s[open.pos] AS wt, mut,
    {_W_OF.format('mut')} - {_W_OF.format('src.s[open.pos]')} AS d, least({sql_step('src.s[open.pos]', 'mut')}, 5e0) AS c
  FROM open JOIN src USING (id) CROSS JOIN alts WHERE mut <> src.s[open.pos]),
priced AS (SELECT id, pos, wt, mut, d, {sql_round('c', 2)} AS cost FROM tries),
scan AS (SELECT t.id, t.pos, t.wt, t.mut, t.cost,
    coalesce(sum(CASE WHEN c9 = 9 AND x.pos >= t.pos - 8 THEN (s9 + d > 387)::INTEGER - (s9 > 387)::INTEGER ELSE 0 END), 0)
    + coalesce(sum(CASE WHEN c15 = 15 THEN (s15 + d > 570)::INTEGER - (s15 > 570)::INTEGER ELSE 0 END), 0) * 0.5e0 AS load_delta
  FROM priced t JOIN sums x ON x.id = t.id AND x.pos BETWEEN t.pos - 14 AND t.pos WHERE cost <= 3 GROUP BY ALL)"""


@query(
    "Q15_substitution_scan",
    f"WITH {SQL_SCAN} SELECT id AS item_id, pos::INTEGER AS \"position\", wt, mut, cost, load_delta FROM scan",
)
def q15(spark, folder):
    return W.substitution_scan(sequences(spark, folder, "benchmark"), "id", "sequence").withColumnRenamed("id", "item_id")


# the same scan over all documents: windows that cover a place as short lists, the best substitution of each text
SQL_BEST = f"""
src AS (SELECT doc_id AS id, {sql_letters('text')} AS s FROM documents),
{_WINDOWS},
{_OPEN},
cover AS (SELECT id, pos,
    list(CASE WHEN c9 = 9 THEN s9 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l9,
    list(CASE WHEN c15 = 15 THEN s15 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l15 FROM sums),
spots AS (SELECT open.id, open.pos, src.s[open.pos] AS wt, {_W_OF.format('src.s[open.pos]')} AS w, l9, l15
  FROM open JOIN src USING (id) JOIN cover USING (id, pos)),
alts AS (SELECT mut, {_W_OF.format('mut')} AS w FROM (SELECT unnest([{_ALTS}]) AS mut)),
steps AS (SELECT wt, mut, alts.w AS w_new, least({sql_step('wt', 'mut')}, 5e0) AS c FROM (SELECT DISTINCT wt FROM spots) CROSS JOIN alts WHERE mut <> wt),
priced AS (SELECT wt, mut, w_new, {sql_round('c', 2)} AS cost FROM steps),
turned AS (SELECT id, pos, wt, w_new,
    len(list_filter(l9, lambda x: x + w_new - w > 387)) - len(list_filter(l9, lambda x: x > 387)) AS change1,
    len(list_filter(l15, lambda x: x + w_new - w > 570)) - len(list_filter(l15, lambda x: x > 570)) AS change2
  FROM spots CROSS JOIN (SELECT DISTINCT w AS w_new FROM alts)),
changed AS (SELECT id, pos, wt, mut, cost, change1, change2 FROM turned JOIN priced USING (wt, w_new) WHERE cost <= 3),
totals AS (SELECT id, count(*) AS n_allowed, count(*) FILTER (change1 + change2 * 0.5e0 < 0) AS n_lowering,
    arg_min(struct_pack(pos := pos, wt := wt, mut := mut, cost := cost, change1 := change1, change2 := change2),
      struct_pack(a := change1 + change2 * 0.5e0, b := cost, c := pos, d := mut)) AS best FROM changed GROUP BY id)"""


@query(
    "Q15_best_substitutions_documents",
    f"""WITH {SQL_BEST} SELECT src.id AS doc_id, coalesce(n_allowed, 0) AS n_allowed, coalesce(n_lowering, 0) AS n_lowering,
      best.pos::INTEGER AS "position", best.wt AS wt, best.mut AS mut, best.cost AS cost, best.change1 + best.change2 * 0.5e0 AS load_delta
    FROM src LEFT JOIN totals USING (id)""",
)
def q15_documents(spark, folder):
    found = W.best_substitutions(sequences(spark, folder), "id", "sequence").withColumn("b", F.get("best", F.lit(0)))
    return found.select(
        F.col("id").alias("doc_id"), "n_allowed", "n_lowering", "b.position", "b.wt", "b.mut", "b.cost", "b.load_delta"
    )


_FRACTIONS = ", ".join(f"{p / K.CATALYTIC_LENGTH!r}e0" for p in K.CATALYTIC_POSITIONS)
_LISTED = ", ".join(str(p) for p in K.CATALYTIC_POSITIONS)


@query(
    "Q16_mapped_positions",
    f"""WITH f AS (SELECT doc_id, n_chars, unnest([{_FRACTIONS}]) AS f FROM documents WHERE lang = 'en'),
    c AS (SELECT doc_id, n_chars, f * n_chars AS x FROM f),
    r AS (SELECT doc_id, n_chars, CASE WHEN x - floor(x) > 0.5 OR (x - floor(x) = 0.5 AND floor(x) % 2 = 1)
      THEN floor(x) + 1 ELSE floor(x) END AS m FROM c),
    p AS (SELECT doc_id, greatest(1, least(n_chars, m + unnest([-1, 0, 1])))::INTEGER AS pos FROM r),
    b AS (SELECT doc_id, string_agg(pos, ',' ORDER BY pos) AS positions FROM (SELECT DISTINCT doc_id, pos FROM p) GROUP BY doc_id),
    a AS (SELECT doc_id, unnest([{_LISTED}]) AS pos, n_chars FROM documents WHERE lang = 'fr'),
    g AS (SELECT doc_id, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (pos <= n_chars), '') AS positions FROM a GROUP BY doc_id)
    SELECT * FROM b UNION ALL SELECT * FROM g UNION ALL SELECT doc_id, '' FROM documents WHERE lang NOT IN ('en', 'fr')""",
)
def q16(spark, folder):
    strategy = F.when(F.col("lang") == "en", "B").when(F.col("lang") == "fr", "A").otherwise("X")
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(Q.mapped_positions(strategy, F.col("n_chars").cast("int")), ",").alias("positions")
    )


@query(
    "Q17_cosine_distance",
    """SELECT a.vec_id, round(CASE WHEN list_sum(a.embedding::DOUBLE[]) = 0 OR list_sum(b.embedding::DOUBLE[]) = 0 THEN 1e0
      ELSE 1e0 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def q17(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select(
        "vec_id", F.round(Q.cosine_distance("embedding", "other"), 6).alias("distance")
    )


@query(
    "Q18_assemble_parts",
    """SELECT o_orderkey, o_orderstatus || 'GGGGS' || o_orderpriority || 'GGGGS' || o_custkey AS text FROM orders""",
)
def q18(spark, folder):
    parts = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select(
        "o_orderkey", Q.assemble_parts(parts, F.lit("GGGGS")).alias("text")
    )
