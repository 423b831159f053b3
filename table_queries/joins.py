"""Joins, neighbours and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, query, table
from winnow import constants as K
from winnow.operators import joins as J
from winnow.operators import neighbours as N
from winnow.operators import sets as U
from winnow.sources.predictions import parse_atoms
from winnow.operators.gates import apply_gates
from winnow.session import scratch_path
from winnow.sources.catalog import load_registry
from winnow.sources.registry import compile_gates, gate_rows, read_nested, write_nested


@query(
    "J1_enrich_metadata",
    """SELECT doc_id, coalesce(CASE WHEN n_chars % 3 <> 0 THEN n_chars END, quality * 100 + 200)::INTEGER AS protein_length_aa,
      coalesce(CASE WHEN lang = 'en' THEN source || ' en' END, 'Toxic' || toxic || ' sp', 'Unknown') AS organism,
      CASE WHEN lang = 'en' THEN source WHEN toxic IS NOT NULL THEN 'Toxic' || toxic ELSE 'Unknown' END AS genus
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def j1(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).cast("int").alias("protein_length_aa"),
        F.when(F.col("lang") == "en", F.concat_ws(" ", "source", "lang")).alias("organism"),
    )
    meta = table(spark, folder, "labels").select(
        "doc_id",
        (F.col("quality") * 100 + 200).alias("protein_length_aa"),
        F.concat(F.lit("Toxic"), "toxic", F.lit(" sp")).alias("organism"),
    )
    return J.enrich_metadata(docs, meta, "doc_id")


def _novelty(spark, folder, known="label = 0", **options):
    """Embeddings of the labels in `known` are the known set, everything else is a candidate."""
    e = table(spark, folder, "embeddings")
    candidates = e.filter(f"NOT ({known})").select("vec_id", "label")
    known = e.filter(known).select("vec_id")
    return N.novelty_gate(candidates, e.select("vec_id", "embedding"), known, "vec_id", **options)


_NOVEL = """WITH d AS (SELECT c.vec_id, c.label, min(CASE WHEN list_sum(c.embedding::DOUBLE[]) = 0 OR list_sum(k.embedding::DOUBLE[]) = 0
    THEN 1e0 ELSE 1e0 - list_cosine_similarity(c.embedding::DOUBLE[], k.embedding::DOUBLE[]) END) AS distance
  FROM embeddings c JOIN embeddings k ON k.label = 0 WHERE c.label <> 0 GROUP BY ALL)
SELECT vec_id, label, round(distance, 4) AS gate_6_distance, true AS gate_6_pass FROM d WHERE distance > 0.5e0"""


@query("J2_novelty_gate", _NOVEL)
def j2(spark, folder):
    return _novelty(spark, folder, threshold=0.5)


@query("J2_novelty_gate_large_known_set", _NOVEL.replace("k.label = 0 WHERE c.label <> 0", "k.label <> 3 WHERE c.label = 3").replace("> 0.5e0", "> 0.6e0"))
def j2_many_shards(spark, folder):
    """Nine tenths of the vectors are known, dealt over dozens of shards."""
    return _novelty(spark, folder, known="label <> 3", threshold=0.6, pivots=64, rows=16)


@query("J3_known_set", "SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
def j3(spark, folder):
    a = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("key"))
    b = table(spark, folder, "customer").select(F.col("c_nationkey").alias("key"))
    return N.known_set(a, b, "key")


@query(
    "J4_generate_chimeras",
    """WITH m AS (SELECT n_nationkey, n_name, 'R' || n_regionkey AS core FROM nation),
    cores AS (SELECT core, list(n_name ORDER BY n_nationkey) AS parts FROM m GROUP BY core),
    guides AS (SELECT s_suppkey, s_name FROM supplier),
    links AS (SELECT r_regionkey, r_name FROM region),
    p AS (SELECT core, s_name, r_name, s_suppkey, r_regionkey,
      list_transform(list_append(parts, s_name), lambda x: repeat(x, 4)) AS t FROM cores, guides, links),
    x AS (SELECT *, replace(array_to_string(t, chr(1)), chr(1), r_name) AS full_sequence FROM p),
    n AS (SELECT *, row_number() OVER (ORDER BY core, s_suppkey, r_regionkey) AS rank FROM x
      WHERE length(full_sequence) BETWEEN 250 AND 1200)
    SELECT printf('A_%03d_%s_%s_%s', rank, core, s_name, r_name) AS design_id, full_sequence,
      length(full_sequence)::INTEGER AS total_aa FROM n""",
)
def j4(spark, folder):
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    modules = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("source_scaffold"))
    modules = modules.union(supplier.select("s_name", F.lit("S"))).withColumn("sequence", F.expr("repeat(name, 4)"))
    cores = nation.groupBy(F.concat(F.lit("R"), "n_regionkey").alias("core")).agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("p")
    )
    cores = cores.select(
        F.regexp_extract("core", r"\d+", 0).cast("int").alias("core_rank"),
        "core",
        F.transform("p", lambda x: x["n_name"]).alias("parts"),
    )
    guides = supplier.select(
        F.col("s_suppkey").alias("guide_rank"), F.col("s_name").alias("guide"), F.col("s_name").alias("guide_module")
    )
    linkers = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("linker_rank"),
        F.col("r_name").alias("linker"),
        F.col("r_name").alias("linker_sequence"),
    )
    return J.generate_chimeras(modules, cores, guides, linkers).select("design_id", "full_sequence", "total_aa")


@query(
    "J5_calibrated_only",
    f"WITH {DESIGNS} SELECT design_id, score FROM designs WHERE score > 0.85e0 AND NOT score > 0.9e0",
)
def j5(spark, folder):
    d = designs(spark, folder).select("design_id", "score")
    return J.calibrated_only(d.filter("score > 0.85D"), d.filter("score > 0.9D"), "design_id")


@query(
    "J6_membership_flag",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS big
    FROM customer""",
)
def j6(spark, folder):
    members = table(spark, folder, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 450000")
    members = members.select(F.col("o_custkey").alias("c_custkey"))
    return J.membership_flag(table(spark, folder, "customer").select("c_custkey"), members, "c_custkey", "big")


@query(
    "J7_attach_results",
    "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def j7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return J.attach_results(docs, table(spark, folder, "labels"), "doc_id", ["quality", "toxic"])


@query(
    "J8_skip_done",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    AND doc_id NOT IN (SELECT item_id FROM benchmark)""",
)
def j8(spark, folder):
    done = [
        table(spark, folder, "labels").select("doc_id"),
        table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id")),
    ]
    return J.skip_done(table(spark, folder, "documents").select("doc_id"), done, "doc_id")


def atom_lines(spark, folder):
    """Every embedding as a structure: residue i at three neighbouring coordinates, in fixed-width text."""
    e = table(spark, folder, "embeddings")

    def coordinate(i, shift):
        return F.get("embedding", F.pmod(i + shift, F.lit(64))).cast("double") * 100.0

    spot = F.posexplode("embedding").alias("i", "v")
    rows = e.select(F.col("vec_id").alias("design_id"), "label", "embedding", spot)
    line = F.format_string(
        "ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00%6.2f",
        F.col("i") + 1,
        F.col("i") + 1,
        coordinate(F.col("i"), 0),
        coordinate(F.col("i"), 1),
        coordinate(F.col("i"), 2),
        F.abs(coordinate(F.col("i"), 0)),
    )
    return rows.select("design_id", "label", F.col("i").cast("long").alias("line"), line.alias("value"))


SQL_ATOMS = """atoms AS (SELECT vec_id AS design_id, label, i::INTEGER AS res_seq,
  round(embedding[i]::DOUBLE * 100e0, 3) AS x, round(embedding[(i % 64) + 1]::DOUBLE * 100e0, 3) AS y,
  round(embedding[((i + 1) % 64) + 1]::DOUBLE * 100e0, 3) AS z, round(abs(embedding[i]::DOUBLE * 100e0), 2) AS b
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""


@query(
    "J9_check_geometry",
    f"""WITH {SQL_ATOMS}, pairs AS (SELECT * FROM (VALUES (11, 60, 22.1e0), (11, 40, 18.4e0), (11, 50, 16.9e0), (40, 60, 9.8e0),
      (40, 50, 11.5e0), (50, 60, 3.8e0)) AS t(r1, r2, dist)),
    d AS (SELECT a.design_id, abs(round(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)), 2)
      - dist) AS dev FROM pairs JOIN atoms a ON a.res_seq = r1 JOIN atoms c ON c.res_seq = r2 AND c.design_id = a.design_id)
    SELECT design_id, max(dev) <= 20 AS active_site_valid, round(max(dev), 3) AS active_site_max_dev FROM d GROUP BY design_id""",
)
def j9(spark, folder):
    lines = atom_lines(spark, folder)
    pairs = [(11, 60, 22.1), (11, 40, 18.4), (11, 50, 16.9), (40, 60, 9.8), (40, 50, 11.5), (50, 60, 3.8)]
    references = spark.createDataFrame(
        [("IS621", [11, 40, 50, 60], pairs)],
        "reference_id string, residues array<int>, pairs array<struct<r1:int,r2:int,dist:double>>",
    )
    structures = table(spark, folder, "embeddings").select(F.col("vec_id").alias("design_id"))
    return J.check_geometry(structures, parse_atoms(lines), references, tolerance=20.0).select(
        "design_id", "active_site_valid", "active_site_max_dev"
    )


@query(
    "J10_merge_sources",
    """SELECT 'supplier' AS source, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT 'customer', c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def j10(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return J.merge_sources([("supplier", s), ("customer", c)])


@query(
    "J11_lookup_required",
    "SELECT c_custkey, c_nationkey AS n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def j11(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return J.lookup_required(customers, table(spark, folder, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query(
    "J12_compare_versions",
    """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT k, o.v AS v_old, n.v AS v_new, n.v - o.v AS v_delta FROM o FULL JOIN n USING (k)""",
)
def j12(spark, folder):
    orders = table(spark, folder, "orders")

    def version(status):
        part = orders.filter(F.col("o_orderstatus") == status)
        return part.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))

    return J.compare_versions(version("O"), version("F"), "k", ["v"])


@query(
    "U1_union_sources",
    "SELECT 'a' AS source, p_partkey AS id, p_brand, NULL AS o_orderstatus FROM part UNION ALL SELECT 'b', o_orderkey, NULL, o_orderstatus FROM orders",
)
def u1(spark, folder):
    a = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    b = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return U.union_sources([("a", a), ("b", b)])


@query(
    "U2_dedupe_by_source",
    """WITH u AS (SELECT 'orders' AS source, o_custkey AS id, o_orderkey AS ref FROM orders
      UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer)
    SELECT source, id, ref FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY source <> 'customer', ref) = 1""",
)
def u2(spark, folder):
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ref"))
    b = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("ref")
    )
    merged = U.union_sources([("orders", a), ("customer", b)])
    return U.dedupe_by_source(merged, "id", "source", ["customer", "orders"], "ref").select("source", "id", "ref")


@query("U3_id_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u3(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return U.id_difference(a, b, "id")


@query("U4_id_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u4(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return U.id_intersection(a, b, "id")


@query("U5_exclude_recoveries", "SELECT p_partkey, p_name FROM part WHERE p_name <> 'red widget'")
def u5(spark, folder):
    return U.exclude_recoveries(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "red widget")


@query("U5_exclude_known_sequences", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def u5_table(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return U.exclude_known_sequences(docs, table(spark, folder, "benchmark").select("text"), "text").select("doc_id")


_SCAFFOLD_ROWS = ", ".join(
    f"({i}, '{s[0]}', {'NULL' if s[3] is None else repr(s[3]) + 'e0'}, {len(s[7])})" for i, s in enumerate(K.SCAFFOLDS)
)


@query(
    "S15_registry_scaffolds",
    f"""WITH r(i, scaffold, score, n_modules) AS (VALUES {_SCAFFOLD_ROWS})
    SELECT s_suppkey, scaffold, score, n_modules::INTEGER AS n_modules FROM supplier JOIN r ON i = s_suppkey % {len(K.SCAFFOLDS)}""",
)
def s15_scaffolds(spark, folder):
    names = F.array(*[F.lit(s[0]) for s in K.SCAFFOLDS])
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % len(K.SCAFFOLDS)).cast("int")).alias("id"))
    joined = J.lookup_required(suppliers, load_registry(spark, "scaffolds"), "id")
    return joined.select("s_suppkey", F.col("id").alias("scaffold"), "score", F.size("modules").alias("n_modules"))


@query("S15_registry_geometry", "SELECT vec_id, label, CASE WHEN label % 3 = 0 THEN 5 ELSE 1 END AS n_sites FROM embeddings")
def s15_geometry(spark, folder):
    names = F.array(*[F.lit(x) for x in K.GEOMETRY_RESIDUES])
    e = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.get(names, F.col("label") % 3).alias("reference_id")
    )
    joined = J.lookup_required(e, load_registry(spark, "geometry"), "reference_id")
    return joined.select("vec_id", "label", F.size("residues").alias("n_sites"))


_GATED = f"""design_id, composite_prob >= {K.GATE_PROBABILITY}e0 AS gate_1_pass, composite AS gate_2_pass,
  protein_length_aa BETWEEN {K.GATE_LENGTH[0]} AND {K.GATE_LENGTH[1]} AS gate_3_pass, mean_plddt >= {K.GATE_GLOBAL_PLDDT}e0 AS gate_5_global_pass"""


@query(
    "S15_gates_from_table",
    f"""WITH {DESIGNS}, f AS (SELECT {_GATED} FROM designs)
    SELECT *, CASE WHEN NOT gate_1_pass THEN '1' WHEN NOT gate_2_pass THEN '2' WHEN NOT gate_3_pass THEN '3'
      WHEN NOT gate_5_global_pass THEN '5_global' END AS first_failed_gate FROM f""",
)
def s15_gates(spark, folder):
    """The gates of strategy B, written as a registry file, read back typed and compiled, run over all designs."""
    path = scratch_path(spark, "strategies")
    write_nested(load_registry(spark, "strategies"), path)
    gates = compile_gates(gate_rows(read_nested(spark, path, "strategies")), "B")
    flagged = apply_gates(designs(spark, folder), gates, "annotate")
    return flagged.select("design_id", "gate_1_pass", "gate_2_pass", "gate_3_pass", "gate_5_global_pass", "first_failed_gate")


_STRATEGY_ROWS = ", ".join(f"('{s[0]}', '{s[1]}', {s[3]}, {len(s[4])})" for s in K.STRATEGY_REGISTRY)


@query(
    "S15_registry_strategies",
    f"""WITH {DESIGNS}, r(strategy, name, target, n_gates) AS (VALUES {_STRATEGY_ROWS})
    SELECT strategy, name, target::INTEGER AS target, n_gates::INTEGER AS n_gates, count(*) AS n FROM designs JOIN r USING (strategy) GROUP BY ALL""",
)
def s15_strategies(spark, folder):
    registry = load_registry(spark, "strategies").select(F.col("id").alias("strategy"), "name", F.col("target_n_designs").alias("target"), F.size("gates").alias("n_gates"))
    joined = designs(spark, folder).select("strategy").join(registry, "strategy")
    return joined.groupBy("strategy", "name", "target", "n_gates").agg(F.count(F.lit(1)).alias("n"))
