"""Readers and writers, exercised as round trips of the driver's tables through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import DESIGNS, designs, query, sequences, sql_letters, table
from table_queries.joins import SQL_ATOMS, atom_lines
from winnow.operators.aggregates import dedupe_first
from winnow.session import scratch_path
from winnow.sources import catalog, fasta, manifest, predictions


@query("S1_read_catalog_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def s1(spark, folder):
    schema = "o_orderkey bigint, o_totalprice double"
    return catalog.read_catalog(spark, f"{folder}/orders.parquet", schema=schema)


@query("S2_read_catalog_csv", "SELECT * FROM customer")
def s2(spark, folder):
    customers = table(spark, folder, "customer")
    path = scratch_path(spark, "csv")
    catalog.write_catalog(customers, path, fmt="csv")
    return catalog.read_catalog(spark, path, "csv", customers.schema)


def _written_fasta(spark, folder):
    """Every third id begins with '#', and every file with lines that belong to no record."""
    docs = sequences(spark, folder).join(
        table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id"
    )
    named = docs.withColumn("id", F.concat(F.when(F.col("id") % 3 == 0, "#").otherwise(""), "id"))
    path = scratch_path(spark, "fasta")
    records = fasta.format_records(named, "id", "sequence", [("lang", "lang", "%s"), ("source", "source", "%s")])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    preamble = F.when(first, "free text preamble\n# note\n\n").otherwise("")
    records.withColumn("value", F.concat(preamble, "value")).write.text(path)
    return fasta.read_fasta(spark, path)


_DOCS = f"""d AS (SELECT (CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END) || doc_id AS id, lang, source,
  {sql_letters('text')} AS s FROM documents)"""


@query(
    "S3_read_fasta",
    f"""WITH {_DOCS} SELECT id, id || ' [lang=' || lang || '] [source=' || source || ']' AS header,
      length(s) AS n, md5(s) AS digest FROM d WHERE length(s) > 0""",
)
def s3(spark, folder):
    records = _written_fasta(spark, folder)
    return records.select("id", "header", F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


@query("S4_parse_header_tags", f"WITH {_DOCS} SELECT id, lang, source FROM d WHERE length(s) > 0")
def s4(spark, folder):
    tagged = fasta.parse_header_tags(_written_fasta(spark, folder), tags=["lang", "source"])
    return tagged.select("id", "lang", "source")


@query(
    "S5_write_fasta",
    f"""WITH b AS (SELECT doc_id, {sql_letters('text')} AS s FROM documents)
    SELECT doc_id, md5('>' || doc_id || ' [length=' || length(s) || 'aa]' || chr(10)
      || rtrim(regexp_replace(s, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM b WHERE length(s) > 0""",
)
def s5(spark, folder):
    docs = sequences(spark, folder).withColumn("n", F.length("sequence"))
    lines = fasta.format_records(docs, "id", "sequence", [("length", "n", "%daa")])
    doc_id = F.regexp_extract("value", "^>([0-9]+) ", 1).cast("long")
    return lines.select(doc_id.alias("doc_id"), F.md5("value").alias("digest"))


@query("S6_write_catalog", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part")
def s6(spark, folder):
    path = scratch_path(spark, "catalog")
    wanted = ["p_partkey", "p_brand", "p_type", "p_retailprice", "not_there"]
    catalog.write_catalog(table(spark, folder, "part"), path, wanted, partition_by=["p_type"])
    return catalog.read_catalog(spark, path)


@query("S7_write_records_json", "SELECT doc_id, quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id)")
def s7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    path = scratch_path(spark, "records")
    catalog.write_records_json(joined, path)
    return spark.read.schema(joined.schema).json(path)


def _page_manifest(spark, folder):
    pages = table(spark, folder, "pages").withColumn("path", F.concat(F.lit("pages/"), "page_id"))
    return manifest.content_manifest(pages, "path", "html")


@query("S8_checksum_manifest", "SELECT 'pages/' || page_id AS path, strlen(html) AS length, sha256(html) AS sha256 FROM pages")
def s8(spark, folder):
    return _page_manifest(spark, folder)


@query("S8_checksum_manifest_files")
def s8_files(spark, folder):
    return manifest.checksum_manifest(spark, folder)


@query(
    "S9_verify_checksums",
    """SELECT 'pages/' || page_id AS path, CASE WHEN page_id % 11 = 1 THEN 'extra' WHEN page_id % 7 = 0 THEN 'mismatched'
      ELSE 'ok' END AS status FROM pages
    UNION ALL SELECT 'ghost/' || page_id, 'missing' FROM pages WHERE page_id % 13 = 2""",
)
def s9(spark, folder):
    """Some listed digests are spoilt, some paths are left out and some listed that do not exist."""
    actual = _page_manifest(spark, folder)
    number = F.substring_index("path", "/", -1).cast("long")
    spoilt = F.when(number % 7 == 0, F.sha2("path", 256)).otherwise(F.col("sha256"))
    listed = actual.withColumn("sha256", spoilt).filter(number % 11 != 1)
    ghosts = actual.filter(number % 13 == 2).withColumn("path", F.regexp_replace("path", "^pages", "ghost"))
    path = scratch_path(spark, "manifest")
    manifest.write_manifest(listed.unionByName(ghosts), path)
    return manifest.verify_checksums(actual, manifest.read_manifest(spark, path))


@query("S9_verify_checksums_files")
def s9_files(spark, folder):
    actual = manifest.checksum_manifest(spark, folder)
    path = scratch_path(spark, "manifest")
    manifest.write_manifest(actual, path)
    return manifest.verify_checksums(actual, manifest.read_manifest(spark, path))


@query(
    "S10_parse_atoms",
    f"WITH {SQL_ATOMS} SELECT design_id, res_seq, x, y, z, b FROM atoms",
)
def s10(spark, folder):
    return predictions.parse_atoms(atom_lines(spark, folder))


@query(
    "S11_parse_confidence",
    """SELECT vec_id AS design_id, round(CASE label % 3 WHEN 0 THEN abs(embedding[1]::DOUBLE) * 100e0
        WHEN 1 THEN list_avg(list_transform(embedding::DOUBLE[], lambda x: abs(x))) * 100e0 ELSE label * 10e0 END, 6) AS mean_plddt,
      CASE label % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.25e0 ELSE 0.75e0 END AS ptm FROM embeddings""",
)
def s11(spark, folder):
    e = table(spark, folder, "embeddings")
    size = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    lone = F.struct(size[0].alias("plddt"), F.lit(0.5).alias("ptm"))
    listed = F.struct(size.alias("plddt"), F.array(F.lit(0.25), F.lit(0.1)).alias("chains_ptm"))
    mapped = F.struct(
        (F.col("label") * 10.0).alias("complex_plddt"), F.create_map(F.lit("0"), F.lit(0.75)).alias("chains_ptm")
    )
    text = (
        F.when(F.col("label") % 3 == 0, F.to_json(lone))
        .when(F.col("label") % 3 == 1, F.to_json(listed))
        .otherwise(F.to_json(mapped))
    )
    out = predictions.parse_confidence(e.select(F.col("vec_id").alias("design_id"), text.alias("value")))
    return out.withColumn("mean_plddt", F.round("mean_plddt", 6))


@query(
    "S12_parse_binders",
    """WITH l AS (SELECT l_suppkey AS design_id, l_partkey::INTEGER AS pos, l_returnflag AS allele, l_linestatus AS peptide,
      l_quantity / 50e0 AS rank_el, l_orderkey, l_linenumber FROM lineitem)
    SELECT design_id, pos, allele, peptide, rank_el, 'I' AS class FROM l WHERE rank_el < 0.5e0
    QUALIFY row_number() OVER (PARTITION BY design_id, pos, allele ORDER BY l_orderkey, l_linenumber) = 1""",
)
def s12(spark, folder):
    filler = F.array_repeat(F.lit("x"), 9)
    tokens = F.concat(
        F.array(F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus"),
        filler,
        F.array((F.col("l_quantity") / 50.0).cast("string")),
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("design_id"),
        F.struct("l_orderkey", "l_linenumber").alias("line"),
        F.concat(F.lit("  "), F.array_join(tokens, "   ")).alias("value"),
    )
    comments = lines.withColumn("value", F.concat(F.lit("# "), "value"))
    rows = predictions.parse_binders(lines.unionByName(comments), "I")
    return dedupe_first(rows, ["design_id", "pos", "allele"], "line").drop("line")


@query(
    "S13_parse_domain_hits",
    "SELECT l_orderkey AS uniprot_acc, 'PF' || l_partkey AS family, l_discount / 1e12 AS e_value FROM lineitem",
)
def s13(spark, folder):
    value = F.format_string(
        "PF%d.%d acc query - %s 10.0", "l_partkey", "l_linenumber", (F.col("l_discount") / 1e12).cast("string")
    )
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("design_id"), value.alias("value"))
    noise = lines.withColumn("value", F.concat(F.lit("#"), "value"))
    return predictions.parse_domain_hits(lines.unionByName(noise)).withColumnRenamed("design_id", "uniprot_acc")


@query("S14_read_embeddings", "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first FROM embeddings")
def s14(spark, folder):
    e = catalog.read_embeddings(spark, f"{folder}/embeddings.parquet", "vec_id", "embedding")
    return e.select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("first"))


@query(
    "S16_write_summary",
    f"""WITH {DESIGNS} SELECT count(*) AS n_designs, count(*) FILTER (score > 0.85e0) AS n_beating, 0.85e0 AS threshold,
      'table' AS origin FROM designs""",
)
def s16(spark, folder):
    path = scratch_path(spark, "summary")
    counts = {"n_beating": F.count_if(F.col("score") > 0.85)}
    catalog.write_summary(designs(spark, folder), path, "design_id", counts, threshold=0.85, origin="table")
    return spark.read.schema("n_designs bigint, n_beating bigint, threshold double, origin string").json(f"{path}/summary")


@query(
    "S6_sink_columns",
    """SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS pfam_hits,
      '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS provenance FROM orders""",
)
def s6_flat(spark, folder):
    nested = table(spark, folder, "orders").select(
        "o_orderkey",
        F.array("o_orderstatus", "o_orderpriority").alias("pfam_hits"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("provenance"),
    )
    return catalog.sink_columns(nested, {"pfam_hits": "|"})


