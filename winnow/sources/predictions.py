"""Outputs of external predictors: structures, confidence records, binder tables and domain hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import constants as K

STEM = r"([^/]+?)(\.[A-Za-z0-9]+)?$"


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), STEM, 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """design_id (file name without extension), line order within the file, and text."""
    lines = spark.read.text(path).select(
        _stem().alias("design_id"),
        # splits of one file are scanned in order, so the id grows with the line
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return lines


def parse_atoms(lines: DataFrame) -> DataFrame:
    """CA atoms of fixed-width lines; the first occurrence of a residue counts and unreadable numbers are skipped."""
    def number(start: int, width: int, kind: str) -> Column:
        return F.trim(F.substring("value", start, width)).try_cast(kind)

    rows = lines.filter(F.col("value").startswith("ATOM") & (F.trim(F.substring("value", 13, 4)) == "CA")).select(
        "design_id",
        "line",
        number(23, 4, "int").alias("res_seq"),
        number(31, 8, "double").alias("x"),
        number(39, 8, "double").alias("y"),
        number(47, 8, "double").alias("z"),
        number(61, 6, "double").alias("b"),
    )
    usable = rows.filter(F.col("res_seq").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return (
        usable.groupBy("design_id", "res_seq")
        .agg(F.min_by(F.struct("x", "y", "z", "b"), "line").alias("_a"))
        .select("design_id", "res_seq", "_a.x", "_a.y", "_a.z", "_a.b")
    )


def read_structure_atoms(spark: SparkSession, path: str) -> DataFrame:
    return parse_atoms(read_lines(spark, path))


def parse_confidence(records: DataFrame, value_col: str = "value") -> DataFrame:
    """Mean confidence on 0-100 and pTM. The fields may be numbers, lists or maps, so they are read as JSON text."""
    def field(path: str) -> Column:
        return F.get_json_object(value_col, path)

    raw = F.coalesce(field("$.plddt"), field("$.complex_plddt"))
    listed = F.from_json(raw, "array<double>")
    mean = F.aggregate(listed, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(listed), F.lit(0))
    value = F.coalesce(F.when(raw.startswith("["), mean).otherwise(raw.try_cast("double")), F.lit(0.0))
    plddt = F.when(value.between(0.0, 1.0), value * 100.0).otherwise(value)
    chains = field("$.chains_ptm")
    by_chain = F.get(F.map_values(F.from_json(chains, "map<string,double>")), F.lit(0))
    first = F.when(chains.startswith("["), field("$.chains_ptm[0]").try_cast("double")).otherwise(by_chain)
    ptm = F.coalesce(
        field("$.ptm").try_cast("double"), field("$.complex_ptm").try_cast("double"), first, F.lit(0.0)
    )
    return records.select("design_id", plddt.alias("mean_plddt"), ptm.alias("ptm"))


def read_confidence_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole small JSON files, searched recursively; the id is the file name."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parse_confidence(files.select(_stem().alias("design_id"), "value"))


def parse_binders(lines: DataFrame, kind: str) -> DataFrame:
    """Binder rows of predictor text: position, allele, peptide, rank. Comments, headers and short lines are skipped."""
    token, minimum = (12, 13) if kind == "I" else (8, 9)
    text = F.trim("value")
    parts = F.split(text, r"\s+")
    rank = F.get(parts, F.lit(token)).try_cast("double")
    rows = lines.filter(~text.startswith("#") & ~text.startswith("-") & (F.size(parts) >= minimum)).select(
        "design_id",
        "line",
        F.when(F.get(parts, F.lit(0)).rlike(r"^-*\d+$"), F.get(parts, F.lit(0)).try_cast("int")).alias("pos"),
        F.get(parts, F.lit(1)).alias("allele"),
        F.get(parts, F.lit(2)).alias("peptide"),
        rank.alias("rank_el"),
        F.lit(kind).alias("class"),
    )
    strong = F.col("rank_el") < K.RANK_CLASS_1 if kind == "I" else F.col("rank_el") <= K.RANK_CLASS_2
    return rows.filter(F.col("pos").isNotNull() & ~F.isnan("rank_el") & strong)


def read_binder_output(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Strong binders, one per (design, position, allele): the first line wins."""
    from winnow.operators.aggregates import dedupe_first

    rows = parse_binders(read_lines(spark, path), kind)
    return dedupe_first(rows, ["design_id", "pos", "allele"], "line").drop("line")


def parse_domain_hits(lines: DataFrame) -> DataFrame:
    """Accession, family without version, e-value of tabular hit lines."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(parts) >= 5)).select(
        "design_id",
        F.substring_index(parts[0], ".", 1).alias("family"),
        parts[4].try_cast("double").alias("e_value"),
    )
    return rows.filter(F.col("e_value").isNotNull() & ~F.isnan("e_value"))


def read_domain_hits(spark: SparkSession, path: str, key: str = "uniprot_acc") -> DataFrame:
    return parse_domain_hits(read_lines(spark, path)).withColumnRenamed("design_id", key)
