"""Catalog tables, embeddings, registries, record exports and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType
from pyspark.sql.utils import AnalysisException

from winnow import constants as K
from winnow.sources.registry import SCHEMAS, registry_frame


def clear_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Catalog with its columns as stored, so that filters reach the scan. CSV has a header and needs no inference pass
    when a schema is given; its NaN texts are NULL. Catalogs of `write_catalog` hold no NaN; gates and scores treat NaN
    like NULL, and `clear_nan` is there for other readers."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"fmt must be 'parquet' or 'csv'; got {fmt!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False)
    try:
        # with a schema, "NaN" in a floating column is the number and becomes NULL; in a text column it stays a text
        found = getattr(reader, fmt)(path)
        return clear_nan(found) if fmt == "csv" else found
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"catalog not found: {path}. Write it with write_catalog first.") from error
        raise


def write_catalog(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> list[str]:
    """Available columns as zstd Parquet or as CSV, NaN as NULL; returns the columns written."""
    available = [c for c in (columns or df.columns) if c in df.columns]
    writer = clear_nan(df.select(*available)).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)
    return available


def write_records_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; missing values are written as null."""
    clear_nan(df).write.option("ignoreNullFields", False).json(path)


def read_embeddings(
    spark: SparkSession, path: str, id_col: str = "uniprot_acc", vector_col: str = "embedding_128d"
) -> DataFrame:
    return spark.read.parquet(path).select(id_col, F.col(vector_col).alias("embedding"))


def sink_columns(df: DataFrame, joined: Mapping[str, str] | None = None) -> DataFrame:
    """Flat form for CSV sinks: listed arrays joined with their separator, other nested values as JSON text."""
    joined = joined or {}
    out: dict[str, Column] = {}
    for field in df.schema.fields:
        if field.name in joined:
            out[field.name] = F.concat_ws(joined[field.name], F.col(field.name).cast("array<string>"))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            out[field.name] = F.to_json(field.name)
    return df.withColumns(out) if out else df


def write_summary(df: DataFrame, path: str, id_col: str, counts: Mapping[str, Column], **facts) -> DataFrame:
    """Counts, thresholds and facts as one JSON object beside the id list, which stays a distributed table.

    The list grows with the catalog, so it goes to its own folder in id order instead of into the one object.
    """
    summary = df.agg(F.count(F.lit(1)).alias("n_designs"), *[c.alias(name) for name, c in counts.items()])
    summary = summary.withColumns({name: F.lit(value) for name, value in facts.items()}) if facts else summary
    summary.coalesce(1).write.json(f"{path}/summary")
    df.select(id_col).orderBy(id_col).write.json(f"{path}/ids")
    return summary


def load_registry(spark: SparkSession, name: str) -> DataFrame:
    """Dimension tables of fixed size: scaffolds, strategies, predictions, modules, cores, guides, linkers, weights,
    alleles, geometry."""
    if name in SCHEMAS:
        return registry_frame(spark, name)
    if name == "modules":
        schema = (
            "name string, source_scaffold string, start_residue int, end_residue int, catalytic_residues array<int>, pfam_acc string"
        )
        rows = [(*m, list(K.MODULE_SITES.get(m[0], ())), K.MODULE_FAMILIES.get(m[0])) for m in K.MODULES]
        return spark.createDataFrame(rows, schema)
    if name == "cores":
        rows = [(i, n, list(parts)) for i, (n, parts) in enumerate(K.CORES)]
        return spark.createDataFrame(rows, "core_rank int, core string, parts array<string>")
    if name == "guides":
        rows = [(i, g, m) for i, (g, m) in enumerate(K.RNA_MODULES)]
        return spark.createDataFrame(rows, "guide_rank int, guide string, guide_module string")
    if name == "linkers":
        rows = [(i, n, K.LINKERS[n]) for i, n in enumerate(K.LINKER_VARIANTS)]
        return spark.createDataFrame(rows, "linker_rank int, linker string, linker_sequence string")
    if name == "weights":
        rows = [(p, a, w) for p, axes in K.PROFILES.items() for a, w in axes.items()]
        return spark.createDataFrame(rows, "profile string, axis string, weight double")
    if name == "alleles":
        rows = [("I", a) for a in K.ALLELES_CLASS_1] + [("II", a) for a in K.ALLELES_CLASS_2]
        return spark.createDataFrame(rows, "class string, allele string")
    if name == "geometry":
        rows = [
            (r, list(residues), [tuple(p) for p in K.GEOMETRY_DISTANCES.get(r, ())])
            for r, residues in K.GEOMETRY_RESIDUES.items()
        ]
        schema = "reference_id string, residues array<int>, pairs array<struct<r1:int,r2:int,dist:double>>"
        return spark.createDataFrame(rows, schema)
    raise ValueError(f"unknown registry {name!r}")


def read_registry(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """User-supplied dimension table as JSON lines, typed; malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
