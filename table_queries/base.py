"""Registry, table access and the shared candidate view."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sequences import letters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def designs(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as scored candidates: ids, strata, labels, seven axes and the unrounded score."""
    li = table(spark, folder, "lineitem")
    base = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("design_id"),
        F.when(F.col("l_returnflag") == "A", "A")
        .when(F.col("l_returnflag") == "R", "B")
        .when(F.col("l_linestatus") == "O", "C")
        .otherwise("D")
        .alias("strategy"),
        F.when(F.col("l_linenumber") <= 4, K.CLASS_FREE)
        .when(F.col("l_linenumber") <= 6, K.CLASS_NUCLEASE)
        .otherwise(K.CLASS_UNKNOWN)
        .alias("tier_a"),
        (F.col("l_linestatus") == "O").alias("composite"),
        (1.0 - F.col("l_discount") * 3.0).alias("tier_a_confidence"),
        (1.0 - F.col("l_tax") * 2.5).alias("composite_prob"),
        (F.col("l_quantity") * 26).cast("int").alias("protein_length_aa"),
        F.concat(F.lit("Genus"), "l_suppkey", F.lit(" species "), "l_partkey").alias("organism"),
        F.concat(F.lit("Genus"), "l_suppkey").alias("genus"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_extendedprice") - 50000.0) / 10000.0).alias("ddg_kcal_mol"),
        (F.col("l_extendedprice") / 1050.0).alias("mean_plddt"),
        (1.0 - F.col("l_discount") * 5.0).alias("ptm"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity") > 5).alias("active_site_pass"),
        (1.0 - F.col("l_tax") * 2.0).alias("S_Immuno"),
    )
    axes = base.withColumns(
        {
            "S_DSB": S.score_class("tier_a"),
            "S_Spec": F.least(F.lit(1.0), F.col("tier_a_confidence") * 0.9 + F.col("composite_prob") * 0.1),
            "S_Cargo": S.score_cargo("tier_a", "composite"),
            "S_Deliv": S.score_length("protein_length_aa"),
            "S_Prog": F.least(
                F.lit(1.0), F.col("composite_prob") * 0.8 + F.when(F.col("composite"), 1.0).otherwise(0.0) * 0.2
            ),
            "S_Mature": S.score_maturity("strategy", F.lit(None).cast("double")),
        }
    )
    return axes.withColumn("score", S.weighted(K.PROFILE_V010))


def sequences(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """id and upper-case letters of a text table, dealt once over all tasks: a file of one row group is one split."""
    keys = {"documents": "doc_id", "benchmark": "item_id"}
    df = table(spark, folder, name)
    return df.select(F.col(keys[name]).alias("id"), letters("text").alias("sequence")).repartition("id")


# --- SQL building blocks ---------------------------------------------------------------------------------------


def num(x: float) -> str:
    """Double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def sql_weighted(profile: Mapping[str, float], replaced: Mapping[str, float] | None = None) -> str:
    replaced = replaced or {}
    return " + ".join(f"{num(replaced[a]) if a in replaced else a} * {num(w)}" for a, w in profile.items())


def sql_length(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 260 THEN 1e0 - (260e0 - {n}) / 260e0 * 0.2e0 "
        f"WHEN {n} <= 900 THEN 1e0 - ({n} - 260e0) / 640e0 * 0.35e0 "
        f"WHEN {n} <= 1200 THEN 0.65e0 - ({n} - 900e0) / 300e0 * 0.65e0 ELSE 0e0 END"
    )


def sql_round(x: str, digits: int) -> str:
    """Rounding of the binary value, halves to even; `x` must be a column."""
    s = f"{10 ** digits}e0"
    p = f"({x} * {s})"
    high = f"(({x} * 134217729e0) - (({x} * 134217729e0) - {x}))"
    error = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    beyond = f"((({p} - floor({p})) - 0.5e0) + {error})"
    up = f"({beyond} > 0 OR ({beyond} = 0 AND floor({p}) % 2 = 1))"
    return f"((CASE WHEN {up} THEN floor({p}) + 1 ELSE floor({p}) END) / {s})"


def sql_letters(text: str) -> str:
    return f"upper(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"


DESIGNS = f"""
raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS design_id,
    CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B'
         WHEN l_linestatus = 'O' THEN 'C' ELSE 'D' END AS strategy,
    CASE WHEN l_linenumber <= 4 THEN '{K.CLASS_FREE}' WHEN l_linenumber <= 6 THEN '{K.CLASS_NUCLEASE}'
         ELSE '{K.CLASS_UNKNOWN}' END AS tier_a,
    l_linestatus = 'O' AS composite,
    1e0 - l_discount * 3e0 AS tier_a_confidence,
    1e0 - l_tax * 2.5e0 AS composite_prob,
    CAST(l_quantity * 26 AS INTEGER) AS protein_length_aa,
    'Genus' || l_suppkey || ' species ' || l_partkey AS organism,
    'Genus' || l_suppkey AS genus,
    CASE WHEN l_linenumber <> 3 THEN (l_extendedprice - 50000e0) / 10000e0 END AS ddg_kcal_mol,
    l_extendedprice / 1050e0 AS mean_plddt,
    1e0 - l_discount * 5e0 AS ptm,
    CASE WHEN l_linenumber <> 5 THEN l_quantity > 5 END AS active_site_pass,
    1e0 - l_tax * 2e0 AS S_Immuno
  FROM lineitem),
axes AS (
  SELECT *,
    CASE tier_a WHEN '{K.CLASS_FREE}' THEN 1e0 WHEN '{K.CLASS_NUCLEASE}' THEN 0e0 ELSE 0.5e0 END AS S_DSB,
    least(1e0, tier_a_confidence * 0.9e0 + composite_prob * 0.1e0) AS S_Spec,
    CASE WHEN tier_a = '{K.CLASS_FREE}' AND composite THEN 1e0 WHEN tier_a = '{K.CLASS_FREE}' THEN 0.85e0
         ELSE 0e0 END AS S_Cargo,
    {sql_length('protein_length_aa')} AS S_Deliv,
    least(1e0, composite_prob * 0.8e0 + (CASE WHEN composite THEN 1e0 ELSE 0e0 END) * 0.2e0) AS S_Prog,
    CASE WHEN strategy = 'D' THEN 0.792e0 * 0.5e0 WHEN strategy = 'C' THEN 0.792e0 ELSE 0e0 END AS S_Mature
  FROM raw),
designs AS (SELECT *, {sql_weighted(K.PROFILE_V010)} AS score FROM axes)"""
