"""Set operations on catalogs and id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.operators.joins import merge_sources

union_sources = merge_sources


def dedupe_by_source(df: DataFrame, key: str, source_col: str, priority: Sequence[str], tie: str | Sequence[str] | None = None) -> DataFrame:
    """One row per key, from the first source in priority order; sources outside the list come last.

    Rows of one key and source are told apart by the `tie` columns; give enough of them for a full order.
    """
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source_col)), F.lit(0)),
        F.lit(len(priority) + 1),
    )
    ties = [tie] if isinstance(tie, str) else list(tie or [])
    order = [rank.asc(), *[F.asc_nulls_last(c) for c in ties]]
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def exclude_recoveries(df: DataFrame, sequence_col: str, wild_type: str) -> DataFrame:
    """Drop exact copies of the wild type; rows without a sequence stay."""
    return df.filter(F.coalesce(F.col(sequence_col) != wild_type, F.lit(True)))


def exclude_known_sequences(df: DataFrame, known: DataFrame, sequence_col: str) -> DataFrame:
    """Drop rows whose sequence equals any of a table of wild types, joined on a digest instead of the text."""
    digest = F.sha2(F.col(sequence_col), 256)
    return (
        df.withColumn("_digest", digest)
        .join(known.select(digest.alias("_digest")), "_digest", "left_anti")
        .drop("_digest")
    )
