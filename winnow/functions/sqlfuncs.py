"""SQL-defined temporary functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from winnow import constants as K



def _rounded(value: str, digits: int) -> str:
    """SQL text of `scalars.round_exact`."""
    scale = f"{float(10**digits)}D"
    high = "(x * 134217729D - (x * 134217729D - x))"
    error = f"(({high} * {scale} - x * {scale}) + (x - {high}) * {scale})"
    beyond = f"(((x * {scale} - floor(x * {scale})) - 0.5D) + {error})"
    up = f"CASE WHEN {beyond} > 0 OR ({beyond} = 0 AND pmod(floor(x * {scale}), 2) = 1) THEN 1 ELSE 0 END"
    rounded = f"CASE WHEN abs(x) < {2.0**52 / 10**digits}D THEN (floor(x * {scale}) + {up}) / {scale} ELSE x END"
    return f"transform(array({value}), x -> {rounded})[0]"


DEFINITIONS = {
    "beats": f"(score DOUBLE) RETURNS BOOLEAN RETURN score > {K.LOCKPOINT_VERBATIM}D",
    "beats_calibrated": f"(score DOUBLE) RETURNS BOOLEAN RETURN score > {K.LOCKPOINT_CALIBRATED}D",
    "score_length": (
        "(n DOUBLE) RETURNS DOUBLE RETURN CASE "
        f"WHEN n <= {K.LENGTH_SHORT}D THEN 1D - ({K.LENGTH_SHORT}D - n) / {K.LENGTH_SHORT}D * {K.LENGTH_LOSS_SHORT}D "
        f"WHEN n <= {K.LENGTH_MIDDLE}D THEN 1D - (n - {K.LENGTH_SHORT}D) / {K.LENGTH_MIDDLE - K.LENGTH_SHORT}D * {K.LENGTH_LOSS_MIDDLE}D "
        f"WHEN n <= {K.LENGTH_LONG}D THEN {K.LENGTH_LEFT_MIDDLE}D - (n - {K.LENGTH_MIDDLE}D) / {K.LENGTH_LONG - K.LENGTH_MIDDLE}D * {K.LENGTH_LEFT_MIDDLE}D "
        "WHEN n IS NOT NULL THEN 0D END"
    ),
    "score_load": (
        "(n1 DOUBLE, n2 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n1 + n2 IS NOT NULL THEN "
        + _rounded(f"least(1D, greatest(0D, 1D - (n1 + n2 * 0.5D) / {K.LOAD_SCALE}D))", 4)
        + " END"
    ),
    "score_density": (
        "(n DOUBLE, len DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n / len IS NOT NULL THEN "
        f"least(1D, greatest(0D, 1D - (n / len) / {K.DENSITY_SCALE}D)) END"
    ),
    "gc_fraction": (
        "(dna STRING) RETURNS DOUBLE RETURN CASE WHEN length(dna) > 0 THEN "
        "CAST(length(dna) - length(translate(upper(dna), 'GC', '')) AS DOUBLE) / length(dna) ELSE 0D END"
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, definition in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return sorted(DEFINITIONS)
