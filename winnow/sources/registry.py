"""Typed registries of strategies, predictions and scaffolds, and plans whose gates are rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.operators.gates import COMPARISONS, Gate

GATE_FIELDS = (
    "name: string, columns: array<string>, comparison: string, value: double, high: double, text: string, on_null: string, required: boolean, "
    "rationale: string"
)
SCHEMAS = {
    "strategies": f"id string, name string, method string, target_n_designs int, gates array<struct<{GATE_FIELDS}>>",
    "predictions": (
        "id string, statement string, operationalization string, threshold string, test_script string, rationale string, failure_mode_analysis string"
    ),
    "scaffolds": (
        "id string, accession string, structure string, score double, tier_b string, composite boolean, total_aa int, modules array<string>, "
        "carve_out_modules array<string>, canonical_protospacer string, cargo_capacity_bp int, score_axes map<string,double>, "
        "score_breakdown map<string,double>"
    ),
}
OPTIONAL = {"predictions": ("rationale", "failure_mode_analysis")}


def read_nested(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A registry file as JSON lines, one object per entry, typed by its kind; malformed lines fail when read.

    Absent optional texts are empty, absent lists and maps stay NULL; an entry without an id fails.
    """
    rows = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)
    checked = rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit(f"{kind}: entry without an id")).cast("string")))
    return checked.na.fill("", subset=list(OPTIONAL.get(kind, ())))


def write_nested(registry: DataFrame, path: str) -> None:
    """The registry as `read_nested` reads it; absent values are written as null."""
    registry.write.option("ignoreNullFields", False).json(path)


def registry_frame(spark: SparkSession, kind: str) -> DataFrame:
    """The built-in registry of a kind."""
    if kind == "strategies":
        rows = [(*s[:4], [_gate_row(*g) for g in s[4]]) for s in K.STRATEGY_REGISTRY]
    elif kind == "predictions":
        rows = [(*h, *K.PREDICTION_NOTES[h[0]]) for h in K.HYPOTHESES]
        rows = [(i, s, how, limit, script, why, failure) for i, s, limit, how, script, why, failure in rows]
    else:
        extra = {s: (p, c, a) for s, p, c, a in K.SCAFFOLD_DETAILS}
        rows = []
        for s in K.SCAFFOLDS:
            protospacer, capacity, axes = extra.get(s[0], (None, None, {}))
            breakdown = {a: round(v * K.PROFILE_V010[a], 12) for a, v in axes.items()}
            rows.append((*s[:7], list(s[7]), list(s[8]), protospacer, capacity, axes, breakdown))
    return spark.createDataFrame(rows, SCHEMAS[kind])


def _gate_row(name, columns, comparison, value=None, on_null="drop", required=False, rationale=""):
    low, high = value if isinstance(value, tuple) else (value if isinstance(value, (int, float)) else None, None)
    text = value if isinstance(value, str) else None
    return (name, list(columns), comparison, None if low is None else float(low), None if high is None else float(high), text, on_null, required, rationale)


def gate_rows(strategies: DataFrame) -> DataFrame:
    """One row per gate and strategy, with its place: the form in which gates are kept in a table."""
    return strategies.select(F.col("id").alias("strategy"), F.posexplode("gates").alias("place", "gate")).select("strategy", "place", "gate.*")


def compile_gates(rows: DataFrame, strategy: str) -> list[Gate]:
    """Gate specs of one strategy, in order, from a table of gate rows; they drive `gates.apply_gates`.

    Rows are checked here, so a mistake in the table fails before any data is read. A strategy has a handful of gates,
    which are collected.
    """
    found = rows.filter(F.col("strategy") == strategy).orderBy("place").collect()
    if not found:
        raise ValueError(f"no gates for strategy {strategy!r}")
    return [compile_gate(r.asDict()) for r in found]


def compile_gate(row: dict) -> Gate:
    name, comparison = row["name"], row["comparison"]
    if comparison not in COMPARISONS:
        raise ValueError(f"gate {name}: unknown comparison {comparison!r}; known: {sorted(COMPARISONS)}")
    if not row["columns"]:
        raise ValueError(f"gate {name}: no column")
    on_null = row["on_null"] or "drop"
    if on_null not in ("drop", "keep"):
        raise ValueError(f"gate {name}: on_null must be 'drop' or 'keep'; got {on_null!r}")
    value: object = None
    if comparison == "between":
        value = (row["value"], row["high"])
        if None in value or value[0] > value[1]:
            raise ValueError(f"gate {name}: needs a low and a high value; got {value}")
    elif comparison == "eq":
        value = row["text"] if row["text"] is not None else row["value"]
        if value is None:
            raise ValueError(f"gate {name}: nothing to compare with")
    elif comparison not in ("true", "has_text"):
        value = row["value"]
        if value is None:
            raise ValueError(f"gate {name}: no threshold")
    return Gate(name, tuple(row["columns"]), comparison, value, on_null, bool(row["required"]))


def gates_of(strategies: DataFrame, ids: Sequence[str]) -> dict[str, list[Gate]]:
    """Compiled gates of several strategies."""
    rows = gate_rows(strategies)
    return {i: compile_gates(rows, i) for i in ids}
