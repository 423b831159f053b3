"""Registry files that drive gates."""

import ast
import json
from pathlib import Path

import pytest

from winnow import constants as K
from winnow.operators import gates as G
from winnow.operators.checks import check_contract
from winnow.sources import registry as R
from winnow.sources.catalog import load_registry, read_catalog


@pytest.mark.parametrize("kind", sorted(R.SCHEMAS))
def test_registries_survive_a_file(spark, tmp_path, kind):
    frame = load_registry(spark, kind)
    R.write_nested(frame, str(tmp_path / kind))
    back = R.read_nested(spark, str(tmp_path / kind), kind)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in frame.schema]
    key = lambda r: r["id"]
    assert sorted(map(lambda r: r.asDict(True), back.collect()), key=key) == sorted(map(lambda r: r.asDict(True), frame.collect()), key=key)


def test_registry_fields(spark):
    assert load_registry(spark, "predictions").columns == ["id", "statement", "operationalization", "threshold", "test_script", "rationale", "failure_mode_analysis"]
    first = load_registry(spark, "scaffolds").filter("id = 'IS621'").first()
    assert first["cargo_capacity_bp"] == 1_000_000 and len(first["canonical_protospacer"]) == 20 and len(first["score_axes"]) == 7
    assert sum(first["score_breakdown"].values()) == pytest.approx(sum(first["score_axes"][a] * w for a, w in K.PROFILE_V010.items()))


def test_gates_of_a_file_equal_the_coded_ones(spark):
    compiled = R.compile_gates(R.gate_rows(load_registry(spark, "strategies")), "B")
    assert compiled[:3] == list(G.SOURCE_GATES)
    df = spark.createDataFrame([("a", 0.9, True, 300, 80.0), ("b", 0.85, True, 200, 69.9), ("c", None, None, None, None)], "id string, composite_prob double, composite boolean, protein_length_aa int, mean_plddt double")
    rows = {r["id"]: (r["first_failed_gate"], r["gate_3_pass"]) for r in G.apply_gates(df, compiled, "annotate").collect()}
    assert rows == {"a": (None, True), "b": ("5_global", True), "c": ("1", False)}
    assert [r["id"] for r in G.apply_gates(df, compiled).collect()] == ["a"]
    assert set(R.gates_of(load_registry(spark, "strategies"), "ABCD")) == set("ABCD")


@pytest.mark.parametrize(
    "gate, message",
    [
        ({"comparison": "about"}, "unknown comparison"), ({"columns": []}, "no column"), ({"value": None}, "no threshold"), ({"on_null": "maybe"}, "on_null"),
        ({"comparison": "between", "value": 3.0, "high": 2.0}, "low and a high"), ({"comparison": "eq", "value": None}, "nothing to compare"),
    ],
)
def test_mistakes_in_a_gate_table_fail_early(spark, tmp_path, gate, message):
    row = {"name": "g", "columns": ["x"], "comparison": "ge", "value": 1.0} | gate
    (tmp_path / "s.json").write_text(json.dumps({"id": "S", "gates": [row]}) + "\n")
    with pytest.raises(ValueError, match=message):
        R.compile_gates(R.gate_rows(R.read_nested(spark, str(tmp_path / "s.json"), "strategies")), "S")


def test_malformed_entries_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "S", "target_n_designs": "many"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        R.read_nested(spark, str(tmp_path / "a.json"), "strategies").collect()
    (tmp_path / "b.json").write_text('{"name": "no id"}\n')
    with pytest.raises(Exception, match="without an id"):
        R.read_nested(spark, str(tmp_path / "b.json"), "strategies").collect()
    with pytest.raises(ValueError, match="no gates"):
        R.compile_gates(R.gate_rows(load_registry(spark, "strategies")), "Z")


def test_csv_texts_that_read_nan_stay(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,score\nNaN,NaN\nb,0.5\n")
    rows = read_catalog(spark, str(tmp_path / "c.csv"), "csv", "id string, score double").collect()
    assert [tuple(r) for r in rows] == [("NaN", None), ("b", 0.5)]


def test_every_constant_is_assigned_once():
    body = ast.parse(Path(K.__file__).read_text(encoding="utf-8")).body
    names = [t.id for node in body if isinstance(node, ast.Assign) for t in node.targets]
    assert [n for n in names if names.count(n) > 1] == []


def test_strata_of_filters_and_contracts_are_the_ids_of_the_registry(spark):
    assert list(K.STRATEGIES) == [s[0] for s in K.STRATEGY_REGISTRY]
    rows = spark.createDataFrame([("d1", "D", 0.5), ("d2", "A", 0.7)], "design_id string, strategy string, score double")
    assert [r.design_id for r in G.filter_strategy(rows, "D").collect()] == ["d1"]
    contract = check_contract(rows, axes=())
    assert all(r.passed for r in contract.collect())
