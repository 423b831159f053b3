"""Composed queries on small tables that the given ones do not resemble."""

import duckdb
import pytest

from table_queries import ORACLES, QUERIES
from tests.oracle import compare


def tables(spark, folder, **rows):
    """A folder with the given tables, and a connection that reads them."""
    con = duckdb.connect()
    for name, (schema, data) in rows.items():
        path = f"{folder}/{name}.parquet"
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return con


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("crowd,rows", [(60, 0), (20, 32)])
def test_triaged_ranking_stands_only_with_three_strategies_among_the_first(spark, tmp_path, crowd, rows):
    # English texts score higher; with 60 of them the first 50 hold one strategy
    texts = [(i, "A" * 200, "en", "s", 1) for i in range(crowd)]
    texts += [(1000 + i, "KREWY" * 40, ("fr", "de")[i % 2], "s", 38) for i in range(12)]
    con = tables(spark, tmp_path, documents=(DOCUMENTS, texts), labels=(LABELS, [(t[0], 1, 0) for t in texts]))
    found = QUERIES["E2_triaged_ranking"](spark, str(tmp_path))
    assert compare(found, con, ORACLES["E2_triaged_ranking"]) is None
    assert found.count() == rows


def test_chimeras_of_suppliers_that_share_a_name(spark, tmp_path):
    suppliers = [(k, f"Supplier#{k % 3:09d}", 2, 0.0) for k in range(9)]
    con = tables(
        spark, tmp_path,
        supplier=("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", suppliers),
        nation=("n_nationkey int, n_name string, n_regionkey int", [(i, f"NATION_OF_THE_NAME_{i:02d}", i % 2) for i in range(8)]),
        region=("r_regionkey int, r_name string", [(i, "ASIA_AND_MORE"[: 10 + i]) for i in range(3)]),
        documents=(DOCUMENTS, [(k, "KREWY" * (30 + k), "en", "s", 1) for k in range(9)]),
    )
    for name, rows in (("J4_generate_chimeras", 2 * 9 * 3), ("E7_chimera_library", 3 * 9)):
        found = QUERIES[name](spark, str(tmp_path))
        if name[0] == "J":
            assert compare(found, con, ORACLES[name]) is None
        assert found.count() == rows
