"""The call-site queries against their registered SQL without its row filters, over whole tables.

The registered SQL still filters rows by key and quantity, and lets a single candidate be reached over one import only;
here the filters are taken out, and reach is the closure of the imports.
"""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
FILTERS = [" WHERE l_quantity >= 49", " WHERE p_partkey % 7 = 0", " AND l_partkey % 20 = 0"]
NAMES = [
    "C7_strict_gate", "A20_resolution_stats", "C13_rescued_decisions", "C15_persistence_gate", "C1_normalised_identifiers", "C2_caller_records", "C17_callsite_pairs", "X1_rejected_buckets",
    "W4_best_by_module_path", "W5_best_by_distance", "X5_name_signals", "X7_drop_buckets", "E11_drop_counters", "E15_public_bucket_totals", "E22_callsite_funnel", "J19_unique_names",
]


REACH = [
    ("WITH sites AS", "WITH RECURSIVE sites AS"),
    ("\nk AS (", "\nreach AS (SELECT caller_module AS a, module AS b FROM d UNION SELECT a, module FROM reach JOIN d ON b = caller_module),\nk AS ("),
    ("IS NOT NULL AS near\n", "IS NOT NULL AS near, coalesce((s.caller_module, c.module) IN (SELECT a, b FROM reach), false) AS far\n"),
    ("coalesce(bool_or(near), false) AS reached", "coalesce(bool_or(near OR far), false) AS reached"),
]


def whole(sql: str) -> str:
    for f in [*FILTERS, " WHERE p_partkey % 20 = 0"]:
        sql = sql.replace(f, "")
    for a, b in REACH if "\nk AS (" in sql else []:
        sql = sql.replace(a, b)
    return sql


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_the_sql_over_all_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(whole(__spark_entry__.oracle_sql()[name]))
    columns = [x[0] for x in want.description]
    rows = __spark_entry__.queries()[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in rows.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
