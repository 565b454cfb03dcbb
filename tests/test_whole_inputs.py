"""Queries that once ran on a subset of their rows, on small tables and against plain loops."""

import random

import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()


def write(spark, folder, part, lineitem):
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lineitem, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    part = [(k, f"n{rng.randrange(12)}", f"B{rng.randrange(8)}") for k in range(1, 41)]
    lineitem = [(rng.randrange(1, 9), rng.randrange(1, 41), float(rng.choice([3, 20, 49, 50]))) for _ in range(90)]
    folder = str(tmp_path_factory.mktemp("tables"))
    write(spark, folder, part, lineitem)
    return folder, part, lineitem


def test_call_sites_and_candidates_are_all_rows(spark, tables):
    folder, part, lineitem = tables
    of = {k: (name, brand) for k, name, brand in part}
    shipped = {}
    for s, k, _ in lineitem:
        shipped.setdefault(s, []).append(of[k][1])
    home = {s: max((b.count(x), x) for x in b)[1] for s, b in shipped.items()}
    direct = {(home[s], of[k][1]) for s, k, q in lineitem if q >= 50}
    want, pairs, best = {}, {}, {}
    for s, name in {(s, of[k][0]) for s, k, _ in lineitem}:
        cands = [(k, b) for k, n, b in part if n == name]
        near = [k for k, b in cands if b == home[s] or (home[s], b) in direct]
        want[f"{s}/{name}"] = (len(cands), len(near))
        pairs[f"{s}/{name}"] = (len(cands), min(str(k) for k, _ in cands))
        best[f"{s}/{name}"] = min((b, str(k)) for k, b in cands)[1]
    assert {r.site: (r.candidate_count, r.in_scope_count) for r in QUERIES["C7_strict_gate"](spark, folder).collect()} == want
    assert {r.site: (r.pairs, r.first_callee) for r in QUERIES["C17_callsite_pairs"](spark, folder).collect()} == pairs
    assert {r.site: r.best for r in QUERIES["W4_best_by_module_path"](spark, folder).collect()} == best


def test_a_single_candidate_two_imports_away_is_accepted(spark, tmp_path):
    part = [(1, "a", "A"), (2, "b", "B"), (3, "c", "C"), (4, "d", "D")]
    shipped = [(2, 1, 10.0)] * 2 + [(2, 2, 50.0), (2, 3, 10.0)] + [(4, 2, 10.0)] * 2 + [(4, 3, 50.0), (4, 4, 10.0)]  # A imports B, B imports C; nothing imports D
    write(spark, str(tmp_path), part, shipped)
    got = {r.site: (r.accepted, r.provenance, r.dropped_reason) for r in QUERIES["C7_strict_gate"](spark, str(tmp_path)).collect()}
    assert got["2/b"] == ("2", "import_narrowed", None) and got["2/c"] == ("3", "import_narrowed", None)
    assert got["4/d"] == (None, None, "unique_without_provenance")
    assert {r.bucket: r.sites for r in QUERIES["X1_rejected_buckets"](spark, str(tmp_path)).collect()} == {"weak_static_evidence": 1, "total": 1}


def test_unique_names_are_unique_in_the_whole_table(spark, tmp_path):
    write(spark, str(tmp_path), [(19, "many", "A"), (20, "many", "A"), (21, "one", "A"), (40, "twenty", "A")], [(1, 19, 1.0)])
    assert {tuple(r) for r in QUERIES["J19_unique_names"](spark, str(tmp_path)).collect()} == {("one", 21), ("twenty", 40)}
