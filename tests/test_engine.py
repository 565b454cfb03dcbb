"""Operators of the code graph on hand-made rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codegrove.functions import names as N
from codegrove.operators import diagnostics
from codegrove.operators import graph as G
from codegrove.operators import overlay as V
from codegrove.operators import resolution as R
from codegrove.operators import rollups
from codegrove.sources import python_source
from codegrove.streaming.fan_stream import fan_deltas

SF = "/root/testdata/sf0.001"


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, edge_type string")


def test_entry_runs(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["node_id", "qualified_name", "edge_kind", "fan_in", "fan_out"] and got.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["A6_module_calls", "R10_dependency_edges", "C7_strict_gate", "D18_patched_pair_counts", "G4_import_cycles"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = [tuple(r[c] for c in columns) for r in __spark_entry__.queries()[name](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_fan_stats(spark):
    got = {r.node_id: (r.fan_in, r.fan_out) for r in rollups.fan_stats(edges(spark, [("a", "b"), ("a", "c"), ("b", "b")])).collect()}
    assert got == {"a": (0, 2), "b": (2, 1), "c": (1, 0)}


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("e", "y"), ("z", "a")]
    assert {r["id"]: r["component"] for r in G.strong_components(edges(spark, pairs)).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert G.strong_components(edges(spark, [("a", "b")])).collect() == []


def test_closure_keeps_the_shortest_distance(spark):
    got = {(r.src, r.dst): r.distance for r in G.closure(edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])).collect()}
    assert got[("a", "c")] == 1 and got[("b", "a")] == 2 and got[("a", "a")] == 2 and got[("b", "b")] == 3
    assert len(G.closure(edges(spark, [("a", "b"), ("b", "c")]), 1).collect()) == 2


def test_names(spark):
    row = spark.createDataFrame([("pkg.alpha.Service.run", "a/tests/b.py")], "q string, p string").select(
        N.terminal(F.col("q")).alias("t"), N.qualifier(F.col("q")).alias("u"), N.ancestors(F.col("q")).alias("a"), N.tests_bucket(F.col("p")).alias("b"),
        N.within(F.col("q"), "pkg.alph").alias("no"), N.within(F.col("q"), "pkg.alpha").alias("yes"), N.normalised_callee(F.lit("a?.b!.c::d")).alias("c"),
        N.match_score("run", F.lit("x"), F.col("q")).alias("s"),
    ).first()
    assert (row.t, row.u, row.a, row.b) == ("run", "pkg.alpha.Service", ["pkg.alpha.Service", "pkg.alpha", "pkg"], "tests")
    assert (row.no, row.yes, row.c, row.s) == (False, True, "a.b.c.d", 0.9)


GATE = [
    # identifier, candidates (id, name, module, direct), caller module, direct scope, reached; accepted, provenance, reason
    ("pkg.a.f", [("1", "pkg.a.f", "pkg.a", False), ("2", "pkg.b.f", "pkg.b", False)], "pkg.z", [], [], "1", "exact_qname", None),
    ("f", [("1", "pkg.a.f", "pkg.a", False)], "pkg.a", [], [], "1", "module_scoped", None),
    ("f", [("1", "pkg.a.f", "pkg", False)], "pkg.z", [], [], "1", "import_narrowed", None),
    ("f", [("1", "pkg.a.f", "pkg.a", False)], "pkg.z", [], ["pkg.a"], "1", "import_narrowed", None),
    ("f", [("1", "pkg.a.f", "pkg.a", False)], "pkg.z", [], [], None, None, "unique_without_provenance"),
    ("f", [], "pkg.z", [], [], None, None, "no_candidates"),
    ("f", [("1", "pkg.a.f", "pkg.a", False), ("2", "pkg.b.f", "pkg.b", False)], "pkg.z", ["pkg.b"], ["pkg.a", "pkg.b"], "2", "import_narrowed", None),
    ("f", [("1", "pkg.a.f", "pkg.a", False), ("2", "pkg.b.f", "pkg.b", False)], "pkg.z", [], ["pkg.a"], None, None, "ambiguous_no_in_scope_candidate"),
    ("f", [("1", "pkg.a.f", "pkg.a", False), ("2", "pkg.b.f", "pkg.b", False)], "pkg.z", ["pkg.a", "pkg.b"], [], None, None, "ambiguous_multiple_in_scope_candidates"),
    ("f", [("1", "pkg.a.f", "pkg.a", False), ("2", "pkg.b.f", "pkg.b", False)], None, [], [], None, None, "ambiguous_no_caller_module"),
    ("x.f", [("1", "pkg.a.f", "pkg.a", True)], "pkg.z", [], [], "1", "exact_qname", None),
    ("q.b.T.f", [("1", "pkg.b.T.f", "pkg.b", False), ("2", "pkg.b.U.f", "pkg.b", False)], "pkg.z", ["pkg.b"], [], "1", "import_narrowed", None),
]


def test_strict_gate_truth_table(spark):
    sites, cands, direct, reach = [], [], [], []
    for i, (ident, cs, module, scope, far, *_) in enumerate(GATE):
        m = None if module is None else f"{module}"
        sites.append((str(i), ident, None if m is None else f"{m}"))
        cands += [(str(i), *c) for c in cs]
    got = {}
    for i, (ident, cs, module, scope, far, *_) in enumerate(GATE):  # scopes differ by row, so each row is its own run
        s = spark.createDataFrame([sites[i]], "site string, identifier string, caller_module string")
        c = spark.createDataFrame([x for x in cands if x[0] == str(i)], "site string, candidate string, name string, module string, direct boolean")
        d = spark.createDataFrame([(module, x) for x in scope], "caller_module string, module string")
        r = spark.createDataFrame([(module, x) for x in far], "caller_module string, module string")
        got[i] = R.strict_gate(s, c, d, r).first()
    for i, case in enumerate(GATE):
        assert (got[i].accepted, got[i].provenance, got[i].dropped_reason) == case[-3:], case


def test_node_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, f string, g string")
    new = spark.createDataFrame([(1, "a", "n"), (2, "b", "x"), (4, "d", "z")], "id int, f string, g string")
    got = {(r["id"], r.diff_kind, r.field, r.old_value, r.new_value) for r in V.node_changes(old, new, "id", ["f", "g"]).collect()}
    assert got == {(1, "modify", "g", None, "n"), (3, "remove", "node", None, None), (4, "add", "node", None, None)}


def test_python_sources(spark):
    files = [
        ("pkg/__init__.py", "import pkg.service\n"),
        ("pkg/service.py", "class Base:\n    pass\n\nclass Service(Base):\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    def inner():\n        return x\n    return inner()\n\nif True:\n    def helper():\n        pass\n"),
        ("pkg/controller.py", "from .service import Service\n\nclass Controller:\n    def handle(self):\n        return self.service.run()\n"),
        ("bad.py", "def ("), ("none.py", None),
    ]
    rows = python_source.parse(spark.createDataFrame(files, "file_path string, text string")).cache()
    n = python_source.nodes(rows)
    names = {r.qualified_name for r in n.collect()}
    assert names == {"pkg", "pkg.service", "pkg.service.Base", "pkg.service.Service", "pkg.service.Service.run", "pkg.service.helper", "pkg.service.helper.inner", "pkg.service.helper-2", "pkg.controller", "pkg.controller.Controller", "pkg.controller.Controller.handle", "bad", "none"}
    label = {r.structural_id: r.qualified_name for r in n.collect()}
    e = {(label[r.src], label[r.dst], r.edge_type) for r in python_source.edges(rows, n).collect()}
    assert ("pkg.service.Service", "pkg.service.Base", "EXTENDS") in e and ("pkg.controller", "pkg.service", "IMPORTS_DECLARED") in e
    assert ("pkg.service.helper", "pkg.service.helper.inner", "LEXICALLY_CONTAINS") in e
    calls = {(r.name, r.target) for r in rows.filter("kind = 'call'").collect()}
    assert calls == {("pkg.service.Service.run", "helper"), ("pkg.service.helper", "inner"), ("pkg.controller.Controller.handle", "self.service.run")}
    assert rows.filter("error is not null").count() == 1


def test_fan_stream(spark, tmp_path):
    changes = edges(spark, [("a", "b"), ("a", "c")]).withColumn("diff_kind", F.lit("add")).unionByName(edges(spark, [("a", "b")]).withColumn("diff_kind", F.lit("remove")))
    changes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    q = fan_deltas(stream).writeStream.outputMode("complete").format("memory").queryName("fans").start()
    q.processAllAvailable()
    q.stop()
    assert {r.node_id: (r.fan_in, r.fan_out) for r in spark.table("fans").collect()} == {"a": (0, 1), "b": (0, 0), "c": (1, 0)}


def test_fan_totals_outlive_their_trigger(spark, tmp_path):
    from codegrove.streaming.fan_stream import maintain, totals

    schema = "src string, dst string, edge_type string, diff_kind string"
    for rows in ([("a", "b", "CALLS", "add"), ("a", "c", "CALLS", "add")], [("c", "b", "CALLS", "add"), ("a", "c", "CALLS", "remove")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        maintain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.node_id: (r.fan_in, r.fan_out) for r in totals(spark, f"{tmp_path}/out").collect()} == {"a": (0, 1), "b": (2, 0), "c": (0, 1)}


def test_descendants_end_on_a_cycle(spark):
    tree = edges(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    got = {(r["id"], r.depth) for r in G.descendants(tree, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_patched_rows_take_new_values_and_keep_removed_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, v int")
    new = spark.createDataFrame([("a", 1), ("b", None), ("d", 4)], "id string, v int")
    got = {tuple(r) for r in V.patched_rows(old, new, "id", ["v"]).collect()}
    assert got == {("a", 1, "committed"), ("b", None, "overlay_changed"), ("c", None, "overlay_removed"), ("d", 4, "overlay_added")}


def test_patched_fan_keeps_nodes_without_changes_and_stops_at_zero(spark):
    fan = spark.createDataFrame([("a", "CALLS", 0, 1), ("b", "CALLS", 1, 0), ("c", "CALLS", 2, 2)], "node_id string, edge_kind string, fan_in long, fan_out long")
    rows = [("a", "b", "CALLS", "remove"), ("a", "b", "CALLS", "remove"), ("c", "d", "CALLS", "add")]
    changes = V.fan_changes(spark.createDataFrame(rows, "src string, dst string, edge_type string, diff_kind string"))
    got = {r[0]: tuple(r)[2:] for r in V.patched_fan(fan, changes).collect()}
    assert got == {"a": (0, 0, "overlay_changed"), "b": (0, 0, "overlay_changed"), "c": (2, 3, "overlay_changed"), "d": (1, 0, "overlay_added")}


def test_patched_lookup_marks_removed_matches_and_adds_new_ones(spark):
    old = spark.createDataFrame([("1", "m.a", 0.9), ("2", "m.b", 0.6)], "id string, qualified_name string, score double")
    added = spark.createDataFrame([("1", "m.a"), ("3", "m.c")], "id string, qualified_name string")
    got = [tuple(r) for r in V.patched_lookup(old, added, old.filter("id = '2'"), "id", 0.55, 10).collect()]
    assert got == [("1", "m.a", 0.9, "committed", "active"), ("2", "m.b", 0.6, "overlay_removed", "stale"), ("3", "m.c", 0.55, "overlay_added", "active")]


def test_rescue_takes_the_nearest_reached_candidate_of_ambiguous_sites_only(spark):
    decisions = spark.createDataFrame(
        [("s1", None, None, "ambiguous_no_in_scope_candidate"), ("s2", None, None, "unique_without_provenance"), ("s3", "x", "exact_qname", None), ("s4", None, None, "ambiguous_no_in_scope_candidate")],
        "site string, accepted string, provenance string, dropped_reason string",
    )
    sites = spark.createDataFrame([(f"s{i}", "m") for i in range(1, 5)], "site string, caller_module string")
    c = spark.createDataFrame([("s1", "far", "p.f", "p"), ("s1", "near", "q.f", "q"), ("s2", "near", "q.f", "q"), ("s4", "lost", "z.f", "z"), ("s4", "gone", "y.f", "y")], "site string, candidate string, name string, module string")
    distances = spark.createDataFrame([("m", "p", 3), ("m", "q", 1)], "caller_module string, module string, distance long")
    got = {r["site"]: (r["accepted"], r["dropped_reason"], r["rescued"]) for r in R.rescue(decisions, sites, c, distances).collect()}
    assert got == {"s1": ("near", None, True), "s2": (None, "unique_without_provenance", False), "s3": ("x", None, False), "s4": (None, "ambiguous_no_in_scope_candidate", False)}


def test_drop_buckets(spark):
    cases = [
        ("a.then", False, "no_candidates", 0, "fluent_or_promise_chain_shape", "outside_static_contract"),
        ("map", False, "no_candidates", 0, "dynamic_member_terminal_shape", "outside_static_contract"),
        ("a.b", True, None, None, "fixture_or_generated_shape", "outside_static_contract"),
        ("a.server.b", False, "x", 2, "namespace_or_module_object_miss_shape", "insufficient_static_evidence"),
        ("a.index.b", False, "unique_without_provenance", 1, "runtime_composed_surface_shape", "outside_static_contract"),
        (None, False, "no_candidates", 3, "no_in_repo_callable_target", "insufficient_static_evidence"),
        ("a.b", False, "invalid_observation_shape", 1, "unclassified_persisted_drop", "structural_mismatch"),
        ("a.b", False, None, 1, "unclassified_persisted_drop", "unclassified"),
    ]
    rows = spark.createDataFrame(cases, "identifier string, fixture boolean, reason string, n int, want string, public string")
    c = F.col
    got = rows.withColumn("bucket", diagnostics.drop_bucket(c("identifier"), c("fixture"), c("reason"), c("n"))).withColumn("out", diagnostics.public_bucket(c("bucket"), c("reason")))
    assert all((r["bucket"], r["out"]) == (r["want"], r["public"]) for r in got.collect())
