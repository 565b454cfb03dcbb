"""The call contract on hand-made sites, parameters, globs and stored tables."""

import pytest
from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.functions import params as P
from codegrove.operators import contract as K
from codegrove.sources import sinks
from codegrove.sources.globs import glob_pattern

# identifier, caller module, candidates (id, name, module, direct), direct scope, reach; accepted, provenance, reason, in scope
CASES = [
    ("f", "p0.z", [], [], [], None, None, "no_candidates", 0),
    ("p1.a.f", "p1.z", [("1", "p1.a.f", "p1.a", True), ("2", "p1.b.f", "p1.b", True)], [], [], "1", "exact_qname", None, 1),
    ("p2.T", "p2.z", [("1", "p2.T.__init__", "p2.q", False)], [], [], "1", "exact_qname", None, 1),
    ("p3.index.m.f", "p3.z", [("1", "p3.m.f", "p3.q", False)], [], [], "1", "exact_qname", None, 1),
    ("p4.m.f", "p4.z", [("1", "p4.m.C.f", "p4.m", False)], [], [], "1", "exact_qname", None, 1),
    ("x.f", "p5.z", [("1", "p5.a.f", "p5.a", True)], [], [], "1", "exact_qname", None, 1),
    ("f", "p6.z", [("1", "p6.z.f", "p6.z", True)], [], [], "1", "module_scoped", None, 1),
    ("f", "p7.z", [("1", "p7.f", "p7", True)], [], [], "1", "import_narrowed", None, 1),
    ("f", "p8.z", [("1", "p8.a.sub.f", "p8.a.sub", True)], [], ["p8.a"], "1", "import_narrowed", None, 1),
    ("f", "p9.z", [("1", "p9.z.sub.f", "p9.z.sub", True)], [], [], "1", "import_narrowed", None, 1),
    ("f", "q0.z", [("1", "q0.a.f", "q0.a", True)], ["q0.b"], ["q0.b"], None, None, "unique_without_provenance", 0),
    ("f", None, [("1", "q1.a.f", "q1.a", True), ("2", "q1.b.f", "q1.b", True)], [], [], None, None, "ambiguous_no_caller_module", 0),
    ("f", "q2.z", [("1", "q2.a.f", "q2.a", True), ("2", "q2.b.f", "q2.b", True)], ["q2.b"], ["q2.a", "q2.b"], "2", "import_narrowed", None, 1),
    ("f", "q3.z", [("1", "q3.a.f", "q3.a", True), ("2", "q3.b.f", "q3.b", True)], [], ["q3.a"], None, None, "ambiguous_no_in_scope_candidate", 0),
    ("f", "q4.z", [("1", "q4.a.f", "q4.a", True), ("2", "q4.b.f", "q4.b", True)], ["q4.a", "q4.b"], [], None, None, "ambiguous_multiple_in_scope_candidates", 2),
    ("r.q5.T.f", "q5.z", [("1", "q5.T.f", "q5.b", False), ("2", "q5.U.f", "q5.b", False)], ["q5.b"], [], "1", "import_narrowed", None, 1),
    ("r.q6.T.f", "q6.z", [("1", "q6.T.f", "q6.z", False), ("2", "q6.U.f", "q6.z", False)], [], [], "1", "module_scoped", None, 1),
    ("f", "q7.z", [("1", "q7.a.sub.f", "q7.a.sub", True), ("2", "q7.b.f", "q7.b", True)], ["q7.a"], ["q7.a"], None, None, "ambiguous_no_in_scope_candidate", 0),
]


def frames(spark):
    sites = spark.createDataFrame([(str(i), c[0], c[1]) for i, c in enumerate(CASES)], "site string, identifier string, caller_module string")
    cands = spark.createDataFrame([(str(i), *x) for i, c in enumerate(CASES) for x in c[2]], "site string, candidate string, name string, module string, direct boolean")
    pairs = lambda k: spark.createDataFrame([(c[1], m) for c in CASES for m in c[k]], "caller_module string, module string")
    return sites, cands, pairs(3), pairs(4)


def test_decisions(spark):
    got = {int(r["site"]): r for r in K.decide(*frames(spark)).collect()}
    for i, c in enumerate(CASES):
        assert (got[i].accepted, got[i].provenance, got[i].dropped_reason, got[i].in_scope_count) == c[-4:], c
        assert got[i].candidate_count == len(c[2])
        assert got[i].module_hints == ",".join(sorted({x[2] for x in c[2]})[:8])
    below = {int(r["site"]): r.accepted for r in K.decide(*frames(spark), descendants=True).collect()}
    assert below[17] == "1"


def test_empty_tables_have_no_decisions(spark):
    assert K.decide(*(f.limit(0) for f in frames(spark))).collect() == []


def test_reachable_modules(spark):
    pairs = lambda cols, *x: spark.createDataFrame(list(x), cols)
    callers = pairs("caller_module string", ("a.b.c",), ("a.b.c",), (None,), ("",))
    scopes = pairs("caller_module string, module string", ("a.b.c", "m"), ("z", "y"), (None, "q"))
    reach = pairs("caller_module string, module string", ("a.b.c", "m"), ("a.b.c", "n"))
    barrels = pairs("module string, target string", ("n", "n.x"), ("a.b.c", "own"), ("a.b", "not"), ("n.x", "not"))
    got = sorted(tuple(r) for r in K.reachable_modules(callers, scopes, reach, barrels).collect())
    assert got == [("a.b.c", m) for m in ["a", "a.b", "a.b.c", "m", "n", "n.x", "own"]]
    assert K.reachable_modules(callers.limit(0), scopes, reach, barrels).collect() == []


def test_gate_reasons(spark):
    rows = [
        ("accepted", "1", "exact_qname", None, 1, True, None), ("accepted", "1", "exact_qname", None, 1, False, "outside_in_repo_scope"), ("accepted", None, "exact_qname", None, 1, True, "invalid_observation_shape"),
        ("accepted", "1", "guess", None, 1, True, "invalid_observation_shape"), ("accepted", "1", "exact_qname", "no_candidates", 1, True, "invalid_observation_shape"), ("dropped", None, None, "unique_without_provenance", 1, False, "insufficient_static_evidence"),
        ("dropped", None, None, "other", 1, False, "invalid_observation_shape"), ("dropped", None, None, None, 1, False, "invalid_observation_shape"), ("dropped", None, None, "no_candidates", 0, False, "no_in_repo_candidate"), ("odd", None, None, None, 1, False, "invalid_observation_shape"),
    ]
    c = F.col
    df = spark.createDataFrame(rows, "s string, a string, p string, d string, n int, own boolean, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", K.gate_reason(c("s"), c("a"), c("p"), c("d"), c("n"), c("own"))).collect())


def test_names(spark):
    rows = [("pkg.index.m", "pkg.m"), ("x.module.exports.go", "x.go"), ("lib.index", "lib.index"), ("module.exports", "module.exports"), ("myindex.a", "myindex.a"), ("", "")]
    got = spark.createDataFrame(rows, "n string, want string").select("want", F.array_join(N.proxy_parts(F.col("n")), ".").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_parameters():
    assert P.kinds("Method") == ["callable"] and P.kinds(None) == P.kinds("all") == P.NODE_KINDS
    assert P.bounded("500", 200) == 200 and P.bounded(None, 200, 5) == 5 and P.direction(None) == "both" and P.edge_type("*") is None
    for call in (lambda: P.kinds("table"), lambda: P.bounded(0, 5), lambda: P.bounded("x", 5), lambda: P.direction("up"), lambda: P.edge_type("CALLS"), lambda: P.known({"a": 1}, ["b"])):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.py", "a/b.py", True), ("*.py", "a/b.pyc", False), ("src/**", "src/a/b", True), ("src/**", "lib/src/a", False), ("a/*.py", "a/b.py", True), ("a/*.py", "a/b/c.py", False), ("**/x.js", "x.js", True), ("**/x.js", "a/b/x.js", True), ("build/", "a/build/c", True), ("build/", "build", False), ("f?.t", "fa.t", True), ("a.b", "aXb", False)],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(glob_pattern(glob), path)) == hit


def test_tables_replace_clear_and_rename_partitions(spark):
    table = sinks.Table(spark, "t", "part")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, part string")
    table.write(rows((1, "a"), (1, "a"), (2, "b")), ["id", "part"])
    table.write(rows((3, "b")))
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (3, "b")} and table.read().count() == 2
    table.rename("b", "c")
    table.clear("a")
    assert {tuple(r) for r in table.read().collect()} == {(3, "c")}
    with pytest.raises(ValueError):
        table.rename("c", "c")
