"""Rescue of ambiguous call sites and the diagnosis of those that stay rejected."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.operators import diagnostics as X
from codegrove.operators import resolution as R
from codegrove.plans.calls import _GATE, _SITES
from codegrove.plans.callsites import CallSites
from codegrove.plans.registry import query

C = F.col

_FAR = """, w AS (SELECT caller_module AS a, module AS b, 1 AS k FROM d UNION SELECT a, module, k + 1 FROM w JOIN d ON b = caller_module WHERE k < 30),
far AS (SELECT a, b, min(k) AS k FROM w GROUP BY 1, 2),
near AS (SELECT site, module, name, candidate, CASE WHEN module = caller_module THEN 0 ELSE far.k END AS k FROM c LEFT JOIN far ON a = caller_module AND b = module),
best AS (SELECT site, candidate AS best, CAST(k AS BIGINT) AS distance FROM near
         QUALIFY row_number() OVER (PARTITION BY site ORDER BY k NULLS LAST, len(string_split(name, '.')), name, candidate) = 1)
"""
_SITES_R = "WITH RECURSIVE " + _SITES
_GATE_R = _GATE.replace("WITH sites", "WITH RECURSIVE sites", 1)


@query("W4_best_by_module_path", f"WITH {_SITES} SELECT site, candidate AS best FROM c QUALIFY row_number() OVER (PARTITION BY site ORDER BY len(string_split(module, '.')), module, name, candidate) = 1")
def w4(g):
    calls = CallSites(g)
    return calls.each(R.best_by_path(calls.candidates))


@query("W5_best_by_distance", _SITES_R + _FAR + "SELECT * FROM best")
def w5(g):
    calls = CallSites(g)
    c = calls.candidates.join(calls.keys.select("site", "caller_module"), "site")
    return calls.each(R.best_by_distance(c, calls.distances))


@query(
    "C13_rescued_decisions",
    _GATE_R + _FAR + """SELECT r.site, CASE WHEN o LIKE 'ambiguous%' THEN CASE WHEN distance IS NOT NULL THEN best END WHEN o NOT LIKE '+%' THEN NULL WHEN nn = 1 THEN cn WHEN n = 1 THEN one WHEN nr = 1 THEN cr ELSE ct END AS accepted,
    CASE WHEN o LIKE '+%' THEN substr(o, 2) WHEN o LIKE 'ambiguous%' AND distance IS NOT NULL THEN 'import_narrowed' END AS provenance,
    CASE WHEN o NOT LIKE '+%' AND NOT (o LIKE 'ambiguous%' AND distance IS NOT NULL) THEN o END AS dropped_reason, o LIKE 'ambiguous%' AND distance IS NOT NULL AS rescued FROM r LEFT JOIN best ON r.site = best.site""",
)
def c13(g):
    calls = CallSites(g)
    return calls.each(R.rescue(calls.decisions, calls.keys, calls.candidates, calls.distances))


_TAILS = [".then", ".finally", ".map", ".server.run", ".index.go", ".Type.make"]
_NAMED = f"SELECT site, identifier || CASE length(identifier) % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(_TAILS))} ELSE '' END AS identifier, contains(caller_module, '3') AS fixture, o AS reason, n FROM r WHERE o NOT LIKE '+%'"
_BUCKETS = f"""(SELECT *, CASE WHEN fixture THEN 'fixture_or_generated_shape' WHEN regexp_matches(identifier, '[.](then|catch)') THEN 'fluent_or_promise_chain_shape'
WHEN regexp_matches(identifier, '[.](finally|in[(]|emit)|(^|[.])(filter|find|flatMap|forEach|includes|map|reduce|slice|some|has|keys|values|entries)$') THEN 'dynamic_member_terminal_shape'
WHEN regexp_matches(identifier, '[.](server|notifications|tools)[.]') THEN 'namespace_or_module_object_miss_shape'
WHEN reason = 'unique_without_provenance' AND contains(identifier, '.index.') THEN 'runtime_composed_surface_shape' WHEN n = 0 THEN 'no_in_repo_callable_target' ELSE 'unclassified_persisted_drop' END AS bucket FROM ({_NAMED}) z)"""


def _rejected(calls):
    """Rejected keys with identifiers of many forms; modules with a 3 in their name stand for fixtures."""
    name = C("identifier")
    tail = F.lit("")
    for i, t in enumerate(_TAILS):
        tail = F.when(F.length(name) % 7 == i, t).otherwise(tail)
    rows = calls.decisions.filter("dropped_reason is not null")
    return rows.select("site", "sites", F.concat(name, tail).alias("identifier"), C("caller_module").contains("3").alias("fixture"), C("dropped_reason").alias("reason"), C("candidate_count").alias("n"))


def _bucketed(calls):
    rows = _rejected(calls).withColumn("bucket", X.drop_bucket(C("identifier"), C("fixture"), C("reason"), C("n")))
    return rows.withColumn("public_bucket", X.public_bucket(C("bucket"), C("reason")))


_PUBLIC = "CASE WHEN bucket IN ('namespace_or_module_object_miss_shape', 'no_in_repo_callable_target', 'unclassified_persisted_drop') THEN 'insufficient_static_evidence' ELSE 'outside_static_contract' END"


@query("X7_drop_buckets", _GATE + f"SELECT site, identifier, bucket, {_PUBLIC} AS public_bucket FROM {_BUCKETS} y")
def x7(g):
    calls = CallSites(g)
    return calls.each(_bucketed(calls).select("site", "identifier", "bucket", "public_bucket"))


@query("E15_public_bucket_totals", _GATE + f"SELECT fixture, public_bucket, count(*) AS sites FROM (SELECT *, {_PUBLIC} AS public_bucket FROM {_BUCKETS} y) x GROUP BY GROUPING SETS ((fixture, public_bucket), (public_bucket), ())")
def e15(g):
    rows = _bucketed(CallSites(g)).select("fixture", "public_bucket", "sites")
    return rows.groupingSets([["fixture", "public_bucket"], ["public_bucket"], []], "fixture", "public_bucket").agg(F.sum("sites").alias("sites"))


@query("X5_name_signals", _GATE + f"""SELECT site, array_to_string(list_sort(list_filter([CASE WHEN true THEN 'identifier_depth:' || len(p) END,
CASE WHEN contains(identifier, '.') THEN 'qualified_identifier' ELSE 'terminal_identifier' END,
CASE WHEN len(p) >= 2 THEN CASE WHEN regexp_matches(p[-2], '^[A-Z]') THEN 'owner_segment:type_like' ELSE 'owner_segment:value_like' END END], lambda x: x IS NOT NULL)), '|') AS signals
FROM (SELECT *, string_split(identifier, '.') AS p FROM ({_NAMED}) z) y""")
def x5(g):
    calls = CallSites(g)
    return calls.each(_rejected(calls).select("site", F.array_join(X.name_signals(C("identifier")), "|").alias("signals")))


@query("E22_callsite_funnel", _GATE + "SELECT contains(caller_module, '3') AS fixture, count(*) AS observed, count(*) FILTER (WHERE o LIKE '+%') AS accepted, count(*) FILTER (WHERE o NOT LIKE '+%') AS not_accepted FROM r GROUP BY ROLLUP (contains(caller_module, '3'))")
def e22(g):
    ok, n = C("accepted").isNotNull(), C("sites")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return CallSites(g).decisions.rollup(C("caller_module").contains("3").alias("fixture")).agg(F.coalesce(F.sum(n), F.lit(0)).alias("observed"), of(ok).alias("accepted"), of(~ok).alias("not_accepted"))


@query("E11_drop_counters", _GATE + "SELECT caller_module, o AS dropped_reason, count(*) AS sites, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(nr) AS BIGINT) AS in_scope FROM r WHERE o NOT LIKE '+%' GROUP BY 1, 2")
def e11(g):
    rows = CallSites(g).decisions.filter("dropped_reason is not null")
    times = lambda col: F.sum(C(col) * C("sites"))
    return rows.groupBy("caller_module", "dropped_reason").agg(F.sum("sites").alias("sites"), times("candidate_count").alias("candidates"), times("in_scope_count").alias("in_scope"))
