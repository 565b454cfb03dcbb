"""Call resolution over the supplied tables.

Call sites are the distinct (supplier, part name) pairs; a part name has many parts that bear it, each in
the module of its brand. A supplier's own module is the brand it ships most often, its direct scope the brands
of its large shipments, and it reaches every brand of those suppliers' brands.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.operators import resolution as R
from codegrove.plans.callsites import CallSites
from codegrove.plans.registry import query

C = F.col

_SITES = """sites AS (SELECT DISTINCT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49),
home AS (SELECT l_suppkey, arg_max(p_brand, (n, p_brand)) AS brand FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x GROUP BY 1),
s AS (SELECT CAST(l_suppkey AS VARCHAR) || '/' || p_name AS site, CASE WHEN l_suppkey % 2 = 0 THEN p_name ELSE 'root.' || brand || '.' || p_name END AS identifier, 'root.' || brand AS caller_module FROM sites JOIN home USING (l_suppkey)),
c AS (SELECT DISTINCT s.site, s.identifier, s.caller_module, CAST(p_partkey AS VARCHAR) AS candidate, 'root.' || p_brand || '.' || part.p_name AS name, 'root.' || p_brand AS module FROM s JOIN part ON split_part(site, '/', 2) = part.p_name WHERE p_partkey % 7 = 0),
d AS (SELECT DISTINCT 'root.' || h.brand AS caller_module, 'root.' || p_brand AS module FROM lineitem JOIN part ON l_partkey = p_partkey JOIN home h USING (l_suppkey) WHERE l_quantity >= 50 AND l_partkey % 20 = 0)"""


_GATE = f"""WITH {_SITES},
k AS (SELECT s.site, s.identifier, s.caller_module, candidate, name, c.module, contains(s.identifier, '.') AND name = s.identifier AS named,
      coalesce(c.module = s.caller_module OR c.module = 'root' OR d.module IS NOT NULL, false) AND candidate IS NOT NULL AS near
      FROM s LEFT JOIN c ON s.site = c.site LEFT JOIN d ON d.caller_module = s.caller_module AND d.module = c.module),
g AS (SELECT site, identifier, caller_module, count(candidate) AS n, min(candidate) AS one, count(*) FILTER (WHERE named) AS nn, min(candidate) FILTER (WHERE named) AS cn,
      count(*) FILTER (WHERE near) AS nr, min(candidate) FILTER (WHERE near) AS cr,
      count(*) FILTER (WHERE near AND named) AS nt, min(candidate) FILTER (WHERE near AND named) AS ct,
      coalesce(bool_or(module = caller_module), false) AS same, coalesce(bool_or(near), false) AS reached FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN n = 0 THEN 'no_candidates' WHEN nn = 1 THEN '+exact_qname' WHEN n = 1 AND same THEN '+module_scoped' WHEN n = 1 AND reached THEN '+import_narrowed'
      WHEN n = 1 THEN 'unique_without_provenance' WHEN nr = 1 THEN '+import_narrowed' WHEN nr > 1 AND nt = 1 THEN '+import_narrowed'
      WHEN nr = 0 THEN 'ambiguous_no_in_scope_candidate' ELSE 'ambiguous_multiple_in_scope_candidates' END AS o FROM g)
"""
_GATE_ROWS = _GATE + """SELECT site, CASE WHEN o NOT LIKE '+%' THEN NULL WHEN nn = 1 THEN cn WHEN n = 1 THEN one WHEN nr = 1 THEN cr ELSE ct END AS accepted,
CASE WHEN o LIKE '+%' THEN substr(o, 2) END AS provenance, CASE WHEN o NOT LIKE '+%' THEN o END AS dropped_reason, n AS candidate_count, nr AS in_scope_count FROM r"""


@query("C7_strict_gate", _GATE_ROWS)
def c7(g):
    calls = CallSites(g)
    return calls.each(calls.decisions.select("site", "accepted", "provenance", "dropped_reason", "candidate_count", "in_scope_count"))


@query("A20_resolution_stats", _GATE + "SELECT CASE WHEN o LIKE '+%' THEN substr(o, 2) END AS provenance, CASE WHEN o NOT LIKE '+%' THEN o END AS dropped_reason, count(*) AS sites FROM r GROUP BY 1, 2")
def a20_stats(g):
    return CallSites(g).decisions.groupBy("provenance", "dropped_reason").agg(F.sum("sites").alias("sites"))


@query("C15_persistence_gate", _GATE + "SELECT site, o LIKE '+%' AS persist, CASE WHEN o LIKE '+%' THEN 'accepted' WHEN o = 'no_candidates' THEN 'external' ELSE 'unresolved' END AS gate_reason FROM r")
def c15(g):
    d = C("dropped_reason")
    calls = CallSites(g)
    return calls.each(calls.decisions).select("site", d.isNull().alias("persist"), F.when(d.isNull(), "accepted").when(d == "no_candidates", "external").otherwise("unresolved").alias("gate_reason"))


@query("C1_normalised_identifiers", f"WITH {_SITES}, f AS (SELECT caller_module, regexp_extract(identifier, '[^.]*$') AS t, min(identifier) AS form FROM s WHERE contains(identifier, '.') GROUP BY 1, 2 HAVING count(DISTINCT identifier) = 1) SELECT site, CASE WHEN contains(identifier, '.') THEN identifier ELSE coalesce(form, identifier) END AS normalised FROM s LEFT JOIN f ON s.caller_module = f.caller_module AND regexp_extract(identifier, '[^.]*$') = t")
def c1(g):
    calls = CallSites(g)
    return calls.each(R.normalise_identifiers(calls.keys, ["caller_module"]).select("site", "normalised"))


@query("C2_caller_records", f"WITH {_SITES} SELECT caller_module, string_agg(DISTINCT identifier, '|' ORDER BY identifier) AS identifiers FROM s GROUP BY caller_module")
def c2(g):
    return CallSites(g).keys.groupBy("caller_module").agg(F.array_join(F.array_sort(F.collect_set("identifier")), "|").alias("identifiers"))


@query("C17_callsite_pairs", f"WITH {_SITES} SELECT site, count(*) AS pairs, min(candidate) AS first_callee FROM c GROUP BY site")
def c17(g):
    calls = CallSites(g)
    return calls.each(calls.candidates.groupBy("site").agg(F.sum("n").alias("pairs"), F.min("candidate").alias("first_callee")))


@query("X1_rejected_buckets", _GATE + "SELECT coalesce(bucket, 'total') AS bucket, count(*) AS sites FROM (SELECT CASE WHEN o = 'no_candidates' AND contains(identifier, '.') THEN 'external_dotted' WHEN o = 'no_candidates' THEN 'external_plain' WHEN o LIKE 'ambiguous%' THEN 'ambiguous' ELSE 'weak_static_evidence' END AS bucket FROM r WHERE o NOT LIKE '+%') x GROUP BY ROLLUP (bucket)")
def x1(g):
    d = C("dropped_reason")
    rows = CallSites(g).decisions.filter(d.isNotNull())
    bucket = F.when((d == "no_candidates") & C("identifier").contains("."), "external_dotted").when(d == "no_candidates", "external_plain").when(d.startswith("ambiguous"), "ambiguous").otherwise("weak_static_evidence")
    return rows.rollup(bucket.alias("bucket")).agg(F.sum("sites").alias("sites")).select(F.coalesce("bucket", F.lit("total")).alias("bucket"), "sites")
