"""Change overlays: orders as a committed snapshot and a perturbed working copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.operators import overlay as V
from codegrove.plans.registry import query

C = F.col
FIELDS = ["o_orderstatus", "o_orderpriority", "o_custkey"]

_OLD = "(SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 11 <> 0)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 14 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 13 <> 0)"
_BOTH = f"{_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey"
_CHANGES = "(" + " UNION ALL ".join(
    [f"SELECT a.o_orderkey, 'modify' AS diff_kind, '{f}' AS field, CAST(a.{f} AS VARCHAR) AS old_value, CAST(b.{f} AS VARCHAR) AS new_value FROM {_OLD} a JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS]
    + [f"SELECT coalesce(a.o_orderkey, b.o_orderkey), CASE WHEN a.o_orderkey IS NULL THEN 'add' ELSE 'remove' END, 'node', NULL, NULL FROM {_BOTH} WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL"]
) + ")"


def _sides(g):
    o = g.orders.select("o_orderkey", *FIELDS)
    new = o.filter("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(C("o_orderkey") % 7 == 0, "X").otherwise(C("o_orderstatus")))
    return o.filter("o_orderkey % 11 <> 0"), new.withColumn("o_custkey", F.when(C("o_orderkey") % 14 == 0, C("o_custkey") + 1).otherwise(C("o_custkey")))


def _changes(g):
    old, new = _sides(g)
    return V.node_changes(old, new, "o_orderkey", FIELDS)


@query("D2_node_changes", f"SELECT * FROM {_CHANGES} x")
def d2(g):
    return _changes(g)


@query("D3_edge_changes", f"SELECT o_custkey, o_orderkey, 'add' AS diff_kind FROM (SELECT o_custkey, o_orderkey FROM {_NEW} b EXCEPT SELECT o_custkey, o_orderkey FROM {_OLD} a) x UNION ALL SELECT o_custkey, o_orderkey, 'remove' FROM (SELECT o_custkey, o_orderkey FROM {_OLD} a EXCEPT SELECT o_custkey, o_orderkey FROM {_NEW} b) y")
def d3(g):
    return V.edge_changes(*_sides(g), ["o_custkey", "o_orderkey"])


@query("D6_overlay_summary", f"SELECT field, count(*) FILTER (WHERE diff_kind = 'add') AS add, count(*) FILTER (WHERE diff_kind = 'modify') AS modify, count(*) FILTER (WHERE diff_kind = 'remove') AS remove FROM {_CHANGES} x GROUP BY field")
def d6(g):
    return V.summary(_changes(g), "field")


@query("D16_affected_customers", f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM {_CHANGES} x)")
def d16(g):
    return g.orders.join(_changes(g).select("o_orderkey").distinct(), "o_orderkey", "left_semi").select("o_custkey").distinct()


_EDGE = f"(SELECT o_custkey, o_orderstatus, 'add' AS diff_kind FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM {_NEW} b EXCEPT SELECT o_custkey, o_orderkey, o_orderstatus FROM {_OLD} a) x UNION ALL SELECT o_custkey, o_orderstatus, 'remove' FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM {_OLD} a EXCEPT SELECT o_custkey, o_orderkey, o_orderstatus FROM {_NEW} b) y)"


@query("D18_patched_pair_counts", f"SELECT coalesce(c.o_custkey, d.o_custkey) AS o_custkey, coalesce(c.o_orderstatus, d.o_orderstatus) AS o_orderstatus, greatest(0, coalesce(n, 0) + coalesce(delta, 0)) AS n, CASE WHEN n IS NULL THEN 'overlay_added' WHEN coalesce(delta, 0) = 0 THEN 'committed' WHEN greatest(0, n + delta) = 0 THEN 'overlay_removed' ELSE 'overlay_changed' END AS row_origin FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {_OLD} a GROUP BY 1, 2) c FULL JOIN (SELECT o_custkey, o_orderstatus, CAST(sum(CASE diff_kind WHEN 'add' THEN 1 ELSE -1 END) AS BIGINT) AS delta FROM {_EDGE} e GROUP BY 1, 2) d ON c.o_custkey = d.o_custkey AND c.o_orderstatus = d.o_orderstatus")
def d18(g):
    old, new = _sides(g)
    keys = ["o_custkey", "o_orderstatus"]
    deltas = V.edge_changes(old, new, ["o_custkey", "o_orderkey", "o_orderstatus"])
    return V.patched_counts(old.groupBy(*keys).agg(F.count("*").alias("n")), deltas, keys, "n")


@query("A32_overlay_counts", f"SELECT count(*) AS changes, count(DISTINCT o_orderkey) AS nodes FROM {_CHANGES} x")
def a32(g):
    return _changes(g).agg(F.count("*").alias("changes"), F.count_distinct("o_orderkey").alias("nodes"))
