"""Reports over the code graph with a working copy's changes laid over the committed snapshot.

Committed nodes and calls and those of the working copy are two overlapping cuts of the catalogue graph.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.operators import overlay as V
from codegrove.operators.rollups import fan_stats
from codegrove.plans.registry import query

C = F.col
FIELDS = ["node_type", "qualified_name", "start_line", "end_line"]
_COLS = "structural_id, node_type, language, qualified_name, file_path, start_line"
_OLD = f"(SELECT {_COLS}, end_line FROM @nodes n WHERE start_line % 11 <> 0)"
_NEW = f"(SELECT {_COLS}, CASE WHEN start_line % 7 = 0 THEN end_line + 1 ELSE end_line END AS end_line FROM @nodes n WHERE start_line % 13 <> 0)"
_ROWS = f"""(SELECT coalesce(a.structural_id, b.structural_id) AS structural_id, {', '.join(f'CASE WHEN b.structural_id IS NULL THEN a.{f} ELSE b.{f} END AS {f}' for f in [*FIELDS, 'file_path', 'language'])},
CASE WHEN a.structural_id IS NULL THEN 'overlay_added' WHEN b.structural_id IS NULL THEN 'overlay_removed' WHEN a.end_line = b.end_line THEN 'committed' ELSE 'overlay_changed' END AS row_origin
FROM {_OLD} a FULL JOIN {_NEW} b ON a.structural_id = b.structural_id)"""


def _sides(g):
    n = g.nodes
    new = n.filter("start_line % 13 <> 0").withColumn("end_line", F.when(C("start_line") % 7 == 0, C("end_line") + 1).otherwise(C("end_line")))
    return n.filter("start_line % 11 <> 0"), new


def _rows(g):
    return V.patched_rows(*_sides(g), "structural_id", [*FIELDS, "file_path", "language"])


@query("D14_patched_overviews", f"SELECT structural_id, {', '.join(FIELDS)}, row_origin FROM {_ROWS} x WHERE node_type IN ('callable', 'classifier')")
def d14(g):
    return _rows(g).filter(C("node_type").isin("callable", "classifier")).select("structural_id", *FIELDS, "row_origin")


_TALLY = "count(*) FILTER (WHERE row_origin <> 'overlay_removed') AS nodes, count(*) FILTER (WHERE row_origin = 'overlay_added') AS added, count(*) FILTER (WHERE row_origin = 'overlay_removed') AS removed, count(*) FILTER (WHERE row_origin = 'overlay_changed') AS changed"


def _tally(rows, *keys):
    o = C("row_origin")
    return rows.groupBy(*keys).agg(F.count_if(o != "overlay_removed").alias("nodes"), *[F.count_if(o == f"overlay_{k}").alias(k) for k in ("added", "removed", "changed")])


@query("D12_patched_structural_index", f"SELECT language, node_type, {_TALLY} FROM {_ROWS} x GROUP BY 1, 2")
def d12(g):
    return _tally(_rows(g), "language", "node_type")


@query("D15_patched_file_outline", f"SELECT file_path, node_type, {_TALLY} FROM {_ROWS} x WHERE node_type IN ('module', 'callable') GROUP BY 1, 2")
def d15(g):
    return _tally(_rows(g).filter(C("node_type").isin("module", "callable")), "file_path", "node_type")


@query("D13_patched_module_overview", f"SELECT node_type, {_TALLY} FROM {_ROWS} x WHERE qualified_name = 'ASIA.NATION_2' OR starts_with(qualified_name, 'ASIA.NATION_2.') GROUP BY 1")
def d13(g):
    q = C("qualified_name")
    return _tally(_rows(g).filter((q == "ASIA.NATION_2") | q.startswith("ASIA.NATION_2.")), "node_type")


@query("D8_grouped_changes", f"SELECT row_origin, node_type, count(*) AS n_rows, min(qualified_name) AS first_name, max(qualified_name) AS last_name FROM {_ROWS} x WHERE row_origin <> 'committed' GROUP BY 1, 2")
def d8(g):
    q = C("qualified_name")
    return _rows(g).filter("row_origin <> 'committed'").groupBy("row_origin", "node_type").agg(F.count("*").alias("n_rows"), F.min(q).alias("first_name"), F.max(q).alias("last_name"))


_HIT = "contains(lower(qualified_name), '.o111')"


@query(
    "D17_patched_symbol_lookup",
    f"""SELECT structural_id, qualified_name, score, row_origin, match_status FROM (
    SELECT structural_id, qualified_name, CAST(CASE WHEN row_origin = 'overlay_added' THEN 0.55 WHEN ends_with(lower(qualified_name), '.o111') THEN 0.9 ELSE 0.6 END AS DOUBLE) AS score,
    CASE WHEN row_origin = 'overlay_changed' THEN 'committed' ELSE row_origin END AS row_origin, CASE WHEN row_origin = 'overlay_removed' THEN 'stale' ELSE 'active' END AS match_status
    FROM {_ROWS} x WHERE node_type = 'callable' AND {_HIT}) y ORDER BY score DESC, qualified_name, structural_id LIMIT 200""",
)
def d17(g):
    old, new = (s.filter(f"node_type = 'callable' and {_HIT}") for s in _sides(g))
    low = F.lower("qualified_name")
    scored = old.withColumn("score", F.when(low.endswith(".o111"), 0.9).otherwise(0.6))
    gone = old.join(new.select("structural_id"), "structural_id", "left_anti")
    return V.patched_lookup(scored, new, gone, "structural_id", 0.55, 200)


_CALLS_OLD = "(SELECT src, dst, edge_type FROM @calls c WHERE substr(src, 1, 1) <> '0')"
_CALLS_NEW = "(SELECT src, dst, edge_type FROM @calls c WHERE substr(dst, 1, 1) <> 'f')"
_DIFF = f"(SELECT *, 'add' AS diff_kind FROM (SELECT * FROM {_CALLS_NEW} a EXCEPT SELECT * FROM {_CALLS_OLD} b) x UNION ALL SELECT *, 'remove' FROM (SELECT * FROM {_CALLS_OLD} a EXCEPT SELECT * FROM {_CALLS_NEW} b) y)"


def _calls(g):
    c = g.calls
    return c.filter("substr(src, 1, 1) <> '0'"), c.filter("substr(dst, 1, 1) <> 'f'")


def _call_changes(g):
    return V.edge_changes(*_calls(g), ["src", "dst", "edge_type"])


_ENDS = "(SELECT src AS node_id, edge_type AS edge_kind, 0 AS i, 1 AS o{k} FROM {t} s UNION ALL SELECT dst, edge_type, 1, 0{k} FROM {t} t)"


@query(
    "D19_patched_fan",
    f"""WITH diff AS {_DIFF}, f AS (SELECT node_id, edge_kind, sum(i) AS fan_in, sum(o) AS fan_out FROM {_ENDS.format(k='', t=_CALLS_OLD)} x GROUP BY 1, 2),
    d AS (SELECT node_id, edge_kind, sum(CASE diff_kind WHEN 'add' THEN i ELSE -i END) AS d_in, sum(CASE diff_kind WHEN 'add' THEN o ELSE -o END) AS d_out FROM {_ENDS.format(k=', diff_kind', t='diff')} x GROUP BY 1, 2)
    SELECT coalesce(f.node_id, d.node_id) AS node_id, coalesce(f.edge_kind, d.edge_kind) AS edge_kind, CAST(greatest(0, coalesce(fan_in, 0) + coalesce(d_in, 0)) AS BIGINT) AS fan_in,
    CAST(greatest(0, coalesce(fan_out, 0) + coalesce(d_out, 0)) AS BIGINT) AS fan_out, CASE WHEN f.node_id IS NULL THEN 'overlay_added' WHEN coalesce(d_in, 0) <> 0 OR coalesce(d_out, 0) <> 0 THEN 'overlay_changed' ELSE 'committed' END AS row_origin
    FROM f FULL JOIN d ON f.node_id = d.node_id AND f.edge_kind = d.edge_kind""",
)
def d19(g):
    return V.patched_fan(fan_stats(_calls(g)[0]), V.fan_changes(_call_changes(g)))


@query("D21_caller_transitions", f"SELECT src, count(*) FILTER (WHERE diff_kind = 'add') AS added, count(*) FILTER (WHERE diff_kind = 'remove') AS removed, count(*) FILTER (WHERE diff_kind = 'add') - count(*) FILTER (WHERE diff_kind = 'remove') AS delta FROM {_DIFF} x GROUP BY src")
def d21(g):
    return V.caller_transitions(_call_changes(g))


_SIZE = "(SELECT split_part(qualified_name, '.', 1) || '.' || split_part(qualified_name, '.', 2) AS module, count(*) AS n FROM {t} s WHERE node_type <> 'module' GROUP BY 1)"


@query("D20_patched_hotspots", f"SELECT a.module, greatest(0, a.n + coalesce(p.n, 0) - coalesce(m.n, 0)) AS size FROM {_SIZE.format(t=_OLD)} a LEFT JOIN {_SIZE.format(t=f'(SELECT * FROM {_ROWS} r WHERE row_origin = {chr(39)}overlay_added{chr(39)})')} p ON a.module = p.module LEFT JOIN {_SIZE.format(t=f'(SELECT * FROM {_ROWS} r WHERE row_origin = {chr(39)}overlay_removed{chr(39)})')} m ON a.module = m.module ORDER BY size DESC, a.module LIMIT 10")
def d20(g):
    old, _ = _sides(g)
    module = F.substring_index("qualified_name", ".", 2).alias("module")
    size = old.filter("node_type <> 'module'").groupBy(module).agg(F.count("*").alias("n"))
    o = C("row_origin")
    sign = F.when(o == "overlay_added", 1).when(o == "overlay_removed", -1)
    delta = _rows(g).filter(sign.isNotNull() & (C("node_type") != "module")).groupBy(module).agg(F.sum(sign).alias("delta"))
    total = F.greatest(F.lit(0), C("n") + F.coalesce("delta", F.lit(0)))
    return size.join(delta, "module", "left").select("module", total.alias("size")).orderBy(F.desc("size"), "module").limit(10)
