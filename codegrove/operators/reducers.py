"""Reports with parameters, over nodes (structural_id, node_type, qualified_name, ...) and edges (src, dst, edge_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.functions import params as P
from codegrove.operators import rollups as R

C = F.col


def _limit(rows: DataFrame, n: int | None, *order) -> DataFrame:
    return rows if n is None else rows.orderBy(*order).limit(n)


def dependency_edges(nodes: DataFrame, edges: DataFrame, **given) -> DataFrame:
    """from_module, to_module, edge_type of module edges.

    module_id, from_module_id, to_module_id (id or name; modules below it count), query (part of a name), edge_type,
    direction of module_id and query, limit (per direction, before the two are merged).
    """
    p = P.known(given, ["module_id", "from_module_id", "to_module_id", "query", "edge_type", "direction", "limit"])
    kind, way, limit = P.edge_type(p.get("edge_type")), P.direction(p.get("direction")), P.bounded(p.get("limit"), P.EDGE_LIMIT)
    m = nodes.filter("node_type = 'module'").select("structural_id", C("qualified_name").alias("name"))
    e = edges if kind is None else edges.filter(C("edge_type") == kind)
    both = e.join(m.select(C("structural_id").alias("src"), C("name").alias("from_module")), "src").join(m.select(C("structural_id").alias("dst"), C("name").alias("to_module")), "dst")

    def below(name: str, end: str, key: str):
        return (C(key) == name) | N.within(C(end), name)

    if p.get("from_module_id"):
        both = both.filter(below(p["from_module_id"], "from_module", "src"))
    if p.get("to_module_id"):
        both = both.filter(below(p["to_module_id"], "to_module", "dst"))

    def side(end: str, key: str) -> DataFrame:
        rows = both
        if p.get("module_id"):
            rows = rows.filter(below(p["module_id"], end, key))
        if p.get("query"):
            rows = rows.filter(F.lower(end).contains(p["query"].strip().lower()))
        return _limit(rows.select("from_module", "to_module", "edge_type").distinct(), limit, "from_module", "to_module", "edge_type")

    if not (p.get("module_id") or p.get("query")):
        return side("from_module", "src")
    out, into = side("from_module", "src"), side("to_module", "dst")
    return {"out": out, "in": into}.get(way, out.unionByName(into).distinct())


def fan_summary(nodes: DataFrame, edges: DataFrame, **given) -> DataFrame:
    """side, node_id, edge_kind, n: the top_k nodes by fan-in and by fan-out; edge_kind, node_kind, min_fan narrow them."""
    p = P.known(given, ["edge_kind", "node_kind", "min_fan", "top_k"])
    top, least = P.bounded(p.get("top_k"), P.TOP_LIMIT, P.TOP), P.bounded(p.get("min_fan"), 1 << 62)
    e = edges if not p.get("edge_kind") else edges.filter(C("edge_type") == p["edge_kind"])
    f = R.fan_stats(e)
    if p.get("node_kind"):
        f = f.join(nodes.filter(C("node_type").isin(P.kinds(p["node_kind"]))).select(C("structural_id").alias("node_id")), "node_id", "left_semi")
    if least:
        f = f.filter(F.greatest("fan_in", "fan_out") >= least)
    side = lambda name, col: f.filter(C(col) > 0).select(F.lit(name).alias("side"), "node_id", "edge_kind", C(col).alias("n")).orderBy(F.desc("n"), "node_id", "edge_kind").limit(top)
    return side("in", "fan_in").unionByName(side("out", "fan_out"))


def symbol_lookup(nodes: DataFrame, query: str, **given) -> DataFrame:
    """structural_id, qualified_name, score: names that contain the query; five times the limit by name, then the best of them."""
    p = P.known(given, ["kind", "limit"])
    n = P.bounded(p.get("limit"), P.LOOKUP_LIMIT, P.TOP)
    low = query.strip().lower()
    hit = nodes.filter(C("node_type").isin(P.kinds(p.get("kind"))) & ((C("structural_id") == low) | F.lower("qualified_name").contains(low)))
    first = hit.orderBy("qualified_name", "file_path", "structural_id").limit(5 * n)
    return first.select("structural_id", "qualified_name", N.match_score(low, C("structural_id"), C("qualified_name")).alias("score")).orderBy(F.desc("score"), "qualified_name", "structural_id").limit(n)


def call_graph(pairs: DataFrame, src: str, dst: str, **given) -> DataFrame:
    """The pairs (src, dst, call_count), narrowed to from_id and to_id, the top_k by count where one is given."""
    p = P.known(given, ["from_id", "to_id", "top_k"])
    rows = pairs
    for key, col in (("from_id", src), ("to_id", dst)):
        if p.get(key):
            rows = rows.filter(C(col) == p[key])
    return _limit(rows, P.bounded(p.get("top_k"), P.TOP_LIMIT), F.desc("call_count"), src, dst)
