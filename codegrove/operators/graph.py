"""Reachability, cycles and integrity of a directed graph held as edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions.storage import stored


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """src, dst, distance of all reachable pairs, by semi-naive rounds: only new pairs are extended."""
    step = stored(edges.select("src", "dst").distinct())
    seen = stored(step.withColumn("distance", F.lit(1).cast("long")))
    front, d = seen, 1
    while max_depth is None or d < max_depth:
        d += 1
        hop = step.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
        new = front.join(hop, front["dst"] == hop["mid"]).select("src", F.col("next").alias("dst")).distinct()
        front = stored(new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("distance", F.lit(d).cast("long")))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of nodes in a cycle of two or more nodes.

    Forward and backward minima spread over what remains; nodes that agree on both form a component, and
    edges between settled or disagreeing nodes fall away. State stays linear in nodes and edges.
    """
    e = stored(edges.filter("src <> dst").select("src", "dst").distinct())
    done: DataFrame | None = None
    while not e.isEmpty():
        ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        fore, back = _least(e, ids), _least(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids)
        both = stored(fore.withColumnRenamed("low", "f").join(back.withColumnRenamed("low", "b"), "id"))
        own = both.filter("f = b").select("id", F.col("f").alias("component"))
        done = own if done is None else done.unionByName(own)
        rest = both.filter("f <> b")
        a, b = (rest.select(F.col("id").alias(x), F.col("f").alias(f"f_{x}"), F.col("b").alias(f"b_{x}")) for x in ("src", "dst"))
        e = stored(e.join(a, "src").join(b, "dst").filter("f_src = f_dst and b_src = b_dst").select("src", "dst"))
    if done is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sized = stored(done).groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return stored(done).join(sized, "component", "left_semi").select("id", "component")


def _least(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, low: the smallest id that reaches it (itself included), until nothing changes."""
    low = stored(ids.withColumn("low", F.col("id")))
    while True:
        came = edges.join(low.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("via"))
        new = stored(low.join(came, "id", "left").select("id", F.least("low", F.coalesce("via", "low")).alias("low"), (F.col("via") < F.col("low")).alias("changed")))
        if new.filter("changed").isEmpty():
            return new.select("id", "low")
        low = new.select("id", "low")


def descendants(contains: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth (the least) below the roots (id); what was reached is not extended again, so a cycle ends."""
    tree = stored(contains.select("src", "dst"))
    front = stored(roots.join(tree.withColumnRenamed("src", "id"), "id").select(F.col("id").alias("root"), F.col("dst").alias("id"), F.lit(1).cast("long").alias("depth")))
    out = front
    while not front.isEmpty():
        new = front.join(tree.withColumnRenamed("src", "id"), "id").select("root", F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth")).distinct()
        front = stored(new.join(out.select("root", "id"), ["root", "id"], "left_anti"))
        out = out.unionByName(front)
    return out


def short_cycles(edges: DataFrame) -> DataFrame:
    """Two-node cycles (smaller id first) and self-cycles."""
    two = edges.select("src", "dst").filter("src < dst").join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).filter("src < dst"), ["src", "dst"], "left_semi")
    return two.unionByName(edges.filter("src = dst").select("src", "dst")).distinct()


def orphans(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """Nodes other than modules that nothing contains."""
    return nodes.filter("node_type <> 'module'").join(contains.select(F.col("dst").alias("structural_id")), "structural_id", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    ids = nodes.select("structural_id")
    a = edges.join(ids.withColumnRenamed("structural_id", "src"), "src", "left_anti").select("src", "dst", "edge_type")
    return a.unionByName(edges.join(ids.withColumnRenamed("structural_id", "dst"), "dst", "left_anti").select("src", "dst", "edge_type")).distinct()


def containment_faults(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """structural_id, fault: modules inside others than modules, several parents, spans outside the parent's."""
    child = nodes.select(F.col("structural_id").alias("dst"), F.col("node_type").alias("kind"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    parent = nodes.select(F.col("structural_id").alias("src"), F.col("node_type").alias("above"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    both = contains.join(child, "dst").join(parent, "src")
    module = both.filter("kind = 'module' and above <> 'module'").select("dst", F.lit("module_target").alias("fault"))
    many = contains.groupBy("dst").count().filter("count > 1").select("dst", F.lit("several_parents").alias("fault"))
    span = both.filter("above = 'classifier' and (s < ps or e > pe)").select("dst", F.lit("span").alias("fault"))
    return module.unionByName(many).unionByName(span).withColumnRenamed("dst", "structural_id")
