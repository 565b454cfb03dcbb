"""Aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_stats(edges: DataFrame) -> DataFrame:
    """node_id, edge_kind, fan_in, fan_out. Every edge gives both of its ends a row, so one exchange sums both degrees."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return edges.select("edge_type", F.explode(ends).alias("e")).groupBy(F.col("e.node_id").alias("node_id"), F.col("edge_type").alias("edge_kind")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def lifted_calls(calls: DataFrame, owner: DataFrame, src: str, dst: str) -> DataFrame:
    """Call edges between owners (id, owner), counted. Calls are first counted per caller owner and callee, before the second join."""
    a = owner.select(F.col("id").alias("src"), F.col("owner").alias(src))
    b = owner.select(F.col("id").alias("dst"), F.col("owner").alias(dst))
    half = calls.join(a, "src").groupBy(src, "dst").agg(F.count("*").alias("n"))
    return half.join(b, "dst").groupBy(src, dst).agg(F.sum("n").alias("call_count"))


def counterparts(imports: DataFrame, names: DataFrame, focus: DataFrame) -> DataFrame:
    """Modules that import or are imported by the focus modules (id), with counts per direction."""
    out = imports.join(focus.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = imports.join(focus.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    total = out.unionByName(into).groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.count("*").alias("edge_count"))
    return total.join(names.select(F.col("structural_id").alias("id"), "qualified_name"), "id").select("qualified_name", "incoming", "outgoing", "edge_count")


def low_node_files(nodes: DataFrame) -> DataFrame:
    """Per language and in total: files, files with at most one node, their ratio, and a warning for many of them."""
    files = nodes.groupBy("language", "file_path").agg(F.count("*").alias("n"))
    total = files.rollup("language").agg(F.count("*").alias("files"), F.count_if(F.col("n") <= 1).alias("low_files"))
    ratio = F.bround(F.col("low_files") / F.col("files"), 4)
    return total.select(F.coalesce("language", F.lit("total")).alias("language"), "files", "low_files", ratio.alias("ratio"), ((F.col("files") >= 200) & (ratio >= 0.6)).alias("warning"))
