"""Scans of edges by kinds and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_of(edges: DataFrame, kinds: list[str] | None = None, but: list[str] | None = None, src: DataFrame | None = None, dst: DataFrame | None = None) -> DataFrame:
    """Edges of the kinds, without others, from and to the ids (id) given; an empty list or none filters nothing."""
    if kinds:
        edges = edges.filter(F.col("edge_type").isin(kinds))
    if but:
        edges = edges.filter(~F.col("edge_type").isin(but))
    for ids, end in ((src, "src"), (dst, "dst")):
        if ids is not None:
            edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges
