"""Differences between a committed snapshot and a changed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, diff_kind, field, old_value, new_value: a row per added or removed node, and per changed field of others."""
    a = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields], F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_new").isNull(), "remove").when(F.col("in_old").isNull(), "add").otherwise("modify")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])
    rows = both.withColumn("diff_kind", kind)
    modified = rows.filter("diff_kind = 'modify'").select(key, "diff_kind", F.explode(each).alias("c")).select(key, "diff_kind", "c.field", "c.old_value", "c.new_value").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    whole = rows.filter("diff_kind <> 'modify'").select(key, "diff_kind", F.lit("node").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    return modified.unionByName(whole)


def edge_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of one side only, with diff_kind."""
    return new.select(*keys).subtract(old.select(*keys)).withColumn("diff_kind", F.lit("add")).unionByName(old.select(*keys).subtract(new.select(*keys)).withColumn("diff_kind", F.lit("remove")))


def summary(changes: DataFrame, group: str) -> DataFrame:
    """Counts of add, modify and remove per group."""
    return changes.groupBy(group).agg(*[F.count_if(F.col("diff_kind") == k).alias(k) for k in ("add", "modify", "remove")])


def patched_counts(committed: DataFrame, deltas: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Committed counts with +1 / -1 deltas, not below zero, and where each row comes from."""
    d = deltas.groupBy(*keys).agg(F.sum(F.when(F.col("diff_kind") == "add", 1).otherwise(-1)).alias("delta"))
    both = committed.join(d, keys, "full_outer")
    total = F.greatest(F.lit(0), F.coalesce(count, F.lit(0)) + F.coalesce("delta", F.lit(0)))
    origin = F.when(F.col(count).isNull(), "overlay_added").when(F.coalesce("delta", F.lit(0)) == 0, "committed").when(total == 0, "overlay_removed").otherwise("overlay_changed")
    return both.select(*keys, total.alias(count), origin.alias("row_origin"))


def patched_rows(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both snapshots by key: the new value of a field where there is one, and where each row comes from."""
    a = old.select(key, *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("in_new"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))
    origin = F.when(F.col("in_old").isNull(), "overlay_added").when(F.col("in_new").isNull(), "overlay_removed").when(same, "committed").otherwise("overlay_changed")
    pick = [F.when(F.col("in_new").isNull(), F.col(f"o_{f}")).otherwise(F.col(f"n_{f}")).alias(f) for f in fields]
    return a.join(b, key, "full_outer").select(key, *pick, origin.alias("row_origin"))


def patched_lookup(committed: DataFrame, added: DataFrame, removed: DataFrame, key: str, score: float, limit: int) -> DataFrame:
    """Scored matches with added rows at a set score, removed ones marked stale; best first, at most `limit`."""
    gone = removed.select(key).distinct().withColumn("gone", F.lit(True))
    kept = committed.join(gone, key, "left")
    origin = F.when(F.col("gone"), "overlay_removed").otherwise("committed").alias("row_origin")
    status = F.when(F.col("gone"), "stale").otherwise("active").alias("match_status")
    fresh = added.join(committed.select(key), key, "left_anti").select(key, "qualified_name", F.lit(score).alias("score"), F.lit("overlay_added").alias("row_origin"), F.lit("active").alias("match_status"))
    return kept.select(key, "qualified_name", "score", origin, status).unionByName(fresh).orderBy(F.desc("score"), "qualified_name", key).limit(limit)


def fan_changes(edges: DataFrame) -> DataFrame:
    """node_id, edge_kind, d_in, d_out of edges (src, dst, edge_type, diff_kind), summed in one exchange."""
    sign = F.when(F.col("diff_kind") == "add", 1).otherwise(-1)
    none = F.lit(0)
    ends = F.array(F.struct(F.col("src").alias("node_id"), none.alias("i"), sign.alias("o")), F.struct(F.col("dst").alias("node_id"), sign.alias("i"), none.alias("o")))
    return edges.select("edge_type", F.explode(ends).alias("e")).groupBy(F.col("e.node_id").alias("node_id"), F.col("edge_type").alias("edge_kind")).agg(F.sum("e.i").alias("d_in"), F.sum("e.o").alias("d_out"))


def patched_fan(committed: DataFrame, deltas: DataFrame) -> DataFrame:
    """Fan totals (node_id, edge_kind, fan_in, fan_out) with deltas, not below zero, for all nodes and not a cut list."""
    both = committed.withColumn("known", F.lit(True)).join(deltas, ["node_id", "edge_kind"], "full_outer")

    def total(fan: str, d: str):
        return F.greatest(F.lit(0), F.coalesce(fan, F.lit(0)) + F.coalesce(d, F.lit(0)))

    moved = (F.coalesce("d_in", F.lit(0)) != 0) | (F.coalesce("d_out", F.lit(0)) != 0)
    origin = F.when(F.col("known").isNull(), "overlay_added").when(moved, "overlay_changed").otherwise("committed")
    return both.select("node_id", "edge_kind", total("fan_in", "d_in").alias("fan_in"), total("fan_out", "d_out").alias("fan_out"), origin.alias("row_origin"))


def caller_transitions(calls: DataFrame) -> DataFrame:
    """Callers whose calls (src, dst, diff_kind) changed: added, removed and their difference."""
    return calls.groupBy("src").agg(F.count_if(F.col("diff_kind") == "add").alias("added"), F.count_if(F.col("diff_kind") == "remove").alias("removed")).withColumn("delta", F.col("added") - F.col("removed"))


def patched_edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of either side, with where each comes from."""
    both = old.select(*keys, F.lit(True).alias("in_old")).join(new.select(*keys, F.lit(True).alias("in_new")), keys, "full_outer")
    origin = F.when(F.col("in_old").isNull(), "overlay_added").when(F.col("in_new").isNull(), "overlay_removed").otherwise("committed")
    return both.select(*keys, origin.alias("row_origin"))


def change_set(status: DataFrame) -> DataFrame:
    """path, kind of rows (status, old_path, new_path): a rename or copy is a removal and an addition."""
    s = F.substring("status", 1, 1)
    change = lambda path, kind: F.struct(F.col(path).alias("path"), F.lit(kind).alias("kind"))
    made = F.when(s.isin("R", "C"), F.array(change("old_path", "remove"), change("new_path", "add"))).when(s == "A", F.array(change("new_path", "add"))).when(s == "D", F.array(change("old_path", "remove"))).otherwise(F.array(change("old_path", "modify")))
    return status.select(F.explode(made).alias("c")).select("c.path", "c.kind").filter("path is not null")


def previews(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """key, total, shown, truncated, entries: the first items of each key by name; only those are listed."""
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(item))).filter(F.col("place") <= limit)
    entries = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias("entries"))
    return total.join(entries, key).select(key, "total", F.least("total", F.lit(limit)).alias("shown"), (F.col("total") > limit).alias("truncated"), "entries")
