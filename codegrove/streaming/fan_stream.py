"""Fan statistics kept up to date from a stream of edge changes (src, dst, edge_type, diff_kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fan_deltas(changes: DataFrame) -> DataFrame:
    """node_id, edge_kind, fan_in, fan_out running totals; each change counts +1 or -1 at both of its ends."""
    sign = F.when(F.col("diff_kind") == "remove", -1).otherwise(1)
    ends = F.array(
        F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), sign.alias("o")),
        F.struct(F.col("dst").alias("node_id"), sign.alias("i"), F.lit(0).alias("o")),
    )
    rows = changes.select("edge_type", F.explode(ends).alias("e"))
    return rows.groupBy(F.col("e.node_id").alias("node_id"), F.col("edge_type").alias("edge_kind")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def maintain(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over a streaming DataFrame: each trigger writes the totals it changed to a folder of its own under path.

    A trigger that is run again replaces its folder, so nothing is counted twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fan_deltas(changes).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """node_id, edge_kind, fan_in, fan_out as the latest trigger that changed a node left them."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("node_id", "edge_kind").agg(F.max_by(F.struct("fan_in", "fan_out"), "batch").alias("t"))
    return last.select("node_id", "edge_kind", "t.fan_in", "t.fan_out")
