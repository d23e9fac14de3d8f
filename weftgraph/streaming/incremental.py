"""Graphs that grow: edges arrive as a stream, results are kept up to date by micro-batch.

Extensions of the engine: an event-time aggregation with a watermark stands beside the incremental graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.graph import Graph


def merge_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, component) after further edges: new edges are reduced to links between known components first, so a batch costs
    in proportion to the batch and the components it touches."""
    from weftgraph.algorithms.analytics import connected_components

    if labels is None:
        return connected_components(Graph.build(edges)).vertices.select("id", "component")
    ends = edges.select("src", "dst").filter("src <> dst")
    for c in ("src", "dst"):
        ends = ends.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")), c, "left")
    known = ends.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"))
    fresh = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(labels.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    merged = connected_components(Graph.build(known)).vertices.select(F.col("id").alias("component"), F.col("component").alias("low"))
    return labels.unionByName(fresh).join(merged, "component", "left").select("id", F.coalesce("low", "component").alias("component"))


def follow_edges(stream: DataFrame, path: str, update: Callable[[DataFrame | None, DataFrame], DataFrame] = merge_components, checkpoint: str | None = None, **trigger: object) -> StreamingQuery:
    """Keep ``update(previous result, new edges)`` under ``path``/v<batch>; a batch that is run again replaces its result."""

    def batch(edges: DataFrame, number: int) -> None:
        spark = edges.sparkSession
        before = spark.read.parquet(f"{path}/v{number - 1}") if number > 0 else None
        update(before, edges).write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` per event type and tumbling window, with a watermark; for streams and tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("sum_value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value")


def read_event_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
