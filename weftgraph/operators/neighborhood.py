"""The functional form of graph computations: aggregates, edge updates and messages around vertices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.draws import exponential
from weftgraph.graph import Dir, Graph, VertexSet


def map_reduce_neighborhood(graph: Graph, direction: Dir, aggregates: Mapping[str, Column], nbr: list[str] | None = None, center: list[str] | None = None, vset: VertexSet | None = None) -> DataFrame:
    """(id, aggregates) per vertex over its adjacent edges."""
    return graph.aggregate_neighbors(direction, aggregates, nbr, center, vset)


def transform_neighborhood(graph: Graph, direction: Dir, columns: Mapping[str, Column], vset: VertexSet | None = None) -> Graph:
    """Update the edges around the vertices of the set; expressions see s_ and t_ columns."""
    return graph.transform_edges(columns, vset, direction, with_ends=True)


def broadcast_neighborhood(graph: Graph, direction: Dir, message: Column, combine: Callable[[Column], Column], center: list[str] | None = None, vset: VertexSet | None = None, when: Column | None = None) -> DataFrame:
    """(id, msg): messages from the vertices of the set to their neighbours, combined at the receiver."""
    rows = graph._within(graph.adjacent(direction), vset, "center")
    if center:
        rows = rows.join(graph.vertices.select(F.col("id").alias("center"), *(F.col(c).alias("c_" + c) for c in center)), "center")
    rows = rows if when is None else rows.filter(when)
    return rows.select(F.col("nbr").alias("id"), message.alias("msg")).groupBy("id").agg(combine(F.col("msg")).alias("msg"))


def for_all_vertices(graph: Graph, columns: Mapping[str, Column], vset: VertexSet | None = None) -> Graph:
    return graph.transform_vertices(columns, vset)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, ``place`` from 1; a filter on row_number, which Spark turns into a bounded sort."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def reservoir_one(df: DataFrame, weight: Column, key: Column, seed: int = 0) -> DataFrame:
    """One row drawn in proportion to its weight: the least of -ln(u) / w, u drawn from the row's key (a unique long) and the seed."""
    return df.filter(weight > 0).agg(F.min_by(F.struct(*df.columns), F.struct(exponential(key, seed) / weight, key)).alias("row")).filter("row IS NOT NULL").select("row.*")


def vector_sum(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Elementwise sums of an array column per group, with map-side partial sums."""
    cells = df.select(*group, F.posexplode(vector).alias("__i", "__x")).groupBy(*group, "__i").agg(F.sum("__x").alias("__x"))
    ordered = F.sort_array(F.collect_list(F.struct("__i", "__x")))
    return cells.groupBy(*group).agg(F.transform(ordered, lambda s: s["__x"]).alias(vector))
