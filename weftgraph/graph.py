"""Property graphs as two DataFrames, vertex sets, and the verbs over them.

``vertices`` has a unique long ``id`` and any payload columns, ``edges`` long ``src`` and ``dst`` and any payload columns.
Everything here builds a plan; nothing is collected. Repeated edges are multi-edges unless removed on request.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Dir(IntEnum):
    """Which edges of a vertex: those that arrive, those that leave, or both (a reciprocal pair is then met twice)."""

    NONE = 0
    IN = 1
    OUT = 2
    ALL = 3


@dataclass(frozen=True)
class VertexSet:
    """A set of vertex ids; ``None`` for ``ids`` stands for all vertices and costs no join."""

    graph: Graph
    ids: DataFrame | None

    def _frame(self) -> DataFrame:
        return self.graph.vertices.select("id") if self.ids is None else self.ids

    def __and__(self, other: VertexSet) -> VertexSet:
        if self.ids is None or other.ids is None:
            return other if self.ids is None else self
        return VertexSet(self.graph, self.ids.join(other.ids, "id", "left_semi"))

    def __or__(self, other: VertexSet) -> VertexSet:
        if self.ids is None or other.ids is None:
            return VertexSet(self.graph, None)
        return VertexSet(self.graph, self.ids.union(other.ids).distinct())

    def __sub__(self, other: VertexSet) -> VertexSet:
        if other.ids is None:
            return self.graph.empty_set()
        return VertexSet(self.graph, self._frame().join(other.ids, "id", "left_anti"))

    def __invert__(self) -> VertexSet:
        return VertexSet(self.graph, None) - self

    def frame(self) -> DataFrame:
        return self._frame()

    def size(self) -> int:
        return self._frame().count()

    def is_empty(self) -> bool:
        return self._frame().isEmpty()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # -- building ------------------------------------------------------------------------------------------------------
    @staticmethod
    def build(edges: DataFrame, vertices: DataFrame | None = None, dedup: bool = False, combine: Mapping[str, Callable[[Column], Column]] | None = None) -> Graph:
        """Edges without loops and with valid ends; vertices from ``vertices`` and from the ends of edges.

        Ids are non-negative longs (the id -1 is reserved); rows with other or NULL ids are dropped. A vertex given
        several times is combined column by column with ``combine`` (default: the greatest value, so that the winner
        doesn't depend on the order of rows). An end that isn't in ``vertices`` gets NULL payloads.
        """
        ends = edges.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}).filter("src >= 0 AND dst >= 0 AND src <> dst")
        ends = ends.distinct() if dedup else ends
        ids = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if vertices is None:
            return Graph(ids, ends)
        given = vertices.withColumn("id", F.col("id").cast("long")).filter("id >= 0")
        payload = [c for c in given.columns if c != "id"]
        how = dict(combine or {})
        given = given.groupBy("id").agg(*(how.get(c, F.max)(F.col(c)).alias(c) for c in payload)) if payload else given.select("id").distinct()
        return Graph(ids.join(given, "id", "full"), ends)

    def union_edges(self, more: DataFrame) -> Graph:
        """The graph with further edges; new ends become vertices with NULL payloads."""
        added = Graph.build(more)
        fresh = added.vertices.join(self.vertices.select("id"), "id", "left_anti")
        return Graph(self.vertices.unionByName(fresh, allowMissingColumns=True), self.edges.unionByName(added.edges, allowMissingColumns=True))

    # -- sizes ---------------------------------------------------------------------------------------------------------
    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of every vertex, counting multi-edges, in one aggregation."""
        ends = self.edges.select(F.inline(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
        seen = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return self.vertices.select("id").join(seen, "id", "left").na.fill(0, ["in_degree", "out_degree"])

    # -- sets ----------------------------------------------------------------------------------------------------------
    def complete_set(self) -> VertexSet:
        return VertexSet(self, None)

    def empty_set(self) -> VertexSet:
        return VertexSet(self, self.vertices.select("id").filter(F.lit(False)))

    def select(self, predicate: Column, vset: VertexSet | None = None) -> VertexSet:
        return VertexSet(self, self._within(self.vertices, vset).filter(predicate).select("id"))

    def neighbors(self, vset: VertexSet, direction: Dir = Dir.ALL) -> VertexSet:
        """The vertices one step from the set; IN follows edges against their direction."""
        near = self.adjacent(direction).select("center", "nbr")
        if vset.ids is not None:
            near = near.join(vset.ids.withColumnRenamed("id", "center"), "center", "left_semi")
        return VertexSet(self, near.select(F.col("nbr").alias("id")).distinct())

    def _within(self, df: DataFrame, vset: VertexSet | None, key: str = "id") -> DataFrame:
        return df if vset is None or vset.ids is None else df.join(vset.ids.withColumnRenamed("id", key), key, "left_semi")

    # -- edges with their ends -----------------------------------------------------------------------------------------
    def adjacent(self, direction: Dir) -> DataFrame:
        """Edges seen from a center: ``center``, ``nbr``, src, dst and the payload. ALL shows each edge from both ends."""
        if direction == Dir.NONE:
            return self.adjacent(Dir.IN).filter(F.lit(False))
        if direction == Dir.IN:
            return self.edges.select("*", F.col("dst").alias("center"), F.col("src").alias("nbr"))
        if direction == Dir.OUT:
            return self.edges.select("*", F.col("src").alias("center"), F.col("dst").alias("nbr"))
        # One scan of the edges instead of a union of two.
        views = F.array(F.struct(F.col("dst").alias("center"), F.col("src").alias("nbr")), F.struct(F.col("src").alias("center"), F.col("dst").alias("nbr")))
        return self.edges.select("*", F.inline(views))

    def triplets(self, source: list[str] | None = None, target: list[str] | None = None) -> DataFrame:
        """Each edge with its ends' payloads as ``s_<column>`` and ``t_<column>``; only the columns asked for are joined."""
        out = self.edges
        for side, prefix, wanted in (("src", "s_", source), ("dst", "t_", target)):
            names = [c for c in self.vertices.columns if c != "id"] if wanted is None else wanted
            if names:
                out = out.join(self.vertices.select(F.col("id").alias(side), *(F.col(c).alias(prefix + c) for c in names)), side)
        return out

    # -- maps ----------------------------------------------------------------------------------------------------------
    def transform_vertices(self, columns: Mapping[str, Column], vset: VertexSet | None = None) -> Graph:
        """New values for vertex columns, within the set; elsewhere the old value (NULL for a new column) stays."""
        if vset is None or vset.ids is None:
            return replace(self, vertices=self.vertices.withColumns(dict(columns)))
        marked = self.vertices.join(vset.ids.withColumn("__in", F.lit(True)), "id", "left")
        old = lambda c: F.col(c) if c in self.vertices.columns else F.lit(None)
        return replace(self, vertices=marked.withColumns({c: F.when(F.col("__in"), x).otherwise(old(c)) for c, x in columns.items()}).drop("__in"))

    def transform_edges(self, columns: Mapping[str, Column], vset: VertexSet | None = None, direction: Dir = Dir.IN, with_ends: bool = False) -> Graph:
        """New values for edge columns of the edges adjacent to the set (IN: that arrive there). ``with_ends`` offers s_ and t_ columns."""
        base = self.triplets() if with_ends else self.edges
        touched = F.lit(direction != Dir.NONE)
        if vset is not None and vset.ids is not None:
            flags = []
            for side, here in (("dst", direction in (Dir.IN, Dir.ALL)), ("src", direction in (Dir.OUT, Dir.ALL))):
                if here:
                    base = base.join(vset.ids.select(F.col("id").alias(side), F.lit(True).alias(f"__{side}")), side, "left")
                    flags.append(F.coalesce(F.col(f"__{side}"), F.lit(False)))
            touched = F.lit(False)
            for f in flags:
                touched = touched | f
        old = lambda c: F.col(c) if c in self.edges.columns else F.lit(None)
        kept = list(dict.fromkeys([*self.edges.columns, *columns]))
        return replace(self, edges=base.withColumns({c: F.when(touched, x).otherwise(old(c)) for c, x in columns.items()}).select(*kept))

    # -- aggregates ----------------------------------------------------------------------------------------------------
    def map_reduce_vertices(self, aggregates: Mapping[str, Column], vset: VertexSet | None = None, default: object = 0) -> DataFrame:
        """One row of aggregates over the vertices; an empty set gives ``default``."""
        return self._within(self.vertices, vset).agg(*(F.coalesce(x, F.lit(default)).alias(c) for c, x in aggregates.items()))

    def map_reduce_edges(self, aggregates: Mapping[str, Column], vset: VertexSet | None = None, direction: Dir = Dir.IN, default: object = 0) -> DataFrame:
        """One row of aggregates over the edges adjacent to the set; with ALL each edge counts from both ends."""
        return self._within(self.adjacent(direction), vset, "center").agg(*(F.coalesce(x, F.lit(default)).alias(c) for c, x in aggregates.items()))

    def fold_vertices(self, partial: Callable, schema: str, final: Mapping[str, Column], vset: VertexSet | None = None) -> DataFrame:
        """A fold that no expression can state: ``partial`` turns batches into partial rows (mapInPandas), ``final`` joins them."""
        return self._within(self.vertices, vset).mapInPandas(partial, schema).agg(*(x.alias(c) for c, x in final.items()))

    def fold_edges(self, partial: Callable, schema: str, final: Mapping[str, Column], vset: VertexSet | None = None, direction: Dir = Dir.IN) -> DataFrame:
        return self._within(self.adjacent(direction), vset, "center").mapInPandas(partial, schema).agg(*(x.alias(c) for c, x in final.items()))

    def aggregate_neighbors(self, direction: Dir, aggregates: Mapping[str, Column], nbr: list[str] | None = None, center: list[str] | None = None, vset: VertexSet | None = None) -> DataFrame:
        """(id, aggregates) for the vertices with adjacent edges. Expressions see edge columns, ``n_<c>`` and ``c_<c>``."""
        rows = self._within(self.adjacent(direction), vset, "center")
        for side, prefix, wanted in (("nbr", "n_", nbr), ("center", "c_", center)):
            if wanted:
                rows = rows.join(self.vertices.select(F.col("id").alias(side), *(F.col(c).alias(prefix + c) for c in wanted)), side)
        return rows.groupBy(F.col("center").alias("id")).agg(*(x.alias(c) for c, x in aggregates.items()))

    def gather_apply(self, direction: Dir, gather: Mapping[str, Column], apply: Mapping[str, Column], nbr: list[str] | None = None, center: list[str] | None = None, vset: VertexSet | None = None, default: float = 0) -> Graph:
        """One gather and apply without messages. A vertex of the set without adjacent edges gets ``default`` totals."""
        total = self.aggregate_neighbors(direction, gather, nbr, center, vset)
        joined = self.vertices.join(total, "id", "left").na.fill(default, list(gather))
        if vset is not None and vset.ids is not None:
            joined = joined.join(vset.ids.withColumn("__in", F.lit(True)), "id", "left")
        else:
            joined = joined.withColumn("__in", F.lit(True))
        old = lambda c: F.col(c) if c in self.vertices.columns else F.lit(None)
        out = joined.withColumns({c: F.when(F.col("__in"), x).otherwise(old(c)) for c, x in apply.items()})
        return replace(self, vertices=out.select(*dict.fromkeys([*self.vertices.columns, *apply])))

    # -- joining two graphs --------------------------------------------------------------------------------------------
    def left_injective_join(self, other: Graph, left_key: Column, right_key: Column, update: Mapping[str, Column]) -> Graph:
        """Update vertices by the other graph's vertices (columns ``r_<c>``) of the same key.

        A key of -1 or NULL takes no part; unmatched vertices stay as they are. Keys must be unique on either side: a
        repeated key makes the query fail.
        """
        def keyed(df: DataFrame, key: Column, prefix: str) -> DataFrame:
            named = df.select(key.alias("__key"), *(F.col(c).alias(prefix + c) for c in df.columns)).withColumn("__key", F.expr("nullif(__key, -1)"))
            counted = named.groupBy("__key").agg(F.count("*").alias("__n")).filter("__key IS NOT NULL AND __n > 1")
            return named, counted

        mine, mine_twice = keyed(self.vertices, left_key, "")
        theirs, theirs_twice = keyed(other.vertices, right_key, "r_")
        twice = mine_twice.unionByName(theirs_twice).agg(F.count("*").alias("__twice"))
        checked = theirs.filter("__key IS NOT NULL").withColumn("__hit", F.lit(True))
        joined = mine.join(checked, "__key", "left").join(F.broadcast(twice))  # one row
        valid = F.when(F.col("__twice") > 0, F.raise_error(F.lit("a join key is repeated"))).otherwise(F.col("id")).cast("long")
        out = joined.withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c) if c in self.vertices.columns else F.lit(None)) for c, x in update.items()})
        return replace(self, vertices=out.withColumn("id", valid).select(*dict.fromkeys([*self.vertices.columns, *update])))

    def right_injective_join(self, other: Graph, left_key: Column, right_key: Column, update: Mapping[str, Column]) -> Graph:
        """The mirror image: the other graph is updated by this one."""
        return other.left_injective_join(self, right_key, left_key, update)

    # -- structure -----------------------------------------------------------------------------------------------------
    def undirected(self) -> DataFrame:
        """(src, dst), src < dst: each pair of neighbours once."""
        return self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def neighbor_lists(self) -> DataFrame:
        """(id, n_neighbors, neighbors): distinct neighbours in either direction, sorted."""
        near = self.adjacent(Dir.ALL).select("center", "nbr").distinct()
        return near.groupBy(F.col("center").alias("id")).agg(F.count("*").alias("n_neighbors"), F.sort_array(F.collect_list("nbr")).alias("neighbors"))
