"""Centralities over shortest-path trees from a set of roots; with all vertices as roots they are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.algorithms.analytics import hashed
from weftgraph.graph import Graph
from weftgraph.session import forget, written


def sample_roots(graph: Graph, size: int = 3_000, seed: int = 0) -> DataFrame:
    """About ``size`` vertices, each with probability size / |V| from a hash of its id; all if there are no more."""
    n = graph.num_vertices()
    ids = graph.vertices.select(F.col("id").alias("root"))
    return ids if n <= size else ids.filter(hashed(F.col("root"), seed) < size / n)


def _distances(graph: Graph, roots: DataFrame, weight: str | None, reverse: bool) -> DataFrame:
    """(root, id, dist): least distances from each root, relaxing only what improved in the round before."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    edges = written(graph.edges.select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    best = written(roots.select("root", F.col("root").alias("id"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "dist")
    while True:
        front = best.filter("new").join(edges, F.col("id") == F.col("a")).select("root", F.col("b").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(True).alias("new"))
        both = best.select("root", "id", "dist", F.lit(False).alias("new")).unionByName(front)
        step = written(both.groupBy("root", "id").agg(F.min(F.struct("dist", "new")).alias("m")).select("root", "id", "m.dist", "m.new"), "dist")
        forget(best)
        best = step
        if best.filter("new").isEmpty():
            return best.select("root", "id", "dist")


def dijkstra_forest(graph: Graph, roots: DataFrame, weight: str | None = None, reverse: bool = False) -> DataFrame:
    """(root, id, dist, parent): for each root the shortest-path tree; the smallest parent of several, NULL at the root."""
    dist = written(_distances(graph, roots, weight, reverse), "dist")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    edges = graph.edges.select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    tight = edges.join(dist.select("root", F.col("id").alias("a"), F.col("dist").alias("da")), "a").join(dist.select("root", F.col("id").alias("b"), F.col("dist").alias("db")), ["root", "b"])
    parents = tight.filter(F.abs(F.col("da") + F.col("w") - F.col("db")) < 1e-9).groupBy("root", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
    return dist.join(parents, ["root", "id"], "left")


def closeness(graph: Graph, roots: DataFrame, weight: str | None = None, reverse: bool = True) -> DataFrame:
    """(id, n_roots, mean_dist): the mean distance between each vertex and the roots that are linked to it (itself left out).

    ``reverse`` follows edges backwards from the roots, so distances are from the vertex to the root (closeness); forwards
    they are from the root to the vertex (prestige).
    """
    return _distances(graph, roots, weight, reverse).filter("root <> id").groupBy("id").agg(F.count("*").alias("n_roots"), F.avg("dist").alias("mean_dist"))


def prestige(graph: Graph, roots: DataFrame, weight: str | None = None) -> DataFrame:
    return closeness(graph, roots, weight, reverse=False)


def betweenness(graph: Graph, roots: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, betweenness): Brandes' sums of pair dependencies over the roots (ordered pairs; ends not counted).

    The shortest-path graph of each root is worked off by hops: path counts forwards, dependencies backwards.
    """
    dist = written(_distances(graph, roots, weight, False), "dist")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    edges = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    tight = edges.join(dist.select("root", F.col("id").alias("a"), F.col("dist").alias("da")), "a").join(dist.select("root", F.col("id").alias("b"), F.col("dist").alias("db")), ["root", "b"])
    dag = written(tight.filter(F.abs(F.col("da") + F.col("w") - F.col("db")) < 1e-9).select("root", "a", "b"), "dag")
    # Path counts by number of hops: sums over the layers give all paths even if layers of different length meet.
    layer = written(roots.select("root", F.col("root").alias("id"), F.lit(1.0).alias("s")), "layer")
    layers = [layer]
    while True:
        nxt = written(layer.join(dag, (layer["root"] == dag["root"]) & (layer["id"] == dag["a"])).select(dag["root"], F.col("b").alias("id"), "s").groupBy("root", "id").agg(F.sum("s").alias("s")), "layer")
        if nxt.isEmpty():
            break
        layers.append(nxt)
        layer = nxt
    sigma = layers[0]
    for x in layers[1:]:
        sigma = sigma.unionByName(x)
    sigma = written(sigma.groupBy("root", "id").agg(F.sum("s").alias("s")), "sigma")
    # delta(v) = sum over successors w of s(v) / s(w) * (1 + delta(w)); each round extends the chains by one hop.
    share = written(dag.join(sigma.select("root", F.col("id").alias("a"), F.col("s").alias("sa")), ["root", "a"]).join(sigma.select("root", F.col("id").alias("b"), F.col("s").alias("sb")), ["root", "b"]).select("root", "a", "b", (F.col("sa") / F.col("sb")).alias("f")), "share")
    part = written(share.groupBy("root", "a").agg(F.sum("f").alias("d")), "part")
    parts = [part]
    while True:
        nxt = written(share.join(part.select("root", F.col("a").alias("b"), "d"), ["root", "b"]).groupBy("root", "a").agg(F.sum(F.col("f") * F.col("d")).alias("d")), "part")
        if nxt.isEmpty():
            break
        parts.append(nxt)
        part = nxt
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    sums = total.filter("root <> a").groupBy(F.col("a").alias("id")).agg(F.sum("d").alias("b"))
    return graph.vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
