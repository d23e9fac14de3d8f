"""Clustering: k-means++ with Lloyd's rounds, with pairwise rewards, and spectral clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftgraph.algorithms.analytics import hashed, laplacian, normalized_rows
from weftgraph.algorithms.linalg import SMALL_ENTRIES, svd
from weftgraph.functions.batches import arrays, grouped_vector_sum, matrix, read_batches
from weftgraph.functions.eigen import Adjacency, leading
from weftgraph.graph import Graph
from weftgraph.operators.neighborhood import top_k
from weftgraph.session import BROADCAST_ROWS, written

#: k-means without a limit of its own gives up after so many rounds.
MOST_ROUNDS = 10_000
#: Centres are sent to every task: at most this many numbers.
MOST_NUMBERS = 4_000_000
#: A graph of at most so many edges (half as many if their weights differ) and vertices is decomposed in one task, whose basis
#: holds so many numbers.
TASK_EDGES, TASK_VERTICES, TASK_NUMBERS = 12_000_000, 1_500_000, 65_000_000


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, point, cluster, dist): squared distance to the nearest centre, the first of several."""
    if centres.size > MOST_NUMBERS:
        raise ValueError("too many centres to send to every task")
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("point"))
                d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)
                k = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("point"), pa.array(k, pa.int64()), pa.array(d[np.arange(len(k)), k])], ["id", "point", "cluster", "dist"])

    return points.select("id", "point").mapInArrow(assign, "id long, point array<double>, cluster long, dist double")


def init_centres(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: the first centre at random, each other in proportion to the squared distance from those before."""
    chosen: list[list[float]] = []
    for step in range(k):
        u = hashed(F.col("id"), seed, step)
        if step == 0:
            row = points.agg(F.min_by("point", F.struct(u, "id"))).first()[0]
        else:
            near = _nearest(points, np.array(chosen)).filter("dist > 0")
            row = near.agg(F.min_by("point", F.struct(-F.log(u) / F.col("dist"), F.col("id")))).first()[0]
        if row is None:
            break
        chosen.append(row)
    return np.array(chosen, float)


def _marks(ids: pa.Array) -> np.ndarray:
    """Three hashes of 20 bits of each id, whose sums are exact in doubles: they tell whether a cluster has the same points."""
    with np.errstate(over="ignore"):
        x = ids.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.stack([(x >> np.uint64(shift)) & np.uint64(0xFFFFF) for shift in (4, 24, 44)], axis=1).astype(float)


def kmeans(points: DataFrame, k: int | None = None, iterations: int | None = None, centres: np.ndarray | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, dist), centres). points: (id, point); NULL points are left out, mixed lengths are an error.

    Ends when no assignment changes, or earlier after ``iterations`` rounds if that is given; without, it is an error if
    MOST_ROUNDS don't do. A cluster that loses all its points is dropped.
    """
    points = written(points.filter("point IS NOT NULL").select("id", F.col("point").cast("array<double>").alias("point")), "points")
    sizes = points.agg(F.min(F.size("point")), F.max(F.size("point")), F.count("*")).first()
    if sizes[2] == 0:
        return points.select("id", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("dist")), np.zeros((0, 0))
    if sizes[0] != sizes[1]:
        raise ValueError("points differ in dimension")
    if centres is None:
        if k > sizes[2]:
            raise ValueError("more clusters than points")
        centres = init_centres(points, k, seed)
    seen: set[bytes] = set()
    for _ in range(MOST_ROUNDS if iterations is None else iterations):
        near = _nearest(points, centres)

        def features(b: pa.RecordBatch) -> np.ndarray:
            return np.concatenate((matrix(b.column("point")), np.ones((b.num_rows, 1)), _marks(b.column("id"))), axis=1)

        rows = grouped_vector_sum(near, "cluster", features).orderBy("cluster").collect()  # one row per cluster
        totals = np.array([r["total"] for r in rows])
        kept = len(rows) == len(centres)
        centres = totals[:, :-4] / totals[:, -4:-3]
        # An assignment met before is the last one, or one of several of the same cost between which rounding decides.
        assigned = totals[:, -4:].tobytes()
        if kept and assigned in seen:
            break
        seen.add(assigned)
    else:
        if iterations is None:
            raise RuntimeError(f"assignments still change after {MOST_ROUNDS} rounds")
    return _nearest(points, centres).select("id", "cluster", "dist"), centres


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, n, centre) after one round, in plain expressions; centres: (cluster, c), few rows."""
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
    near = points.crossJoin(F.broadcast(listed)).select("point", F.array_min(F.transform("cs", lambda s: F.struct(squared_distance(F.col("point"), s["c"]).alias("d"), s["cluster"].alias("cluster")))).alias("best"))
    cells = near.select(F.col("best.cluster").alias("cluster"), F.posexplode("point").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return cells.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def kmeans_with_rewards(points: DataFrame, rewards: DataFrame, k: int, iterations: int = 5, seed: int = 0) -> DataFrame:
    """(id, cluster): distance to the centre less the reward weights of neighbours in that cluster. rewards: (i, j, w).

    A point's candidates are its nearest centre and the clusters of its neighbours; no other can be better than those
    unless it is nearer, so none is missed.
    """
    points = written(points.filter("point IS NOT NULL").select("id", F.col("point").cast("array<double>").alias("point")), "points")
    both = rewards.select("w", F.inline(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))))
    centres = init_centres(points, k, seed)
    state = written(_nearest(points, centres).select("id", "cluster"), "state")
    spark = points.sparkSession
    for _ in range(iterations):
        rows = grouped_vector_sum(points.join(state, "id"), "cluster", lambda b: np.concatenate((matrix(b.column("point")), np.ones((b.num_rows, 1))), axis=1)).collect()
        frame = F.broadcast(spark.createDataFrame([(int(r["cluster"]), [float(x) / r["total"][-1] for x in r["total"][:-1]]) for r in rows], "cluster long, c array<double>"))
        gain = both.join(state, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id"), "cluster").agg(F.sum("w").alias("gain"))
        plain = _nearest(points, np.array([[x / r["total"][-1] for x in r["total"][:-1]] for r in rows]))
        names = spark.createDataFrame([(n, int(r["cluster"])) for n, r in enumerate(rows)], "cluster long, name long")
        nearest = plain.join(F.broadcast(names), "cluster").select("id", F.col("name").alias("cluster"), F.lit(0.0).alias("gain"))
        options = nearest.unionByName(gain).groupBy("id", "cluster").agg(F.sum("gain").alias("gain")).join(points, "id").join(frame, "cluster")
        scored = options.withColumn("cost", squared_distance("point", "c") - F.col("gain"))
        state = written(scored.groupBy("id").agg(F.min_by("cluster", F.struct("cost", "cluster")).alias("cluster")), "state")
    return state


def similarity_graph(points: DataFrame, sigma: float, t: int | None = None, threshold: float | None = None) -> DataFrame:
    """(i, j, w), i < j: Gaussian similarities exp(-d^2 / (2 sigma^2)) of all pairs, or of those at least ``threshold``, or
    among the t largest of either end (ties with the t-th stay).

    All pairs must be looked at, so this is for at most some hundred thousand points: blocks of points meet, each pair of
    blocks in one task, and only what passes leaves it; with ``t``, of a block the t largest of each point. For more points,
    take the pairs of a nearest-neighbour search.
    """
    points = written(points.filter("point IS NOT NULL").select("id", F.col("point").cast("array<double>").alias("point")), "points")
    n, block = points.count(), 2_000
    blocks = max(1, -(-n // block))
    placed = points.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    cells = placed.select("id", "point", "p", F.explode(F.transform(every, lambda q: F.struct(F.least("p", q).alias("x"), F.greatest("p", q).alias("y")))).alias("cell")).select("id", "point", "p", "cell.x", "cell.y").distinct()

    def pairs(table: pa.Table) -> pa.Table:
        ids, p, v = table["id"].to_numpy(), table["p"].to_numpy(), matrix(table["point"])
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        a, b = np.flatnonzero(p == x), np.flatnonzero(p == y)
        d = np.maximum((v[a] ** 2).sum(1)[:, None] - 2 * v[a] @ v[b].T + (v[b] ** 2).sum(1)[None, :], 0)
        w = np.exp(-d / (2 * sigma * sigma))
        ok = (ids[a][:, None] < ids[b][None, :]) if x == y else np.ones_like(w, bool)
        if threshold is not None:
            ok &= w >= threshold
        if t is not None:
            # The t largest of a point are among the t largest of each block; on the diagonal a point isn't its own neighbour.
            v_ = np.where(ids[a][:, None] == ids[b][None, :], -1.0, w)
            rows_ = np.partition(v_, -t, axis=1)[:, -t][:, None] if v_.shape[1] > t else -1.0
            cols_ = np.partition(v_, -t, axis=0)[-t][None, :] if v_.shape[0] > t else -1.0
            ok &= (v_ >= rows_) | (v_ >= cols_)
        r, c = np.nonzero(ok)
        left, right = ids[a][r], ids[b][c]
        return pa.table({"i": np.minimum(left, right), "j": np.maximum(left, right), "w": w[r, c]})

    found = cells.groupBy("x", "y").applyInArrow(pairs, "i long, j long, w double")
    if t is None:
        return found
    found = written(found, "similarities")
    both = found.select("w", F.inline(F.array(F.struct(F.col("i").alias("a")), F.struct(F.col("j").alias("a")))))
    limit = top_k(both, ["a"], [F.desc("w")], t).groupBy("a").agg(F.min("w").alias("least"))
    near = found.join(limit.toDF("i", "li"), "i").join(limit.toDF("j", "lj"), "j")
    return near.filter((F.col("w") >= F.col("li")) | (F.col("w") >= F.col("lj"))).select("i", "j", "w")


def _embedded(edges: DataFrame, n_edges: int, weighted: bool, k: int, seed: int) -> DataFrame:
    """(id, point): spectral_embedding of written edges (src, dst, w), in one task that reads them."""
    spark, path, numbers = edges.sparkSession, edges._weft_path, TASK_NUMBERS

    def ends() -> tuple[np.ndarray, Adjacency]:
        src, dst, w, at = np.empty(n_edges, np.int64), np.empty(n_edges, np.int64), np.empty(n_edges if weighted else 0), 0
        for b in read_batches(path, 1 << 17):
            src[at : at + b.num_rows], dst[at : at + b.num_rows] = b.column("src").to_numpy(), b.column("dst").to_numpy()
            if weighted:
                w[at : at + b.num_rows] = b.column("w").to_numpy()
            at += b.num_rows
        ids = np.union1d(np.unique(src), np.unique(dst))
        src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        return ids, Adjacency(len(ids), src, dst, w if weighted else None)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        ids, product = ends()
        vectors = leading(product, len(ids), k, min(120, numbers // len(ids)), seed)[1]
        points = vectors[:, product.place].T
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        points = points / np.where(norms > 0, norms, 1.0)
        for a in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + (1 << 16)]), arrays(points[a : a + (1 << 16)])], ["id", "point"])

    found = spark.range(0, 1, 1, 1).mapInArrow(solve, "id long, point array<double>")
    return found.repartition(spark.sparkContext.defaultParallelism, "id")


def spectral_embedding(edges: DataFrame, k: int, weight: str = "w", seed: int = 0) -> DataFrame:
    """(id, point): the leading k singular vectors of D^-1/2 A D^-1/2 + I, as rows of length 1. edges: (i, j, weight).

    The matrix is symmetric without negative values, so these are its eigenvectors. Between what the driver decomposes and
    what needs joins, one task does it; there a value of multiplicity up to k is found as often.
    """
    graph = Graph.build(edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col(weight).cast("double").alias("w")))
    seen = Observation()
    counts = [F.count("*").alias("n"), F.count("w").alias("n_w"), F.min("w").alias("least"), F.max("w").alias("most"), *(F.approx_count_distinct(c).alias(c) for c in ("src", "dst"))]
    graph = Graph(graph.vertices, written(graph.edges.select("src", "dst", "w").observe(seen, *counts), "edges"))
    s = seen.get
    # The distinct ends are estimates, and together a bound of the vertices.
    n, vertices, weighted = s["n"], s["src"] + s["dst"], s["least"] != s["most"]
    small = 2 * n <= SMALL_ENTRIES and vertices <= BROADCAST_ROWS
    if small or n * (1 + weighted) > TASK_EDGES or vertices > 2 * TASK_VERTICES or s["n_w"] < n or s["least"] <= 0 or not math.isfinite(s["most"]):
        _, u, _, _ = svd(laplacian(graph, "w", diagonal=1.0), k, seed=seed)
        return normalized_rows(u).toDF("id", "point")
    return _embedded(graph.edges, n, weighted, k, seed)


def spectral_clustering(points: DataFrame, k: int, sigma: float, t: int | None = 10, threshold: float | None = None, seed: int = 0) -> DataFrame:
    """(id, cluster) by kernel, normalised matrix, singular vectors and k-means."""
    return kmeans(spectral_embedding(similarity_graph(points, sigma, t, threshold), k, seed=seed), k, seed=seed)[0].select("id", "cluster")


def partition_graph(graph: Graph, k: int, weight: str | None = None, seed: int = 0) -> DataFrame:
    """(id, cluster): spectral partitioning of a graph; vertices without edges come out with NULL."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    edges = graph.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), w.alias("w"))
    found = kmeans(spectral_embedding(edges, k, seed=seed), k, seed=seed)[0].select("id", "cluster")
    return graph.vertices.select("id").join(found, "id", "left")


def gaussian_blobs(spark: SparkSession, n: int = 10_000, k: int = 2, d: int = 2, spread: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, point, label): points around k random centres in [-10, 10]^d."""
    label = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k))
    dims = F.sequence(F.lit(0), F.lit(d - 1))
    normal = lambda q: F.sqrt(-2 * F.log(hashed(F.col("id"), seed, q, 1))) * F.cos(2 * math.pi * hashed(F.col("id"), seed, q, 2))
    centre = lambda q: hashed(F.col("label"), seed, q, 3) * 20 - 10
    return spark.range(n).withColumn("label", label).select("id", F.transform(dims, lambda q: centre(q) + spread * normal(q)).alias("point"), "label")
