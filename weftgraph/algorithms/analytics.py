"""Graph analytics: ranking, paths, components, cores, triangles, colouring, diameter, Laplacian, centrality of subgraphs."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.draws import draw
from weftgraph.gas import RunResult, VertexProgram, run, signals
from weftgraph.graph import Dir, Graph
from weftgraph.operators.heavy import heavy_keys, split_join
from weftgraph.session import BROADCAST_ROWS, forget, small_or_plain, written, written_counted


#: A reproducible uniform number in (0, 1) from a key and seeds.
hashed = draw


# -- ranking -----------------------------------------------------------------------------------------------------------
def pagerank(graph: Graph, iterations: int | None = None, tol: float = 1e-2, max_iterations: int = 100, start: float = 1.0) -> Graph:
    """Unnormalised ranks in column ``rank``: 0.15 + 0.85 * sum of rank / out-degree over in-neighbours.

    ``iterations``: as many full sweeps. Otherwise dynamic: a vertex runs again when an in-neighbour changed by more
    than ``tol``. The mass of vertices without out-edges is not handed on.
    """
    degree = graph.degrees().select("id", "out_degree")
    if iterations is not None:
        # The weight of an edge is fixed: it is joined once, and each sweep is one join and one aggregation.
        weighted = written(graph.edges.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (1.0 / F.col("out_degree")).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "weighted")
        ids = graph.vertices.select("id")
        ranks = ids.withColumn("rank", F.lit(start))
        for k in range(iterations):
            sums = weighted.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("acc"))
            ranks = ids.join(sums, F.col("id") == F.col("dst"), "left").select("id", (0.15 + 0.85 * F.coalesce("acc", F.lit(0.0))).alias("rank"))
            if k % 5 == 4:
                ranks = written(ranks, "ranks")
        return Graph(graph.vertices.drop("rank").join(ranks, "id"), graph.edges)
    state = Graph(graph.vertices.select("id").join(degree, "id").withColumn("rank", F.lit(start)), graph.edges)
    program = VertexProgram(
        gather={"r": F.sum(F.col("n_rank") / F.col("n_out_degree"))},
        apply={"rank": 0.15 + 0.85 * F.col("acc_r")},
        scatter_if=F.abs(F.col("c_rank") - F.col("c_old_rank")) > tol,
        message=F.lit(1.0),
    )
    done = run(state, program, max_iterations=max_iterations).graph
    return Graph(graph.vertices.drop("rank").join(done.vertices.select("id", "rank"), "id"), graph.edges)


def extension_pagerank(graph: Graph, tol: float = 1e-2, max_iterations: int = 100) -> Graph:
    """The variant that starts at 0.15 and hands on only changes of more than ``tol`` per out-edge."""
    degree = graph.degrees().select("id", "out_degree")
    state = Graph(graph.vertices.select("id").join(degree, "id").withColumn("rank", F.lit(0.15)), graph.edges)
    program = VertexProgram(
        gather={"r": F.sum(F.col("n_rank") / F.col("n_out_degree"))},
        apply={"rank": 0.15 + 0.85 * F.col("acc_r")},
        scatter_if=F.abs(F.col("c_rank") - F.col("c_old_rank")) / F.col("c_out_degree") > tol,
        message=F.lit(1.0),
    )
    done = run(state, program, max_iterations=max_iterations).graph
    return Graph(graph.vertices.drop("rank").join(done.vertices.select("id", "rank"), "id"), graph.edges)


# -- paths -------------------------------------------------------------------------------------------------------------
def sssp(graph: Graph, sources: Iterable[int] = (0,), directed: bool = False, weight: str | None = None, max_iterations: int | None = None) -> Graph:
    """Shortest distances from the nearest source in column ``dist``; NULL where none reaches. Weights must be positive."""
    step = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    start = graph.vertices.sparkSession.createDataFrame([(int(s),) for s in sources], "id long")
    state = Graph(graph.vertices.select("id").withColumn("dist", F.lit(None).cast("double")), graph.edges)
    program = VertexProgram(
        gather_dir=Dir.NONE,
        apply={"dist": F.least("dist", "msg")},
        scatter_dir=Dir.OUT if directed else Dir.ALL,
        # A vertex hands on only what became shorter, and only to where it helps.
        scatter_if=(F.col("c_old_dist").isNull() | (F.col("c_dist") < F.col("c_old_dist"))) & (F.col("n_dist").isNull() | (F.col("c_dist") + step < F.col("n_dist"))),
        message=F.col("c_dist") + step,
        combine=F.min,
    )
    first = start.join(graph.vertices.select("id"), "id", "left_semi").withColumn("msg", F.lit(0.0))
    done = run(state, program, messages=first, max_iterations=max_iterations).graph
    return Graph(graph.vertices.drop("dist").join(done.vertices, "id"), graph.edges)


def max_degree_vertex(graph: Graph) -> int | None:
    """The vertex of most edges; the smallest id of several."""
    row = graph.degrees().agg(F.max_by("id", F.struct(F.col("in_degree") + F.col("out_degree"), -F.col("id"))).alias("id")).first()
    return row["id"]


# -- components --------------------------------------------------------------------------------------------------------
def connected_components(graph: Graph, max_rounds: int = 200) -> Graph:
    """The smallest vertex id of each weak component in column ``component``.

    Minimum propagation with pointer jumping: after taking the least label around, a vertex also takes its label's
    label, so that long paths need about log n rounds.
    """
    edges = written(graph.undirected(), "edges")
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    labels, n = written_counted(graph.vertices.select("id", F.col("id").alias("l")), "labels")
    # Hubs are hot keys of the join with the edges, labels of large components of the join of labels with labels.
    hubs = heavy_keys(both, F.col("b")) if n > BROADCAST_ROWS else []
    for _ in range(max_rounds):
        around = split_join(both, labels.toDF("b", "l"), "b", n, hubs).groupBy("a").agg(F.min("l").alias("m"))
        low = written(labels.join(around, F.col("id") == F.col("a"), "left").select("id", F.least("l", "m").alias("n"), "l"), "low")
        # Hooking: what a vertex learned also holds for the vertex its old label names.
        hooks, n_hooks = written_counted(low.filter("n < l").groupBy("l").agg(F.min("n").alias("hn")), "hooks")
        if not n_hooks:
            forget(low)
            break
        hot = heavy_keys(low, F.col("l")) if n_hooks > BROADCAST_ROWS else []
        low = written(split_join(low, hooks, "l", n_hooks, hot, "left").select("id", F.least("n", "hn").alias("n"), "l"), "low")
        hot = heavy_keys(low, F.col("n")) if n > BROADCAST_ROWS else []
        jumped = split_join(low, low.select(F.col("id").alias("n"), F.col("n").alias("jn")), "n", n, hot, "left")
        new = written(jumped.select("id", F.least("n", "jn").alias("l")), "labels")
        forget(labels)
        labels = new
    else:
        raise RuntimeError("components did not settle")
    return Graph(graph.vertices.drop("component").join(labels.select("id", F.col("l").alias("component")), "id"), graph.edges)


def component_sizes(components: DataFrame, component: str = "component") -> DataFrame:
    """(size, n_components): how many components have each size."""
    return components.groupBy(component).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def bond_percolation(graph: Graph) -> DataFrame:
    """(src, dst, component_src, component_dst): each distinct edge with the first edge, by (src, dst), that it is linked to
    through shared vertices."""
    labels = connected_components(graph).vertices.select("id", "component")
    pairs = graph.edges.select("src", "dst").distinct()
    placed = pairs.join(labels.withColumnRenamed("id", "src"), "src")
    least = placed.groupBy("component").agg(F.min(F.struct("src", "dst")).alias("first"))
    return placed.join(least, "component").select("src", "dst", F.col("first.src").alias("component_src"), F.col("first.dst").alias("component_dst"))


# -- cores -------------------------------------------------------------------------------------------------------------
def kcore(graph: Graph, k: int) -> DataFrame:
    """The edges that survive when vertices of fewer than k edges are removed again and again; multi-edges count."""
    edges = written(graph.edges.select("src", "dst"), "core")
    while True:
        degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
        weak, n = written_counted(degree.filter(F.col("count") < k).select("id"), "weak")
        if not n:
            return edges
        side = small_or_plain(weak, n)
        left = edges.join(side, F.col("src") == F.col("id"), "left_anti").join(side, F.col("dst") == F.col("id"), "left_anti")
        new = written(left, "core")
        forget(edges)
        forget(weak)
        edges = new


def kcore_sizes(graph: Graph, kmin: int, kmax: int) -> DataFrame:
    """(k, n_vertices, n_edges) for each k, each core made from the one before; ends at the first empty core."""
    rows, current = [], graph
    for k in range(kmin, kmax + 1):
        edges = kcore(current, k)
        m = edges.count()
        n = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()
        rows.append((k, n, m))
        if not m:
            break
        current = Graph(graph.vertices, edges)
    return graph.vertices.sparkSession.createDataFrame(rows, "k long, n_vertices long, n_edges long")


# -- triangles ---------------------------------------------------------------------------------------------------------
def _oriented(graph: Graph) -> DataFrame:
    """Each pair of neighbours once, from the end of lower degree to that of higher: no vertex has many out-edges."""
    pairs = graph.undirected()
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    forward = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"))


def triangles(graph: Graph) -> DataFrame:
    """(x, y, z): each triangle of the undirected graph once. Wedges are at the end of least degree."""
    e = written(_oriented(graph), "oriented")
    wedges = e.join(e.toDF("a", "c"), "a").filter(F.col("b") < F.col("c"))
    closing = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedges.join(closing, ["b", "c"]).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))


def triangle_counts(graph: Graph) -> DataFrame:
    """(id, n_triangles) of every vertex."""
    found = triangles(graph).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_triangles"))


def directed_triangle_counts(graph: Graph) -> DataFrame:
    """(id, in_triangles, out_triangles, through_triangles, cycle_triangles, in_degree, out_degree); repeated edges count once.

    For each edge s -> t, vertices w with s -> w and t -> w count to ``out`` of s, with s -> w -> t to ``through`` of s,
    with t -> w -> s to ``cycle`` of s, and with w -> s and w -> t to ``in`` of t.
    """
    e = written(graph.edges.select("src", "dst").distinct(), "distinct")
    # The undirected triangles are listed once, from their ends of least degree; then the directions of their sides are looked up.
    way = F.when(F.col("src") < F.col("dst"), 1).otherwise(2)
    ways = written(e.groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.sum(way).alias("w")), "ways")  # 1: up, 2: down, 3: both
    found = triangles(graph).select(F.array_sort(F.array("x", "y", "z")).alias("t")).select(*(F.col("t")[i].alias(c) for i, c in enumerate("xyz")))
    for p, q in (("x", "y"), ("y", "z"), ("x", "z")):
        found = found.join(ways.toDF(p, q, f"{p}{q}"), [p, q])
    goes = lambda p, q: ((F.col(p + q) if p < q else F.col(q + p)).bitwiseAND(1 if p < q else 2) > 0).cast("int")
    corners = []
    for s, t, w in (("x", "y", "z"), ("x", "z", "y"), ("y", "x", "z"), ("y", "z", "x"), ("z", "x", "y"), ("z", "y", "x")):
        edge = goes(s, t)
        zero = F.lit(0)
        corners.append(F.struct(F.col(t).alias("id"), (edge * goes(w, s) * goes(w, t)).alias("i"), zero.alias("o"), zero.alias("h"), zero.alias("c")))
        corners.append(F.struct(F.col(s).alias("id"), zero.alias("i"), (edge * goes(s, w) * goes(t, w)).alias("o"), (edge * goes(s, w) * goes(w, t)).alias("h"), (edge * goes(w, s) * goes(t, w)).alias("c")))
    named = {"i": "in_triangles", "o": "out_triangles", "h": "through_triangles", "c": "cycle_triangles"}
    counts = found.select(F.inline(F.array(*corners))).groupBy("id").agg(*(F.sum(c).alias(name) for c, name in named.items()))
    degrees = Graph(graph.vertices, e).degrees()
    return degrees.join(counts, "id", "left").na.fill(0).select("id", *named.values(), "in_degree", "out_degree")


# -- colouring ---------------------------------------------------------------------------------------------------------
#: Rounds of colouring in one job; more than are needed change nothing.
COLOR_ROUNDS = 2


def color(graph: Graph, order: str = "hash", seed: int = 0, max_rounds: int = 10_000) -> Graph:
    """A proper colouring in column ``color`` (0, 1, ...), by rounds of independent sets.

    A vertex takes the smallest colour free among its neighbours as soon as it comes before all uncoloured neighbours.
    order: ``hash`` (pseudo-random), ``degree`` (most out-edges first) or ``saturation`` (most colours around first, at the
    start most neighbours; re-judged each round). It is an error if ``max_rounds`` don't do.
    """
    pairs = written(graph.undirected(), "pairs")
    both = pairs.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    degree = both.groupBy("a").agg(F.count("*").alias("deg")) if order != "degree" else graph.degrees().select(F.col("id").alias("a"), F.col("out_degree").alias("deg"))
    first = F.lit(0) if order == "hash" else F.coalesce("deg", F.lit(0))
    state = written(graph.vertices.select("id").join(degree, F.col("id") == F.col("a"), "left").select("id", first.cast("double").alias("p"), hashed(F.col("id"), seed).alias("h"), F.lit(None).cast("int").alias("color")), "colors")
    rank = F.struct("p", "h", F.col("id").alias("i"))

    def round_(state: DataFrame) -> DataFrame:
        mine, theirs = state.filter("color IS NULL").select(F.col("id").alias("a"), rank.alias("mine")), state.select(F.col("id").alias("b"), rank.alias("theirs"), F.col("color").alias("nc"))
        seen = both.join(mine, "a").join(theirs, "b").groupBy("a").agg(
            F.max(F.when(F.col("nc").isNull() & (F.col("theirs") > F.col("mine")), 1).otherwise(0)).alias("later"),
            F.collect_set("nc").alias("used"),
        )
        # The first number that isn't used is among 0 .. size(used).
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        joined = state.join(seen, F.col("id") == F.col("a"), "left")
        chosen = F.when(F.col("color").isNotNull(), F.col("color")).when(F.col("a").isNull(), F.lit(0)).when(F.col("later") == 0, free)
        priority = F.col("p") if order != "saturation" else F.coalesce(F.size("used").cast("double"), F.col("p")) * 1.0
        return joined.select("id", priority.alias("p"), "h", chosen.cast("int").alias("color"))

    for k in range(0, max_rounds, COLOR_ROUNDS):
        new = state
        for _ in range(min(COLOR_ROUNDS, max_rounds - k)):
            new = round_(new)
        new, left = written_counted(new, "colors", F.col("color").isNull())
        forget(state)
        state = new
        if not left:
            break
    else:
        raise RuntimeError(f"vertices without a colour after {max_rounds} rounds")
    return Graph(graph.vertices.drop("color").join(state.select("id", "color"), "id"), graph.edges)


def color_conflicts(graph: Graph) -> DataFrame:
    """One row: the number of colours and of edges whose ends share one or lack one."""
    ends = graph.triplets(["color"], ["color"])
    conflicts = ends.agg(F.coalesce(F.sum(F.coalesce(F.col("s_color") == F.col("t_color"), F.lit(True)).cast("long")), F.lit(0)).alias("n_conflicts"))
    return graph.vertices.agg(F.countDistinct("color").alias("n_colors")).crossJoin(F.broadcast(conflicts))


# -- diameter ----------------------------------------------------------------------------------------------------------
FM_CONSTANT = 0.77351  # fixed value of the Flajolet-Martin estimate


def approximate_diameter(graph: Graph, tol: float = 1e-4, masks: int = 10, seed: int = 0, max_hops: int = 100, exact: bool = False) -> tuple[int, list[float]]:
    """(diameter, pair counts by hop): the last hop by which the pairs within reach grow by the factor 1 + tol or more.

    Each vertex keeps ``masks`` bit masks (or, exact, the set of ids) of what it reaches along out-edges.
    """
    if exact:
        # A reached pair (id, r) is a row: no set is held in one cell.
        edges = graph.edges.select("src", "dst").distinct()
        state = written(graph.vertices.select("id", F.col("id").alias("r")), "reach")
        counts = [float(state.count())]
        for hop in range(1, max_hops + 1):
            moved = edges.join(state, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "r")
            new = written(state.unionByName(moved).distinct(), "reach")
            forget(state)
            state = new
            counts.append(float(state.count()))
            if counts[-1] < counts[-2] * (1 + tol):
                return hop - 1, counts
        return max_hops, counts
    names = [f"m{i}" for i in range(masks)]
    # The place of a bit: the number of trailing ones of a hash, so bit j has probability 2^-(j+1).
    place = lambda i: F.least(F.lit(61), F.floor(-F.log2(hashed(F.col("id"), seed, i)))).cast("int")
    state = written(graph.vertices.select("id", *(F.expr("1L").alias(n) for n in names)).select("id", *(F.call_function("shiftleft", F.lit(1).cast("long"), place(i)).alias(n) for i, n in enumerate(names))), "masks")
    edges = graph.edges.select("src", "dst").distinct()
    counts = []

    def pairs(df: DataFrame) -> float:
        zero = lambda n: F.expr(f"bit_count({n} ^ ({n} + 1)) - 1")  # noqa: E731  trailing ones
        mean = sum((zero(n) for n in names), F.lit(0.0)) / masks
        return df.agg(F.sum(F.floor(F.pow(F.lit(2.0), mean) / FM_CONSTANT))).first()[0] or 0.0

    counts.append(float(pairs(state)))
    for hop in range(1, max_hops + 1):
        moved = edges.join(state, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), *names)
        new = written(state.unionByName(moved).groupBy("id").agg(*(F.bit_or(n).alias(n) for n in names)), "masks")
        forget(state)
        state = new
        counts.append(float(pairs(state)))
        if counts[-1] < counts[-2] * (1 + tol):
            return hop - 1, counts
    return max_hops, counts


# -- Laplacian and spectra ---------------------------------------------------------------------------------------------
def laplacian(graph: Graph, weight: str | None = None, kind: str = "normalized", diagonal: float = 2.0) -> DataFrame:
    """(i, j, v). ``normalized``: w / sqrt(d_i d_j) both ways and ``diagonal`` on the diagonal, d the sum of weights around
    a vertex. ``ratio``: -w both ways and the degree on the diagonal. Repeated edges add up; a vertex without edges has none."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = graph.edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), w.alias("w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    both = written(pairs.select("w", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))), "pairs")
    degree = both.groupBy("i").agg(F.sum("w").alias("d"))
    if kind == "ratio":
        return both.select("i", "j", (-F.col("w")).alias("v")).unionByName(degree.select("i", F.col("i").alias("j"), F.col("d").alias("v")))
    scaled = both.join(degree.toDF("i", "di"), "i").join(degree.toDF("j", "dj"), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))
    return scaled.unionByName(degree.select("i", F.col("i").alias("j"), F.lit(diagonal).alias("v")))


def normalized_rows(vectors: DataFrame, row: str = "i", col: str = "k", value: str = "v") -> DataFrame:
    """(row, vector): the entries of each row as an array in the order of ``col``, scaled to length 1 (a zero row stays)."""
    rows = vectors.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(col, value))), lambda s: s[value]).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("__n", norm).select(row, F.when(F.col("__n") > 0, F.transform("vector", lambda x: x / F.col("__n"))).otherwise(F.col("vector")).alias("vector"))


def matrix_exp(a: np.ndarray) -> np.ndarray:
    """exp(a) of a small dense matrix by scaling and squaring of its series."""
    squarings = max(0, math.ceil(math.log2(max(1e-300, np.abs(a).sum(axis=1).max()))) + 4)
    scaled, term, out = a / 2.0**squarings, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 25):
        term = term @ scaled / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def total_subgraph_centrality(graph: Graph, weight: str | None = None, steps: int = 30, column: int | None = None, tol: float = 1e-15) -> DataFrame:
    """(id, tsc): exp(A) times the vector of ones (or the unit vector of ``column``), by a Krylov basis of the symmetric A.

    Basis vectors stay distributed; only their inner products reach the driver (at most steps^2 numbers).
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = graph.edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), w.alias("w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    a = written(pairs.select("w", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))), "matrix")
    n = graph.num_vertices()
    size = math.sqrt(n) if column is None else 1.0
    begin = F.lit(1.0 / size) if column is None else (F.col("id") == column).cast("double")
    basis = written(graph.vertices.select("id", begin.alias("v0")), "basis")
    m = min(steps, n)
    h = np.zeros((m + 1, m))
    used = m
    for k in range(m):
        product = a.join(basis.select("id", f"v{k}"), F.col("j") == F.col("id")).groupBy("i").agg(F.sum(F.col("w") * F.col(f"v{k}")).alias("y"))
        both = written(basis.join(product, F.col("id") == F.col("i"), "left").drop("i").na.fill(0.0, ["y"]), "step")
        # Twice, for orthogonality: the second pass corrects what rounding left.
        y = F.col("y")
        for _ in range(2):
            row = both.agg(*(F.sum(F.col(f"v{i}") * y).alias(f"h{i}") for i in range(k + 1))).first()
            coefficients = [row[f"h{i}"] or 0.0 for i in range(k + 1)]
            h[: k + 1, k] += coefficients
            for i, c in enumerate(coefficients):
                y = y - F.lit(float(c)) * F.col(f"v{i}")
        beta = math.sqrt(max(0.0, both.agg(F.sum(y * y)).first()[0] or 0.0))
        h[k + 1, k] = beta
        if beta < 1e-10:
            used = k + 1
            break
        new = written(both.withColumn(f"v{k + 1}", y / beta).drop("y"), "basis")
        forget(basis)
        forget(both)
        basis = new
        e = matrix_exp(h[: k + 1, : k + 1])
        if abs(e[-1, 0]) * beta < tol:
            used = k + 1
            break
    e = matrix_exp(h[:used, :used])[:, 0] * size
    return basis.select("id", sum((F.lit(float(e[i])) * F.col(f"v{i}") for i in range(used)), F.lit(0.0)).alias("tsc"))


def topological_levels(graph: Graph) -> tuple[DataFrame, bool]:
    """((id, level), acyclic): rounds of removing vertices without in-edges; on a cycle the rest has no level."""
    edges = written(graph.edges.select("src", "dst").distinct(), "edges")
    left = written(graph.vertices.select("id"), "left")
    found, level = None, 0
    while True:
        free = written(left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        found = free if found is None else found.unionByName(free)
        left = written(left.join(free, "id", "left_anti"), "left")
        edges = written(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
        level += 1
    empty = graph.vertices.select("id", F.lit(0).alias("level")).limit(0)
    return (empty if found is None else found), left.isEmpty()


# -- labels and epidemics ----------------------------------------------------------------------------------------------
def label_propagation(graph: Graph, label: str = "label", max_iterations: int = 10) -> Graph:
    """Each vertex takes the most frequent label around it (the smallest of several), in synchronous rounds.

    Labels are text; NULL labels don't count, and a vertex without labelled neighbours keeps its own. Rounds can
    oscillate, so they end at ``max_iterations`` or when nothing changes.
    """
    near = written(graph.adjacent(Dir.ALL).select("center", "nbr"), "near")
    state = written(graph.vertices.select("id", F.col(label).alias("l")), "labels")
    for _ in range(max_iterations):
        counts = near.join(state, F.col("nbr") == F.col("id")).filter("l IS NOT NULL").groupBy("center", "l").agg(F.count("*").alias("n"))
        best = counts.groupBy("center").agg(F.min(F.struct((-F.col("n")).alias("n"), "l")).alias("best"))
        new = written(state.join(best, F.col("id") == F.col("center"), "left").select("id", F.coalesce("best.l", "l").alias("l"), F.col("l").alias("was")), "labels")
        changed = not new.filter("NOT l <=> was").isEmpty()
        forget(state)
        state = new.select("id", "l")
        state._weft_path = new._weft_path
        if not changed:
            break
    return Graph(graph.vertices.drop(label).join(state.select("id", F.col("l").alias(label)), "id"), graph.edges)


def cascade(graph: Graph, status: str = "status", infect: float = 0.3, recover: float = 0.2, steps: int = 5, seed: int = 0) -> Graph:
    """Susceptible, infected, recovered ('S', 'I', 'R') in synchronous steps with draws hashed from (id, step, seed).

    An infected vertex recovers with probability ``recover``; a susceptible one with k infected neighbours falls ill
    with probability 1 - (1 - infect)^k.
    """
    near = written(graph.adjacent(Dir.ALL).select("center", "nbr"), "near")
    state = graph.vertices.select("id", F.col(status).alias("s"))
    for k in range(steps):
        ill = near.join(state.filter("s = 'I'"), F.col("nbr") == F.col("id")).groupBy("center").agg(F.count("*").alias("n"))
        u = hashed(F.col("id"), k, seed)
        chance = 1 - F.pow(F.lit(1 - infect), F.coalesce("n", F.lit(0)))
        state = state.join(ill, F.col("id") == F.col("center"), "left").select("id", F.when((F.col("s") == "I") & (u < recover), "R").when((F.col("s") == "S") & (u < chance), "I").otherwise(F.col("s")).alias("s"))
        if k % 3 == 2:
            state = written(state, "cascade")
    return Graph(graph.vertices.drop(status).join(state.select("id", F.col("s").alias(status)), "id"), graph.edges)


def min_propagation(graph: Graph, max_iterations: int | None = None) -> RunResult:
    """The smallest id that reaches each vertex over edges of either direction (column ``low``), as a plain program."""
    state = Graph(graph.vertices.select("id").withColumn("low", F.col("id").cast("double")), graph.edges)
    program = VertexProgram(gather_dir=Dir.NONE, apply={"low": F.least("low", "msg")}, scatter_dir=Dir.ALL, scatter_if=F.col("c_low") < F.col("n_low"), message=F.col("c_low"), combine=F.min)
    return run(state, program, messages=signals(state.complete_set(), F.lit(float("inf"))), max_iterations=max_iterations)
