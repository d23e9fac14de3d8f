"""Graphical models: belief propagation on pairwise and factor graphs, MPLP and dual decomposition.

Everything is in log space; messages and beliefs are arrays over a variable's states, one row per directed edge or
variable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.algorithms.analytics import hashed
from weftgraph.functions.batches import arrays, grouped_vector_sum, map_rows, matrix
from weftgraph.session import forget, written

#: Assignments of one factor table at most.
MOST_CELLS = 1 << 16


def normalized_log(x: Column) -> Column:
    """The array less its log-sum-exp."""
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.log(total))


def potts_bp(priors: DataFrame, edges: DataFrame, smoothing: float = 2.0, damping: float = 0.1, iterations: int = 10, maximum: bool = False) -> DataFrame:
    """(id, belief, map_state): loopy propagation with the potential -smoothing * weight between different states.

    priors: (id, prior ARRAY of log potentials); edges: (src, dst[, weight]), each link once. ``maximum``: max-product.
    belief is normalised in log space; map_state is the smallest best state. Isolated variables keep their priors.
    """
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    links = edges.select(w.alias("w"), F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    priors = written(priors.select("id", normalized_log(F.col("prior").cast("array<double>")).alias("prior")), "priors")
    zero = F.transform("prior", lambda x: F.lit(0.0))
    messages = written(links.join(priors.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "w", zero.alias("m")), "messages")

    def beliefs(messages: DataFrame) -> DataFrame:
        sums = grouped_vector_sum(messages.select(F.col("dst").alias("id"), "m"), "id", lambda b: matrix(b.column("m")))
        both = priors.join(sums, "id", "left")
        return both.select("id", F.when(F.col("total").isNull(), F.col("prior")).otherwise(F.zip_with("prior", "total", lambda a, b: a + b)).alias("b"))

    for _ in range(iterations):
        sent = messages.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("m").alias("back"))
        rows = messages.join(sent, ["src", "dst"]).join(beliefs(messages).select(F.col("id").alias("src"), "b"), "src")
        cavity = F.zip_with("b", "back", lambda a, c: a - c)
        rows = rows.withColumn("c", cavity).withColumn("top", F.array_max("c"))
        other = -F.lit(float(smoothing)) * F.col("w")
        if maximum:
            out = F.transform("c", lambda x: F.greatest(x, F.col("top") + other))
        else:
            total = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
            out = F.transform("c", lambda x: F.log(F.exp(x - F.col("top")) + F.exp(other) * (total - F.exp(x - F.col("top")))))
        mixed = F.zip_with(normalized_log(out), "m", lambda new, old: (1 - damping) * new + damping * old)
        new = written(rows.select("src", "dst", "w", mixed.alias("m")), "messages")
        forget(messages)
        messages = new
    final = beliefs(messages).select("id", normalized_log(F.col("b")).alias("belief"))
    return final.withColumn("map_state", (F.array_position("belief", F.array_max("belief")) - 1).cast("long"))


def factor_graph_bp(variables: DataFrame, factors: DataFrame, iterations: int = 10, damping: float = 0.0, maximum: bool = False) -> DataFrame:
    """(id, belief): propagation on variables (id, prior) and factors (fid, scope ARRAY<LONG>, sizes ARRAY<INT>, logp ARRAY).

    logp lists the assignments with the last variable of the scope running fastest. A table of more than MOST_CELLS is
    an error. Exact on trees after as many rounds as the diameter; ``maximum``: max-product.
    """
    priors = written(variables.select("id", normalized_log(F.col("prior").cast("array<double>")).alias("prior")), "priors")
    factors = written(factors.withColumn("logp", F.when(F.size("logp") > MOST_CELLS, F.raise_error(F.lit("a factor is too large"))).otherwise(F.col("logp")).cast("array<double>")), "factors")
    slots = factors.select("fid", F.posexplode("scope").alias("p", "id"))
    zero = F.transform("prior", lambda x: F.lit(0.0))
    up = written(slots.join(priors, "id").select("fid", "id", "p", zero.alias("m")), "up")  # factor to variable
    schema = "fid long, id long, p int, m array<double>"

    def beliefs(up: DataFrame) -> DataFrame:
        total = up.select("id", F.posexplode("m").alias("s", "x")).groupBy("id", "s").agg(F.sum("x").alias("x")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "x"))), lambda c: c["x"]).alias("t"))
        return priors.join(total, "id", "left").select("id", F.when(F.col("t").isNull(), F.col("prior")).otherwise(F.zip_with("prior", "t", lambda a, b: a + b)).alias("b"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column("shape").to_pylist()
            for shape in sorted(set(shapes)):
                # Factors of one shape are one array.
                same = batch.filter(pa.array([x == shape for x in shapes]))
                sizes = [int(x) for x in shape.split("x")]
                n, k = same.num_rows, len(sizes)
                table = matrix(same.column("logp")).reshape(n, *sizes)
                spread = lambda x, p: x.reshape([n] + [sizes[p] if a == p else 1 for a in range(k)])  # noqa: E731, B023
                flat = matrix(same.column("down"))
                begins = np.concatenate(([0], np.cumsum(sizes)))
                total = sum(begins[-1:])
                down, old = ([flat[:, o + begins[p] : o + begins[p + 1]] for p in range(k)] for o in (0, total))
                whole = table + sum(spread(d, p) for p, d in enumerate(down))
                scope = matrix(same.column("scope")).astype(np.int64)
                for p in range(k):
                    t = whole - spread(down[p], p)
                    axes = tuple(a + 1 for a in range(k) if a != p)
                    top = t.max(axis=tuple(range(1, k + 1)), keepdims=True)
                    m = t.max(axis=axes) if maximum else np.log(np.exp(t - top).sum(axis=axes)) + top.reshape(n, 1)
                    m = m - m.max(axis=1, keepdims=True)
                    m = m - np.log(np.exp(m).sum(axis=1, keepdims=True))
                    mixed = (1 - damping) * m + damping * old[p]
                    yield pa.RecordBatch.from_arrays([same.column("fid"), pa.array(scope[:, p]), pa.array(np.full(n, p, np.int32)), arrays(mixed)], ["fid", "id", "p", "m"])

    for _ in range(iterations):
        down = up.join(beliefs(up), "id").select("fid", "p", F.zip_with("b", "m", lambda a, c: a - c).alias("m"), F.col("m").alias("old"))
        # The messages of a factor's variables in the order of its scope, then the old ones: two flat runs in one array.
        listed = F.array_sort(F.collect_list(F.struct("p", "m", "old")))
        run = lambda c: F.flatten(F.transform("x", lambda s: s[c]))
        grouped = down.groupBy("fid").agg(listed.alias("x")).select("fid", F.concat(run("m"), run("old")).alias("down"))
        shape = F.concat_ws("x", F.transform("sizes", lambda x: x.cast("string")))
        new = written(factors.join(grouped, "fid").select("fid", "scope", shape.alias("shape"), "logp", "down").mapInArrow(send, schema), "up")
        forget(up)
        up = new
    return beliefs(up).select("id", normalized_log(F.col("b")).alias("belief"))


def mplp(unaries: DataFrame, pairs: DataFrame, iterations: int = 10) -> tuple[DataFrame, list[float]]:
    """((id, belief, map_state), dual values): block updates of the MAP relaxation. unaries: (id, theta ARRAY);
    pairs: (eid, i, j, theta ARRAY of the table, j fastest).

    Blocks that share a variable can't be updated together without losing the bound; an edge is updated in the round in
    which its hash is the smallest around it, so a sweep is a few rounds of independent edges. The dual never rises.
    """
    unaries = written(unaries.select("id", F.col("theta").cast("array<double>").alias("u")), "unaries")
    size = unaries.select(F.col("id").alias("i"), F.transform("u", lambda x: F.lit(0.0)).alias("z"))
    state = written(pairs.select("eid", "i", "j", F.col("theta").cast("array<double>").alias("t")).join(size.toDF("i", "di"), "i").join(size.toDF("j", "dj"), "j"), "deltas")
    duals: list[float] = []

    def beliefs(state: DataFrame) -> DataFrame:
        parts = state.select(F.inline(F.array(F.struct(F.col("i").alias("id"), F.col("di").alias("d")), F.struct(F.col("j").alias("id"), F.col("dj").alias("d")))))
        sums = grouped_vector_sum(parts, "id", lambda b: matrix(b.column("d")))
        return unaries.join(sums, "id", "left").select("id", F.when(F.col("total").isNull(), F.col("u")).otherwise(F.zip_with("u", "total", lambda a, b: a + b)).alias("b"))

    def table(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return t.reshape(len(t), x.shape[1], y.shape[1])

    def dual(state: DataFrame) -> float:
        one = beliefs(state).agg(F.sum(F.array_max("b"))).first()[0] or 0.0
        rest = map_rows(state, ["eid"], ["t", "di", "dj"], lambda t, x, y: (table(t, x, y) - x[:, :, None] - y[:, None, :]).max(axis=(1, 2))[:, None], "v")
        return one + (rest.agg(F.sum(F.col("v")[0])).first()[0] or 0.0)

    for step in range(iterations):
        ends = state.select("eid", hashed(F.col("eid"), step).alias("h"), F.explode(F.array("i", "j")).alias("v"))
        first = ends.groupBy("v").agg(F.min(F.struct("h", "eid")).alias("m"))
        free = ends.join(first, "v").groupBy("eid").agg(F.min((F.col("m.eid") == F.col("eid")).cast("int")).alias("free"))
        b = beliefs(state)
        rows = state.join(b.toDF("i", "bi"), "i").join(b.toDF("j", "bj"), "j").join(free, "eid")

        def update(t: np.ndarray, x: np.ndarray, y: np.ndarray, bi: np.ndarray, bj: np.ndarray, f: np.ndarray) -> np.ndarray:
            p, q, w = bi - x, bj - y, table(t, x, y)
            nx = 0.5 * ((w + q[:, None, :]).max(axis=2) - p)
            ny = 0.5 * ((w + p[:, :, None]).max(axis=1) - q)
            on = f[:, None] == 1
            return np.concatenate((np.where(on, nx, x), np.where(on, ny, y)), axis=1)

        moved = map_rows(rows, ["eid"], ["t", "di", "dj", "bi", "bj", "free"], update, "d")
        n = F.size("di")
        new = written(state.join(moved, "eid").select("eid", "i", "j", "t", F.slice("d", F.lit(1), n).alias("di"), F.slice("d", n + 1, F.size("d") - n).alias("dj")), "deltas")
        forget(state)
        state = new
        duals.append(dual(state))
    final = beliefs(state).withColumnRenamed("b", "belief")
    return final.withColumn("map_state", (F.array_position("belief", F.array_max("belief")) - 1).cast("long")), duals


def dual_decomposition(unaries: DataFrame, pairs: DataFrame, iterations: int = 20, step: float = 1.0, method: str = "projected") -> tuple[DataFrame, list[float], list[float]]:
    """((id, map_state), dual values, primal values) by subgradients on the copies of variables in each pair.

    ``projected``: each round solves the pairs and moves the multipliers by the difference to the mean of the copies.
    ``symmetric``: the multiplier of the pair's choice falls and that of the variable's own choice rises.
    ``admm``: as projected, with a step that doesn't shrink and multipliers kept as a running mean.
    """
    if method not in ("projected", "symmetric", "admm"):
        raise ValueError(f"unknown method: {method}")
    unaries = written(unaries.select("id", F.col("theta").cast("array<double>").alias("u")), "unaries")
    pairs = written(pairs.select("eid", "i", "j", F.col("theta").cast("array<double>").alias("t")), "pairs")
    degree = pairs.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    share = written(unaries.join(degree, "id", "left").select("id", "u", F.coalesce("n", F.lit(0)).alias("n")), "share")
    zero = share.select("id", F.transform("u", lambda x: F.lit(0.0)).alias("z"), "u", "n")
    state = written(pairs.join(zero.toDF("i", "li", "ui", "ni"), "i").join(zero.toDF("j", "lj", "uj", "nj"), "j"), "state")
    duals, primals, best = [], [], None
    alone = share.filter("n = 0").agg(F.coalesce(F.sum(F.array_max("u")), F.lit(0.0))).first()[0]
    for k in range(iterations):
        def solve(t: np.ndarray, li: np.ndarray, ui: np.ndarray, ni: np.ndarray, lj: np.ndarray, uj: np.ndarray, nj: np.ndarray) -> np.ndarray:
            w = t.reshape(len(t), ui.shape[1], uj.shape[1]) + (ui / ni[:, None] + li)[:, :, None] + (uj / nj[:, None] + lj)[:, None, :]
            flat = w.reshape(len(w), -1)
            a = flat.argmax(axis=1)
            return np.stack((a // uj.shape[1], a % uj.shape[1], flat[np.arange(len(a)), a]), axis=1)

        solved = written(map_rows(state, ["eid", "i", "j"], ["t", "li", "ui", "ni", "lj", "uj", "nj"], solve, "s"), "solved")
        duals.append((solved.agg(F.sum(F.col("s")[2])).first()[0] or 0.0) + alone)
        votes = solved.select(F.inline(F.array(F.struct(F.col("i").alias("id"), F.col("s")[0].cast("int").alias("x")), F.struct(F.col("j").alias("id"), F.col("s")[1].cast("int").alias("x")))))
        counts = votes.groupBy("id", "x").agg(F.count("*").alias("c"))
        means = counts.groupBy("id").agg(F.collect_list(F.struct("x", "c")).alias("v"), F.sum("c").alias("all"), F.max(F.struct("c", (-F.col("x")).alias("x"))).alias("top"))
        labels = share.join(means, "id", "left").select("id", F.coalesce(-F.col("top.x"), F.array_position("u", F.array_max("u")) - 1).cast("long").alias("map_state"), "u")
        labels = written(labels, "labels")
        placed = pairs.join(labels.select(F.col("id").alias("i"), F.col("map_state").alias("a")), "i").join(labels.select(F.col("id").alias("j"), F.col("map_state").alias("b"), F.size("u").alias("nb")), "j")
        primal = (labels.agg(F.sum(F.col("u")[F.col("map_state").cast("int")])).first()[0] or 0.0) + (placed.agg(F.sum(F.col("t")[(F.col("a") * F.col("nb") + F.col("b")).cast("int")])).first()[0] or 0.0)
        primals.append(primal)
        if best is None or primal > best[0]:
            best = (primal, labels.select("id", "map_state"))
        gamma = step / (1.0 if method == "admm" else (1 + k) ** 0.5)
        mean = means.select("id", F.map_from_entries(F.transform("v", lambda s: F.struct(s["x"], (s["c"] / F.col("all")).alias("p")))).alias("mean"), (-F.col("top.x")).alias("own"))
        rows = state.join(solved.select("eid", "s"), "eid").join(mean.toDF("i", "mi", "oi"), "i").join(mean.toDF("j", "mj", "oj"), "j")

        def moved(lam: str, share_: str, own: str, q: int) -> Column:
            target = (lambda x: F.coalesce(F.try_element_at(F.col(share_), x), F.lit(0.0))) if method != "symmetric" else (lambda x: (F.col(own) == x).cast("double"))
            return F.transform(lam, lambda v, x: v + gamma * (target(x) - (F.col("s")[q].cast("int") == x).cast("double")))

        new = written(rows.select("eid", "j", "i", "t", moved("li", "mi", "oi", 0).alias("li"), "ui", "ni", moved("lj", "mj", "oj", 1).alias("lj"), "uj", "nj"), "state")
        forget(state)
        state = new
    return best[1], duals, primals


def _to_simplex(x: np.ndarray) -> np.ndarray:
    """Rows moved to the nearest point of the probability simplex."""
    ordered = -np.sort(-x, axis=1)
    excess = (np.cumsum(ordered, axis=1) - 1) / np.arange(1, x.shape[1] + 1)
    last = (ordered > excess).sum(axis=1) - 1
    return np.maximum(x - excess[np.arange(len(x)), last][:, None], 0)


def alternating_decomposition(unaries: DataFrame, pairs: DataFrame, iterations: int = 20, rho: float = 1.0, inner: int = 40) -> tuple[DataFrame, list[float], list[float]]:
    """((id, map_state), dual values, primal values): dual decomposition by alternating directions with quadratic sub-problems.

    Each pair maximises its value plus multipliers less rho / 2 times the squared distance of its marginals from the
    variables' (``inner`` steps of projected gradients, accelerated); the variables take the mean of their copies; the
    multipliers move by rho times the difference. Labels are the variables' likeliest states.
    """
    unaries = written(unaries.select("id", F.col("theta").cast("array<double>").alias("u")), "unaries")
    degree = pairs.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    share = written(unaries.join(degree, "id", "left").select("id", "u", F.coalesce("n", F.lit(0)).cast("double").alias("n")), "share")
    flat = lambda c, v: F.transform(c, lambda x: v)
    begun = share.select("id", "u", "n", flat("u", F.lit(0.0)).alias("l"), flat("u", 1.0 / F.size("u")).alias("z"))
    side = lambda s: begun.select(F.col("id").alias(s), *(F.col(c).alias(c + s) for c in "unlz"))
    state = written(pairs.select("eid", "i", "j", F.col("theta").cast("array<double>").alias("t")).join(side("i"), "i").join(side("j"), "j"), "state")
    alone = share.filter("n = 0").agg(F.coalesce(F.sum(F.array_max("u")), F.lit(0.0))).first()[0]
    duals, primals, best = [], [], None

    def solve(t: np.ndarray, ui: np.ndarray, ni: np.ndarray, li: np.ndarray, zi: np.ndarray, uj: np.ndarray, nj: np.ndarray, lj: np.ndarray, zj: np.ndarray) -> np.ndarray:
        a, b = ui.shape[1], uj.shape[1]
        w = t.reshape(-1, a, b) + (ui / ni[:, None] + li)[:, :, None] + (uj / nj[:, None] + lj)[:, None, :]
        bound = w.reshape(len(w), -1).max(axis=1)
        q = np.full(w.shape, 1 / (a * b))
        y, k, rate = q, 1.0, 1 / (rho * (a + b))
        for _ in range(inner):
            slope = w - rho * ((y.sum(axis=2) - zi)[:, :, None] + (y.sum(axis=1) - zj)[:, None, :])
            new = _to_simplex((y + rate * slope).reshape(len(w), -1)).reshape(w.shape)
            after = (1 + (1 + 4 * k * k) ** 0.5) / 2
            y, q, k = new + (k - 1) / after * (new - q), new, after
        return np.concatenate((bound[:, None], q.sum(axis=2), q.sum(axis=1)), axis=1)

    for _ in range(iterations):
        solved = map_rows(state, ["eid", "i", "j"], ["t", "ui", "ni", "li", "zi", "uj", "nj", "lj", "zj"], solve, "s")
        n = F.size("ui")
        both = written(state.join(solved.select("eid", "s"), "eid").withColumns({"qi": F.slice("s", F.lit(2), n), "qj": F.slice("s", n + 2, F.size("uj"))}), "solved")
        duals.append((both.agg(F.sum(F.col("s")[0])).first()[0] or 0.0) + alone)
        copies = both.select(F.inline(F.array(F.struct(F.col("i").alias("id"), F.col("qi").alias("q")), F.struct(F.col("j").alias("id"), F.col("qj").alias("q")))))
        sums = grouped_vector_sum(copies, "id", lambda b: matrix(b.column("q")))
        means = written(share.join(sums, "id", "left").select("id", "u", F.when(F.col("total").isNull(), F.col("u")).otherwise(F.transform("total", lambda x: x / F.col("n"))).alias("z")), "means")
        labels = written(means.select("id", (F.array_position("z", F.array_max("z")) - 1).cast("long").alias("map_state"), "u"), "labels")
        ends = both.select("i", "j", "t", F.size("uj").alias("b")).join(labels.select(F.col("id").alias("i"), F.col("map_state").alias("x")), "i").join(labels.select(F.col("id").alias("j"), F.col("map_state").alias("y")), "j")
        own = labels.agg(F.sum(F.col("u")[F.col("map_state").cast("int")])).first()[0] or 0.0
        primals.append(own + (ends.agg(F.sum(F.col("t")[(F.col("x") * F.col("b") + F.col("y")).cast("int")])).first()[0] or 0.0))
        if best is None or primals[-1] > best[0]:
            best = (primals[-1], labels.select("id", "map_state"))
        moved = lambda s: F.zip_with(F.col("l" + s), F.zip_with(F.col("q" + s), F.col("m" + s), lambda q, m: q - m), lambda v, d: v - rho * d).alias("l" + s)
        near = lambda s: means.select(F.col("id").alias(s), F.col("z").alias("m" + s))
        rows = both.join(near("i"), "i").join(near("j"), "j")
        new = written(rows.select("eid", "i", "j", "t", "ui", "ni", moved("i"), F.col("mi").alias("zi"), "uj", "nj", moved("j"), F.col("mj").alias("zj")), "state")
        forget(state)
        forget(both)
        state = new
    return best[1], duals, primals


def noisy_image(spark: SparkSession, rows: int, cols: int, states: int = 3, noise: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((id, truth, prior), (src, dst)): bands of states on a grid, each pixel seen wrong with probability ``noise``."""
    cells = spark.range(rows * cols).withColumn("truth", (F.pmod("id", F.lit(cols)) * states / cols).cast("int"))
    seen = F.when(hashed(F.col("id"), seed) < noise, (hashed(F.col("id"), seed, 1) * states).cast("int")).otherwise(F.col("truth"))
    prior = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.log(F.when(s == seen, 1 - noise + noise / states).otherwise(noise / states)))
    right = cells.filter(F.pmod("id", F.lit(cols)) < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.filter(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return cells.select("id", "truth", prior.alias("prior")), right.unionByName(down)
