"""Collaborative filtering over ratings (user, item, rating[, weight], role).

Factors are frames (id, f ARRAY<DOUBLE>). Every step is: join the factors to the ratings, sum vectors by user or item
with partial sums before the shuffle (a popular item costs a few partial sums, not one long task), and update all
factors of one side at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weftgraph.algorithms.analytics import hashed
from weftgraph.functions.draws import mixed, mixed_numbers
from weftgraph.functions.batches import arrays, grouped_vector_sum, map_rows, matrix, read_batches
from weftgraph.functions.sparse import cosamp
from weftgraph.session import BROADCAST_ROWS, forget, written

D = 20


@dataclass(frozen=True)
class Model:
    """users, items: (id, f); bias models keep the bias as the last entry of f, ``mean`` is the global mean."""

    users: DataFrame
    items: DataFrame
    mean: float = 0.0
    kind: str = "dot"
    implicit: DataFrame | None = None
    few_items: bool = False  # counted, and few enough to be sent to every task


def start_factors(ratings: DataFrame, side: str, d: int, seed: int, scale: float = 0.1, positive: bool = False) -> DataFrame:
    ids = ratings.select(F.col(side).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    draw = lambda k: (hashed(F.col("id"), side, seed, k) - (0.0 if positive else 0.5)) * F.lit(scale)
    return written(ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), draw).alias("f")), "factors")


def training(ratings: DataFrame, role: str = "train") -> DataFrame:
    """The rows of a role with all values present."""
    return ratings.filter((F.col("role") == role) & F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("rating").isNotNull())


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def predict(model: Model, ratings: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``ratings`` with ``prediction``, clipped to [low, high]; NULL for a user or item that the model doesn't know."""
    items = model.items.toDF("item", "vf")
    both = ratings.join(model.users.toDF("user", "uf"), "user", "left").join(F.broadcast(items) if model.few_items else items, "item", "left")
    if model.kind == "dot":
        p = _dot("uf", "vf")
    else:
        head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
        both = both.withColumns({"ub": F.element_at("uf", -1), "vb": F.element_at("vf", -1), "uf": head(F.col("uf")), "vf": head(F.col("vf"))})
        p = F.lit(model.mean) + F.col("ub") + F.col("vb") + _dot("uf", "vf")
    if low is not None:
        p = F.greatest(F.lit(low), F.least(F.lit(high), p))
    known = F.col("uf").isNotNull() & F.col("vf").isNotNull()
    return both.withColumn("prediction", F.when(known, p)).drop("uf", "vf", "ub", "vb")


def rmse(predicted: DataFrame) -> DataFrame:
    """(role, n, rmse) of the rows with a rating and a prediction."""
    e = F.col("rating") - F.col("prediction")
    return predicted.filter(e.isNotNull()).groupBy("role").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


# -- alternating least squares -----------------------------------------------------------------------------------------
def _half(ratings: DataFrame, key: str, other: str, factors: DataFrame, d: int, lam: float, scaled: bool, sparse: int | None) -> DataFrame:
    rows = ratings.select(F.col(key).cast("long").alias("id"), F.col(other).alias("o"), F.col("rating").cast("double").alias("r"), F.col("weight").cast("double").alias("w")).join(factors.toDF("o", "f"), "o")

    def features(b: pa.RecordBatch) -> np.ndarray:
        f, r, w = matrix(b.column("f")), b.column("r").to_numpy(), b.column("w").to_numpy()
        square = (f[:, :, None] * f[:, None, :] * w[:, None, None]).reshape(len(f), -1)
        return np.concatenate((square, f * (r * w)[:, None], np.ones((len(f), 1))), axis=1)

    def solve(total: np.ndarray) -> np.ndarray:
        a, y, n = total[:, : d * d].reshape(-1, d, d), total[:, d * d : d * d + d], total[:, -1]
        a = a + (lam * (n if scaled else np.ones_like(n)))[:, None, None] * np.eye(d)
        if sparse is not None:
            return np.stack([cosamp(p, q, sparse) for p, q in zip(a, y, strict=True)])
        return np.linalg.solve(a, y[:, :, None])[:, :, 0]

    sums = grouped_vector_sum(rows.select("id", "f", "r", "w"), "id", features)
    return written(map_rows(sums, ["id"], ["total"], solve, "f"), "factors")


def als(ratings: DataFrame, d: int = D, iterations: int = 5, lam: float = 0.01, reg: str = "both", scaled: bool = True, seed: int = 0, sparse: str | None = None, sparsity: float = 0.8) -> Model:
    """Alternating least squares; users first, ridge lam (times the number of ratings if ``scaled``).

    reg='ref' leaves the items unregularised but for rounding. A ``weight`` column weighs the rows (weighted ALS).
    sparse: 'user', 'item' or 'both' sides get at most ceil((1 - sparsity) * d) non-zero entries (CoSaMP).
    """
    return list(als_rounds(ratings, d, iterations, lam, reg, scaled, seed, sparse, sparsity))[-1]


def als_rounds(ratings: DataFrame, d: int = D, iterations: int = 5, lam: float = 0.01, reg: str = "both", scaled: bool = True, seed: int = 0, sparse: str | None = None, sparsity: float = 0.8) -> Iterator[Model]:
    """The models of ``als`` after each iteration."""
    train = training(ratings)
    train = written((train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0))).select("user", "item", "rating", "weight"), "train")
    items = start_factors(train, "item", d, seed, 1.0, positive=True)
    keep = int(np.ceil((1 - sparsity) * d))
    for _ in range(iterations):
        users = _half(train, "user", "item", items, d, lam, scaled, keep if sparse in ("user", "both") else None)
        items = _half(train, "item", "user", users, d, lam if reg == "both" else 1e-9, scaled, keep if sparse in ("item", "both") else None)
        yield Model(users, items)


def als_objective(model: Model, ratings: DataFrame) -> float:
    """The sum of squared training errors."""
    e = F.col("rating") - F.col("prediction")
    return predict(model, training(ratings)).agg(F.sum(e * e)).first()[0] or 0.0


# -- gradient methods --------------------------------------------------------------------------------------------------
def _step(train: DataFrame, users: DataFrame, items: DataFrame, mean: float, bias: bool, gamma: float, lam: float, most: float = 4.0) -> tuple[DataFrame, DataFrame]:
    rows = written(train.join(users.toDF("user", "uf"), "user").join(items.toDF("item", "vf"), "item").select(F.col("user").cast("long").alias("u"), F.col("item").cast("long").alias("v"), F.col("rating").cast("double").alias("r"), "uf", "vf"), "rows")

    def grads(side: int) -> Callable[[pa.RecordBatch], np.ndarray]:
        def features(b: pa.RecordBatch) -> np.ndarray:
            f, g, r = matrix(b.column("uf")), matrix(b.column("vf")), b.column("r").to_numpy()
            if bias:
                e = r - mean - f[:, -1] - g[:, -1] - (f[:, :-1] * g[:, :-1]).sum(axis=1)
                mine, theirs = (f, g.copy()) if side == 0 else (g, f.copy())
                theirs[:, -1] = 1.0
            else:
                e = r - (f * g).sum(axis=1)
                mine, theirs = (f, g) if side == 0 else (g, f)
            step = gamma * (e[:, None] * theirs - lam * mine)
            return np.concatenate((step, np.ones((len(r), 1))), axis=1)

        return features

    def moved(old: DataFrame, total: DataFrame) -> DataFrame:
        # Many ratings of one item would add up to a step far too long: it is limited to that of 1 / (most * gamma) ratings.
        def add(f: np.ndarray, t: np.ndarray) -> np.ndarray:
            n = t[:, -1:]
            return f + t[:, :-1] / np.maximum(1.0, n * gamma * most)

        both = old.join(total, "id", "left")
        hit, miss = both.filter("total IS NOT NULL"), both.filter("total IS NULL").select("id", "f")
        return written(map_rows(hit, ["id"], ["f", "total"], add, "f").unionByName(miss), "factors")

    new_users = moved(users, grouped_vector_sum(rows.withColumnRenamed("u", "id"), "id", grads(0)))
    new_items = moved(items, grouped_vector_sum(rows.withColumnRenamed("v", "id"), "id", grads(1)))
    return new_users, new_items


def sgd(ratings: DataFrame, d: int = D, epochs: int = 10, gamma: float = 0.02, lam: float = 0.02, decay: float = 0.9, bias: bool = False, seed: int = 0, most: float = 4.0) -> Model:
    """Gradient descent on squared errors with ridge lam; gamma times ``decay`` after each epoch. ``bias``: mean + user and
    item biases as well. The steps of one epoch are taken together (synchronously); as the steps of n ratings would overshoot,
    their sum is divided by n * gamma * ``most`` where that is above 1 (0: never)."""
    train = written(training(ratings).select("user", "item", "rating"), "train")
    mean = float(train.agg(F.avg("rating")).first()[0] or 0.0) if bias else 0.0
    width = d + 1 if bias else d
    users, items = start_factors(train, "user", width, seed, 0.5, not bias), start_factors(train, "item", width, seed, 0.5, not bias)
    for _ in range(epochs):
        users, items = _step(train, users, items, mean, bias, gamma, lam, most)
        gamma *= decay
    return Model(users, items, mean, "bias" if bias else "dot")


def svdpp(ratings: DataFrame, d: int = D, epochs: int = 5, gamma: float = 0.02, lam: float = 0.02, decay: float = 0.9, seed: int = 0) -> Model:
    """SVD++: a user's factor is its own plus the sum of the implicit factors of its items over sqrt(n), in two phases.

    The returned users hold the combined factors, so that ``predict`` works as for bias-SGD.
    """
    train = written(training(ratings).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), "rating"), "train")
    mean = float(train.agg(F.avg("rating")).first()[0] or 0.0)
    users, items = start_factors(train, "user", d + 1, seed, 0.2), start_factors(train, "item", d + 1, seed, 0.2)
    implicit = start_factors(train, "item", d, seed + 1, 0.2)

    def combined() -> DataFrame:
        rows = train.join(implicit.toDF("item", "y"), "item").select(F.col("user").alias("id"), "y")
        sums = grouped_vector_sum(rows, "id", lambda b: np.concatenate((matrix(b.column("y")), np.ones((b.num_rows, 1))), axis=1))
        both = users.join(sums, "id")
        return written(map_rows(both, ["id"], ["f", "total"], lambda f, t: np.concatenate((f[:, :-1] + t[:, :-1] / np.sqrt(t[:, -1:]), f[:, -1:]), axis=1), "f"), "combined")

    for _ in range(epochs):
        whole = combined()
        moved, items_new = _step(train, whole, items, mean, True, gamma, lam)
        both = users.join(whole.toDF("id", "w"), "id").join(moved.toDF("id", "m"), "id")
        change = written(map_rows(both, ["id"], ["w", "m"], lambda w, m: m - w, "c"), "change")
        users_new = written(map_rows(users.join(change, "id"), ["id"], ["f", "c"], lambda f, c: f + c, "f"), "factors")
        # The implicit factors share the users' change, over sqrt(n).
        n = train.groupBy("user").agg(F.count("*").alias("n"))
        rows = train.join(change.toDF("user", "c"), "user").join(n, "user").select(F.col("item").alias("id"), "c", F.col("n").cast("double").alias("n"))
        sums = grouped_vector_sum(rows, "id", lambda b: np.concatenate((matrix(b.column("c"))[:, :-1] / np.sqrt(b.column("n").to_numpy())[:, None], np.ones((b.num_rows, 1))), axis=1))
        implicit = written(map_rows(implicit.join(sums, "id"), ["id"], ["f", "total"], lambda f, t: f + t[:, :-1] / t[:, -1:], "f"), "implicit")
        users, items = users_new, items_new
        gamma *= decay
    return Model(combined(), items, mean, "bias", implicit)


def nmf(ratings: DataFrame, d: int = D, iterations: int = 5, seed: int = 0, floor: float = 1e-12) -> Model:
    """Non-negative factors by multiplicative updates, users and items in turn. Negative training ratings are an error."""
    train = written(training(ratings).select("user", "item", F.when(F.col("rating") < 0, F.raise_error(F.lit("a rating is negative"))).otherwise(F.col("rating")).cast("double").alias("rating")), "train")
    users, items = start_factors(train, "user", d, seed, 1.0, True), start_factors(train, "item", d, seed, 1.0, True)

    def half(mine: DataFrame, theirs: DataFrame, key: str, other: str) -> DataFrame:
        total = np.array(theirs.agg(*(F.sum(F.col("f")[i]) for i in range(d))).first(), float)
        rows = train.select(F.col(key).cast("long").alias("id"), F.col(other).alias("o"), "rating").join(mine, "id").join(theirs.toDF("o", "g"), "o").select("id", "f", "g", "rating")

        def features(b: pa.RecordBatch) -> np.ndarray:
            f, g, r = matrix(b.column("f")), matrix(b.column("g")), b.column("rating").to_numpy()
            return g * (r / np.maximum((f * g).sum(axis=1), floor))[:, None]

        sums = grouped_vector_sum(rows, "id", features)
        return written(map_rows(mine.join(sums, "id"), ["id"], ["f", "total"], lambda f, t: np.maximum(f * t / np.maximum(total, floor), floor), "f"), "factors")

    for _ in range(iterations):
        users = half(users, items, "user", "item")
        items = half(items, users, "item", "user")
    return Model(users, items)


def ccd(ratings: DataFrame, d: int = 5, iterations: int = 2, lam: float = 0.01, seed: int = 0) -> Model:
    """Coordinate descent by rank-one updates of the residuals, one latent dimension after the other."""
    residual = written(training(ratings).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("e")), "residual")
    users = start_factors(residual, "user", d, seed, 0.0)
    items = start_factors(residual, "item", d, seed, 0.5, True)
    for it in range(iterations):
        for k in range(d):
            u, v = users.select(F.col("id").alias("user"), F.col("f")[k].alias("u")), items.select(F.col("id").alias("item"), F.col("f")[k].alias("v"))
            rows = residual.join(u, "user").join(v, "item").withColumn("t", F.col("e") + F.col("u") * F.col("v"))
            rows = written(rows.select("user", "item", "t", "v"), "rows")
            new_u = written(rows.groupBy("user").agg((F.sum(F.col("t") * F.col("v")) / (F.lit(lam) + F.sum(F.col("v") * F.col("v")))).alias("u")), "u")
            new_v = written(rows.join(new_u, "user").groupBy("item").agg((F.sum(F.col("t") * F.col("u")) / (F.lit(lam) + F.sum(F.col("u") * F.col("u")))).alias("v")), "v")
            residual = written(rows.drop("v").join(new_u, "user").join(new_v, "item").select("user", "item", (F.col("t") - F.col("u") * F.col("v")).alias("e")), "residual")
            put = lambda f, x: F.transform(f, lambda y, i: F.when(i == k, x).otherwise(y))
            users = written(users.join(new_u.toDF("id", "x"), "id").select("id", put(F.col("f"), F.col("x")).alias("f")), "factors")
            items = written(items.join(new_v.toDF("id", "x"), "id").select("id", put(F.col("f"), F.col("x")).alias("f")), "factors")
    return Model(users, items)


# -- the rest ----------------------------------------------------------------------------------------------------------
def drawn_slots(users: np.ndarray, n: int, draws: int, seed: int) -> np.ndarray:
    """The places below n that each user (row) draws, in order; several may be the same."""
    return np.sort((mixed_numbers(users, np.arange(1, draws + 1), seed) % n).astype(np.int32), axis=1)


def _drawn_pairs(ratings: DataFrame, listed: np.ndarray, draws: int, seed: int) -> DataFrame:
    """(user, item): what each user draws from the sorted items without those that it rated. The pairs, many times the ratings,
    are made where the users' ratings have been gathered, and not moved."""
    sent = ratings.sparkSession.sparkContext.broadcast(listed)
    rated = ratings.filter("user IS NOT NULL").groupBy("user").agg(F.collect_set("item").alias("rated"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, step = sent.value, max(1, 65_536 // draws)
        n = len(items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                users, known = b.column("user").to_numpy(), b.column("rated")
                cells = drawn_slots(users, n, draws, seed) + (np.arange(len(users)) * n)[:, None]
                keep = np.ones(cells.shape, bool)
                keep[:, 1:] = cells[:, 1:] != cells[:, :-1]
                cells = cells[keep]
                given = np.repeat(np.arange(len(users)), known.value_lengths().to_numpy()) * n + np.searchsorted(items, known.flatten().to_numpy())
                place = np.minimum(np.searchsorted(cells, given), len(cells) - 1)
                cells = np.delete(cells, place[cells[place] == given])
                row = cells // n
                yield pa.RecordBatch.from_arrays([pa.array(users[row]), pa.array(items[cells - row * n])], ["user", "item"])

    return rated.select(F.col("user").cast("long"), F.col("rated").cast("array<long>")).mapInArrow(pairs, "user long, item long")


def implicit_ratings(ratings: DataFrame, fraction: float, value: float, weight: float = 1.0, seed: int = 0) -> DataFrame:
    """``ratings`` with about fraction * users * items random (user, item) rows of a constant value, none rated already.

    Each user draws its share of items by hash; there is no product of all users and items. Up to BROADCAST_ROWS items, the
    drawn rows aren't shuffled either.
    """
    listed = ratings.filter("item IS NOT NULL").select("item").distinct()
    n = listed.count()
    if not n:
        return ratings
    draws = max(1, round(fraction * n))
    if n <= BROADCAST_ROWS and isinstance(ratings.schema["item"].dataType, IntegralType):
        items = np.sort(listed.select(F.col("item").cast("long")).toArrow()["item"].to_numpy())  # counted
        extra = _drawn_pairs(ratings, items, draws, seed).select(*(F.col(c).cast(ratings.schema[c].dataType) for c in ("user", "item")))
    else:
        from weftgraph.sources.graphs import numbered

        users = ratings.filter("user IS NOT NULL").select("user").distinct()
        slots = numbered(listed, "item", "place").select("item", (F.col("place") - 1).alias("slot"))
        drawn = users.select("user", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("k")).select("user", F.pmod(mixed(F.col("user"), F.col("k"), seed), F.lit(n)).alias("slot")).distinct()
        # Sizes of compressed tables are no bound for a broadcast.
        extra = drawn.join(slots.hint("merge"), "slot").select("user", "item").join(ratings.select("user", "item").distinct().hint("merge"), ["user", "item"], "left_anti")
    made = extra.withColumns({"rating": F.lit(float(value)), "weight": F.lit(float(weight)), "role": F.lit("train")})
    return (ratings if "weight" in ratings.columns else ratings.withColumn("weight", F.lit(1.0))).unionByName(made, allowMissingColumns=True)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each entry of a column of arrays, and the entries."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _present(cells: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The first places in the sorted ``cells`` of those ``given`` that are among them."""
    place = np.minimum(np.searchsorted(cells, given), max(0, len(cells) - 1))
    return place[cells[place] == given] if len(cells) else place[:0]


def _add_products(a: np.ndarray, y: np.ndarray, c: np.ndarray, at: np.ndarray, f: np.ndarray, pick: np.ndarray, r: np.ndarray | float, w: np.ndarray | float) -> None:
    """To the normal equations of each row named in the sorted ``at``: what the factors picked for it add."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, int)
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        g, s = f[pick[i:j]], at[i]
        if isinstance(w, float):
            a[s] += w * (g.T @ g)
            y[s] += w * r * g.sum(axis=0)
        else:
            v = g * w[i:j, None]
            a[s] += v.T @ g
            y[s] += r[i:j] @ v
        c[s] += j - i


def _solved(a: np.ndarray, y: np.ndarray, c: np.ndarray, lam: float, scaled: bool) -> np.ndarray:
    return np.linalg.solve(a + (lam * (c if scaled else np.ones_like(c)))[:, None, None] * np.eye(a.shape[1]), y[:, :, None])[:, :, 0]


#: Factors of the items are sent to every task: at most this many numbers.
MOST_NUMBERS = 5_000_000


def als_implicit(ratings: DataFrame, fraction: float, value: float, weight: float, d: int = D, iterations: int = 5, lam: float = 0.01, scaled: bool = True, seed: int = 0) -> Iterator[Model]:
    """The models of ``als_rounds`` over ``implicit_ratings``. A model's tables last until the next is asked for.

    The drawn pairs are nowhere kept: they are drawn again for each half of a round, users' beside their ratings, items' by
    tasks of a block of items each that read the users' table as a stream.
    """
    listed = ratings.filter("item IS NOT NULL").select("item").distinct()
    n = listed.count()
    if not 0 < n * d <= MOST_NUMBERS or n > BROADCAST_ROWS or not isinstance(ratings.schema["item"].dataType, IntegralType):
        yield from als_rounds(implicit_ratings(ratings, fraction, value, weight, seed), d, iterations, lam, scaled=scaled, seed=seed)
        return
    spark, draws = ratings.sparkSession, max(1, round(fraction * n))
    begun = start_factors(ratings, "item", d, seed, 1.0, positive=True)
    first = begun.orderBy("id").toArrow()  # counted
    items, factors = first["id"].to_numpy(), matrix(first["f"])
    row_weight = F.col("weight").cast("double") if "weight" in ratings.columns else F.lit(1.0)
    used = F.when((F.col("role") == "train") & F.col("item").isNotNull() & F.col("rating").isNotNull(), F.struct(F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("r"), row_weight.alias("w")))
    given = ratings.filter("user IS NOT NULL").groupBy(F.col("user").cast("long").alias("id")).agg(F.collect_set(F.col("item").cast("long")).alias("rated"), F.collect_list(used).alias("t"))
    given = written(given.select("id", "rated", F.col("t.item").alias("ti"), F.col("t.r").alias("tr"), F.col("t.w").alias("tw")), "given")
    kept, schema = ["rated", "ti", "tr", "tw"], "id long, f array<double>, rated array<long>, ti array<long>, tr array<double>, tw array<double>"
    numbers, step = np.arange(1, draws + 1), max(1, 65_536 // draws)
    at_once = spark.sparkContext.defaultParallelism
    blocks = min(n, -(-n * d * d // (at_once * 10_000_000)) * at_once)
    users: DataFrame | None = None
    for _ in range(iterations):
        if users is not None:
            forget(users)
        sent = spark.sparkContext.broadcast((items, factors))

        def user_half(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, f = sent.value
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    b = whole.slice(start, step)
                    slots = drawn_slots(b.column("id").to_numpy(), n, draws, seed)
                    cells = slots + (np.arange(len(slots)) * n)[:, None]
                    keep = np.ones(cells.shape, bool)
                    keep[:, 1:] = cells[:, 1:] != cells[:, :-1]
                    row, item = _flat(b.column("rated"))
                    keep.ravel()[_present(cells.ravel(), row * n + np.searchsorted(names, item))] = False
                    g = f[slots]
                    g[~keep] = 0.0
                    a, y, c = weight * (g.transpose(0, 2, 1) @ g), weight * value * g.sum(axis=1), keep.sum(axis=1).astype(float)
                    row, item = _flat(b.column("ti"))
                    _add_products(a, y, c, row, f, np.searchsorted(names, item), _flat(b.column("tr"))[1], _flat(b.column("tw"))[1])
                    some = np.flatnonzero(c)
                    out = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([out.column("id"), arrays(_solved(a[some], y[some], c[some], lam, scaled)), *(out.column(k) for k in kept)], ["id", "f", *kept])

        users = written(given.mapInArrow(user_half, schema), "users")
        path, names_sent = users._weft_path, sent

        def item_half(batches: Iterator[pa.RecordBatch], path=path, sent=names_sent) -> Iterator[pa.RecordBatch]:
            names = sent.value[0]
            for block in (x for b in batches for x in b.column("id").to_pylist()):
                low, high = block * n // blocks, (block + 1) * n // blocks
                a, y, c = np.zeros((high - low, d, d)), np.zeros((high - low, d)), np.zeros(high - low)
                for b in read_batches(path, min(65_536, max(1, 4_000_000 * blocks // draws))):
                    users, f, found = b.column("id").to_numpy(), matrix(b.column("f")), []
                    size = len(users)
                    for start in range(0, size, step):
                        x = mixed_numbers(users[start : start + step], numbers, seed) % n
                        r, q = np.nonzero((x >= low) & (x < high))
                        found.append((x[r, q] - low) * size + r + start)
                    cells = np.sort(np.concatenate(found))
                    cells = cells[np.concatenate(([True], cells[1:] != cells[:-1]))] if len(cells) else cells
                    row, item = _flat(b.column("rated"))
                    slot = np.searchsorted(names, item)
                    mine = (slot >= low) & (slot < high)
                    cells = np.delete(cells, _present(cells, (slot[mine] - low) * size + row[mine]))
                    slot = cells // size
                    _add_products(a, y, c, slot, f, cells - slot * size, value, weight)
                    row, item = _flat(b.column("ti"))
                    slot = np.searchsorted(names, item)
                    mine = np.flatnonzero((slot >= low) & (slot < high))
                    mine = mine[np.argsort(slot[mine], kind="stable")]
                    _add_products(a, y, c, slot[mine] - low, f, row[mine], _flat(b.column("tr"))[1][mine], _flat(b.column("tw"))[1][mine])
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(names[low + some]), arrays(_solved(a[some], y[some], c[some], lam, scaled))], ["id", "f"])

        found = written(spark.range(0, blocks, 1, blocks).mapInArrow(item_half, "id long, f array<double>"), "factors")
        yield Model(users.select("id", "f"), found, few_items=True)
        new = found.toArrow()
        factors = factors.copy()
        factors[np.searchsorted(items, new["id"].to_numpy())] = matrix(new["f"])


def adpredictor(clicks: DataFrame, iterations: int = 1, beta: float = 1.0, prior_variance: float = 1.0) -> DataFrame:
    """(feature, mu, sigma2): probit regression on binary features by message passing; clicks: (row_id, label, feature), label +1 or -1,
    the same in all of a row (else +1 holds).

    Each iteration sums means and variances per row and then combines the rows' corrections per feature, all at once.
    """
    clicks = written(clicks.groupBy("row_id", "feature").agg(F.max(F.col("label").cast("double")).alias("label")), "clicks")
    state = clicks.select("feature").distinct().withColumns({"mu": F.lit(0.0), "s2": F.lit(float(prior_variance))})
    for _ in range(iterations):
        rows = clicks.join(state, "feature").groupBy("row_id").agg(F.max("label").alias("label"), F.sum("mu").alias("m"), (F.sum("s2") + beta * beta).alias("s"))
        t = F.col("label") * F.col("m") / F.sqrt("s")
        # v = density / distribution of the standard normal at t, w = v (v + t); fixed values: the published coefficients of
        # an approximation of erfc (error below 2e-7).
        x = F.abs(t) / F.sqrt(F.lit(2.0))
        k = 1 / (1 + 0.3275911 * x)
        erfc = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-x * x)
        phi = F.when(t < 0, erfc / 2).otherwise(1 - erfc / 2)
        v = F.exp(-t * t / 2) / F.sqrt(F.lit(2 * np.pi)) / F.greatest(phi, F.lit(1e-12))
        scored = rows.select("row_id", "label", "s", v.alias("v"), (v * (v + t)).alias("w"))
        touched = clicks.select("row_id", "feature").join(scored, "row_id").join(state, "feature")
        moves = touched.groupBy("feature").agg(
            F.sum(F.col("label") * F.col("s2") / F.sqrt("s") * F.col("v")).alias("dm"),
            F.product(F.greatest(F.lit(1e-6), 1 - F.col("s2") / F.col("s") * F.col("w"))).alias("ds"),
        )
        state = written(state.join(moves, "feature").select("feature", (F.col("mu") + F.col("dm")).alias("mu"), F.greatest(F.lit(1e-9), F.col("s2") * F.col("ds")).alias("s2")), "state")
    return state.select("feature", "mu", F.col("s2").alias("sigma2"))


def synthetic_ratings(spark, users: int, items: int, d: int = 3, per_user: int = 10, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """(user, item, rating, role) from hidden factors; a tenth of the rows is for validation."""
    cells = spark.range(users).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(0), F.lit(per_user - 1))).alias("k")).select("user", F.pmod(F.xxhash64("user", "k", F.lit(seed)), F.lit(items)).alias("item")).distinct()
    dims = F.sequence(F.lit(0), F.lit(d - 1))
    truth = F.aggregate(F.transform(dims, lambda k: hashed(F.col("user"), "u", seed, k) * hashed(F.col("item"), "i", seed, k)), F.lit(0.0), lambda a, x: a + x)
    role = F.when(hashed(F.col("user"), F.col("item"), seed) < 0.1, "validate").otherwise("train")
    return cells.select("user", "item", (truth * 4 / d + 1 + noise * (hashed(F.col("user"), F.col("item"), seed, 1) - 0.5)).alias("rating"), role.alias("role"))
