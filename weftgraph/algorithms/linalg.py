"""Sparse linear algebra on coordinate frames: matrices (i, j, v), vectors (i, v)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.algorithms.analytics import hashed
from weftgraph.session import BROADCAST_ROWS, forget, written


def matvec(a: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """A x (or the transpose's product); rows without entries are left out."""
    row, col = ("j", "i") if transpose else ("i", "j")
    side = x.select(F.col("i").alias(col), F.col("v").alias("x"))
    return a.join(side, col).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def axb(a: DataFrame, x: DataFrame, y: DataFrame, c: float = 1.0, d: float = 0.0, div: float = 1.0, transpose: bool = False) -> DataFrame:
    """(c A x + d y) / div over the rows of ``y``."""
    product = matvec(a, x, transpose).withColumnRenamed("v", "p")
    return y.join(product, "i", "left").select("i", ((F.lit(c) * F.coalesce("p", F.lit(0.0)) + F.lit(d) * F.col("v")) / div).alias("v"))


def jacobi(a: DataFrame, b: DataFrame, iterations: int = 10) -> DataFrame:
    """(i, x) after so many sweeps x <- (b - (A - D) x) / D from x = 0. A diagonal that is missing or 0 makes a row NULL."""
    system = written(b.select("i", F.col("v").alias("b")).join(a.filter("i = j").select("i", F.col("v").alias("d")), "i", "left"), "system")
    off = written(a.filter("i <> j"), "off")
    x = b.select("i", F.lit(0.0).alias("v"))
    for k in range(iterations):
        product = matvec(off, x).withColumnRenamed("v", "p")
        x = system.join(product, "i", "left").select("i", F.try_divide(F.col("b") - F.coalesce("p", F.lit(0.0)), F.col("d")).alias("v"))
        if k % 4 == 3:
            x = written(x, "x")
    return x.withColumnRenamed("v", "x")


def residual_norm(a: DataFrame, x: DataFrame, b: DataFrame) -> float:
    """|A x - b|."""
    r = axb(a, x.toDF("i", "v"), b, 1.0, -1.0)
    return math.sqrt(r.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


class _Frames:
    """Golub-Kahan bases of a matrix too large for the driver: the vectors of a side ("u" or "v") are columns c0, c1, ... of
    a table; inner products and coefficients are all that reaches the driver."""

    def __init__(self, a: DataFrame, seed: int):
        self.a, self.seed = a, seed
        self.bases = {"u": a.select("i").distinct(), "v": a.select(F.col("j").alias("i")).distinct()}
        self.kept: dict[str, DataFrame] = {}

    def _keep(self, side: str, df: DataFrame) -> DataFrame:
        """Written; the table that was kept for that side before is deleted."""
        made, before = written(df, "step"), self.kept.get(side)
        if before is not None:
            forget(before)
        self.kept[side] = made
        return made

    def start(self) -> None:
        start = self.bases["v"].select("i", (hashed(F.col("i"), self.seed) - 0.5).alias("v"))
        self._add("v", start, 0, 0.0)

    def extend(self, side: str, n: int, tiny: float) -> float:
        """Column n of u from A times column n of v, or of v from the transpose times column n - 1 of u; its length before."""
        x = self.bases["v"].select("i", F.col(f"c{n}").alias("v")) if side == "u" else self.bases["u"].select("i", F.col(f"c{n - 1}").alias("v"))
        return self._add(side, matvec(self.a, x, transpose=side == "v"), n, tiny)

    def _add(self, side: str, product: DataFrame, n: int, tiny: float) -> float:
        both = self._keep(side, self.bases[side].join(product.withColumnRenamed("v", "y"), "i", "left").na.fill(0.0, ["y"]))
        y, length = F.col("y"), 0.0
        while True:
            dots = both.agg(F.sum(y * y).alias("yy"), *(F.sum(F.col(f"c{q}") * y).alias(f"d{q}") for q in range(n))).first()
            whole, along = dots["yy"] or 0.0, sum((dots[f"d{q}"] or 0.0) ** 2 for q in range(n))
            length = math.sqrt(max(0.0, whole - along))
            for q in range(n):
                y = y - F.lit(float(dots[f"d{q}"] or 0.0)) * F.col(f"c{q}")
            # Where little was left after taking away the old directions, rounding errors are taken away as well.
            if along <= 0.5 * whole or length <= tiny:
                break
        self.bases[side] = both.withColumn(f"c{n}", y / length if length > tiny else F.lit(0.0)).drop("y")
        return length

    def _combined(self, side: str, coefficients: np.ndarray) -> list:
        return [sum((F.lit(float(c)) * F.col(f"c{q}") for q, c in enumerate(column)), F.lit(0.0)) for column in coefficients.T]

    def restart(self, left: np.ndarray, right: np.ndarray) -> None:
        """The bases become these combinations of their columns; of v, the last column stays behind them."""
        n, k = left.shape
        for side, coefficients in (("u", left), ("v", right)):
            made = [c.alias(f"c{q}") for q, c in enumerate(self._combined(side, coefficients))]
            self.bases[side] = self._keep(side, self.bases[side].select("i", *made, *[F.col(f"c{n}").alias(f"c{k}")] * (side == "v")))

    def vectors(self, side: str, coefficients: np.ndarray) -> DataFrame:
        return self.bases[side].select("i", F.posexplode(F.array(*self._combined(side, coefficients))).alias("k", "v"))


class _Arrays:
    """The same for a matrix that was counted and is small: it and the bases are arrays of the driver."""

    def __init__(self, a: DataFrame, seed: int):
        entries = a.filter("i IS NOT NULL AND j IS NOT NULL").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"), (hashed(F.col("j"), seed) - 0.5).alias("s")).orderBy("i", "j", "v").toArrow()
        self.spark, self.kind = a.sparkSession, {"u": a.schema["i"].dataType, "v": a.schema["j"].dataType}
        ids, at = {}, {}
        for side, column in (("u", "i"), ("v", "j")):
            ids[side], at[side] = np.unique(entries[column].to_numpy(), return_inverse=True)
        self.ids, self.at, self.values = ids, at, entries["v"].to_numpy()
        self.first = np.zeros(len(ids["v"]))
        self.first[at["v"]] = entries["s"].to_numpy()
        self.bases = {side: np.zeros((len(x), 0)) for side, x in ids.items()}

    def start(self) -> None:
        self._add("v", self.first, 0.0)

    def extend(self, side: str, n: int, tiny: float) -> float:
        other = "v" if side == "u" else "u"
        x = self.bases[other][:, n if side == "u" else n - 1]
        return self._add(side, np.bincount(self.at[side], self.values * x[self.at[other]], len(self.ids[side])), tiny)

    def _add(self, side: str, y: np.ndarray, tiny: float) -> float:
        basis = self.bases[side]
        while True:
            whole = float(y @ y)
            dots = basis.T @ y
            y = y - basis @ dots
            length = math.sqrt(float(y @ y))
            if float(dots @ dots) <= 0.5 * whole or length <= tiny:
                break
        self.bases[side] = np.column_stack((basis, y / length if length > tiny else np.zeros_like(y)))
        return length

    def restart(self, left: np.ndarray, right: np.ndarray) -> None:
        u, v, n = self.bases["u"], self.bases["v"], len(left)
        self.bases = {"u": u @ left, "v": np.column_stack((v[:, :n] @ right, v[:, n]))}

    def vectors(self, side: str, coefficients: np.ndarray) -> DataFrame:
        x = self.bases[side][:, : len(coefficients)] @ coefficients
        n, k = x.shape
        rows = pa.table({"i": np.repeat(self.ids[side], k), "k": pa.array(np.tile(np.arange(k), n), pa.int32()), "v": x.ravel()})
        return self.spark.createDataFrame(rows).select(F.col("i").cast(self.kind[side]).alias("i"), "k", "v")


#: A matrix of at most so many entries (and BROADCAST_ROWS rows and columns) is decomposed on the driver.
SMALL_ENTRIES = 1_000_000


def svd(a: DataFrame, k: int, steps: int | None = None, seed: int = 0, tol: float = 1e-8, max_steps: int = 20_000, small: int = SMALL_ENTRIES) -> tuple[np.ndarray, DataFrame, DataFrame, np.ndarray]:
    """(values, U, V, residuals): the ``k`` largest singular values with vectors (i, k, v), by Golub-Kahan bidiagonalisation.

    Each new vector is orthogonalised against all before. When the bases hold ``steps`` vectors, they are restarted with the
    leading Ritz vectors, until all ``k`` residuals are at most ``tol`` times the value; it is an error if that isn't reached
    in ``max_steps``. residuals: |A' u - s v| for each value.
    """
    a = written(a.select("i", "j", F.col("v").cast("double").alias("v")), "matrix")
    entries, n_rows, n_cols = a.agg(F.count("*"), F.count_distinct("i"), F.count_distinct("j")).first()
    space = (_Arrays if entries <= small and n_rows + n_cols <= BROADCAST_ROWS else _Frames)(a, seed)
    size = max(1, min(n_cols, max(steps or k + 40, k + 2)))
    space.start()
    kept, spent, scale = 0, 0, 0.0
    s, coupling = np.zeros(0), np.zeros(0)
    while True:
        b = np.zeros((size, size))
        b[:kept, :kept] = np.diag(s[:kept])
        b[:kept, kept : kept + 1] = coupling[:, None]
        n, last = kept, 0.0
        while n < size:
            b[n, n] = alpha = space.extend("u", n, 1e-12 * scale)
            scale, n, spent, last = max(scale, alpha), n + 1, spent + 1, 0.0
            # Where no direction is left on either side, what was found is exact.
            if alpha <= 1e-12 * scale or n == n_cols:
                break
            last = space.extend("v", n, 1e-12 * scale)
            scale = max(scale, last)
            if last <= 1e-12 * scale:
                last = 0.0
                break
            if n < size:
                b[n - 1, n] = last
        left, s, right = np.linalg.svd(b[:n, :n])
        residuals, found = np.abs(last * left[-1]), min(k, n)
        if last == 0.0 or np.all(residuals[:found] <= np.maximum(tol * s[:found], 1e-13 * s[0])):
            return s[:found], space.vectors("u", left[:, :found]), space.vectors("v", right.T[:, :found]), residuals[:found]
        if spent >= max_steps:
            raise RuntimeError(f"singular values not converged after {spent} steps: residuals {residuals[:found].tolist()}")
        kept = min(n - 1, k + (n - k) // 3)
        coupling = last * left[-1, :kept]
        space.restart(left[:, :kept], right.T[:, :kept])
