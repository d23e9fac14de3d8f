"""Leading eigenvectors of the normalised matrix of a graph, in one process: blocked adjacency, band Lanczos with a filter."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Rows of a block of the adjacency: what is read and added at once stays in the cache.
BLOCK = 8_192
#: A filter raises the values above a gap over the rest by so much times the root of the dimension, by a polynomial of at most
#: this degree; so many vectors are filtered in one pass.
RAISED, MOST_DEGREE, TOGETHER = 2e4, 30, 8


class Adjacency:
    """x -> D^-1/2 W D^-1/2 x + x for edges between the numbers below ``n``, each an end at least once; ``w`` None: all alike.

    In each block rows are ordered by their number of entries, so that the q-th entries of its rows are added in one step.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None):
        counts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        order = np.lexsort((-counts, np.arange(n) // BLOCK))
        #: The place of each number in the order of the vectors.
        self.n, self.place = n, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        a, b = self.place[a], self.place[b]
        counts, values = counts[order], None
        if w is None:
            cols = np.concatenate((a, b))
            cols *= n
            cols[: len(a)] += b
            cols[len(a) :] += a
            cols.sort()
            cols %= n
            degree = counts.astype(float)
        else:
            rows, values = np.concatenate((a, b)), np.concatenate((w, w))
            degree = np.bincount(rows, values, minlength=n)
            by = np.argsort(rows, kind="stable")
            del rows
            values, cols = values[by], np.concatenate((b, a))[by]
            del by
        del a, b
        self.scale = 1 / np.sqrt(degree)
        begin = np.cumsum(counts) - counts
        self.blocks: list[tuple[int, list]] = []
        for first in range(0, n, BLOCK):
            c, at = counts[first : first + BLOCK], begin[first : first + BLOCK]
            # How many rows of the block have more than q entries.
            more = len(c) - np.cumsum(np.bincount(c))
            slots = [at[:m] + q for q, m in enumerate(more[:-1])]
            self.blocks.append((first, [(cols[s], None if values is None else values[s]) for s in slots]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Of a vector, or of the columns of a matrix in one pass; in the precision of ``x``."""
        scale = self.scale.astype(x.dtype).reshape(-1, *[1] * (x.ndim - 1))
        z, y, t = scale * x, np.zeros_like(x), np.empty((BLOCK, *x.shape[1:]), x.dtype)
        for first, slots in self.blocks:
            for cols, values in slots:
                m = len(cols)
                z.take(cols, axis=0, out=t[:m], mode="wrap")
                if values is not None:
                    t[:m] *= values.astype(x.dtype).reshape(-1, *[1] * (x.ndim - 1))
                y[first : first + m] += t[:m]
        y *= scale
        y += x
        return y


class Filter:
    """The Chebyshev polynomial of the operator on [0, low], as 1 at ``high``: it damps what lies below ``low``."""

    def __init__(self, multiply: Callable[[np.ndarray], np.ndarray], low: float, high: float, degree: int):
        self.multiply, self.low, self.high, self.degree = multiply, float(low), float(high), degree

    def _x(self, value: float) -> float:
        return max(1.0, 2 * value / self.low - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # Each term is scaled by its value at the upper end, which keeps numbers near 1.
        top = self._x(self.high)
        ratio = 1 / top
        before, now = x, (self.multiply(x) * (2 / self.low) - x) * ratio
        for _ in range(self.degree - 1):
            following = 1 / (2 * top - ratio)
            made = self.multiply(now)
            made *= 2 / self.low
            made -= now
            made *= 2 * following
            made -= (ratio * following) * before
            before, now, ratio = now, made, following
        return now


def _independent(basis: np.ndarray, m: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """y becomes row m of a basis, if it has a direction of its own: its parts along the rows before, and the length left."""
    whole = length = float(np.linalg.norm(y))
    dots = np.zeros(m)
    for _ in range(4):
        if length <= 1e-13 * whole:
            return dots, 0.0
        before, part = length, basis[:m] @ y
        y = y - part @ basis[:m]
        dots, length = dots + part, float(np.linalg.norm(y))
        if length > 0.7 * before:
            break
    basis[m] = y / length
    return dots, length


def _ritz(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a projection, from the largest."""
    values, s = np.linalg.eigh((t + t.T) / 2)
    return values[::-1], s[:, ::-1]


def _combine(basis: np.ndarray, m: int, s: np.ndarray) -> None:
    """The first rows of a basis become combinations of its first m, in pieces so that no second basis is needed."""
    for a in range(0, basis.shape[1], BLOCK):
        basis[: s.shape[1], a : a + BLOCK] = s.T @ basis[:m, a : a + BLOCK]


def leading(multiply: Callable[[np.ndarray], np.ndarray], n: int, k: int, size: int, seed: int = 0, tol: float = 1e-8, max_steps: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals |A u - s u|, products): the ``k`` largest eigenvalues of a symmetric operator on n numbers
    without negative ones.

    Band Lanczos from k random vectors, so that a value that comes up to k times is found as often; each new vector is
    orthogonal to all before, and at ``size`` vectors it is restarted with Ritz vectors. If the first round leaves a wide gap below
    a cluster of values, the whole space above the gap is taken by filtered random vectors, where it fits ``size``. It ends when
    each residual is at most ``tol`` times the value, and it is an error if that isn't reached after ``max_steps`` products.
    """
    k = min(k, n)
    size = max(size, 4 * k + 12)
    basis, h = np.empty((size + 1, n)), np.zeros((size + 1, size + 1))
    draws = np.random.default_rng(seed)
    spent = m = done = 0

    def checked(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """The result, if the operator's own residuals are small enough."""
        nonlocal spent
        images = [multiply(u) for u in vectors]
        spent += len(vectors)
        own = np.array([u @ y for u, y in zip(vectors, images)])
        residuals = np.array([np.linalg.norm(y - o * u) for u, y, o in zip(vectors, images, own)])
        by = np.argsort(-own, kind="stable")
        return (own[by], vectors[by], residuals[by], spent) if np.all(residuals <= np.maximum(tol * own, 1e-13 * own.max())) else None

    def budget() -> None:
        if spent >= max_steps:
            raise RuntimeError(f"eigenvalues not converged after {spent} products")

    def above(f: Filter, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """The result from the space of all values above the filter's gap, or nothing where they don't fit; the basis begins
        with so many Ritz vectors before, and with k at least afterwards."""
        nonlocal spent
        while True:
            # What is left of the damped values in those wanted is taken away; without a cluster that is all.
            x = np.linalg.qr(f(np.ascontiguousarray(basis[:k].T)))[0]
            spent += k * (f.degree + 1)
            if found := checked((x @ _ritz(x.T @ multiply(x))[1]).T):
                return found
            t, m, at = np.zeros((size, size)), 0, 0
            while True:
                budget()
                c = min(TOGETHER, size - m, first - at if at < first else size)
                # Single precision does: what rounding leaves of the damped values counts by its square.
                x = basis[at : at + c].T if at < first else draws.uniform(-0.5, 0.5, (n, c))
                y, before, at = f(x.astype(np.float32, order="C")), m, at + c
                for q in range(c):
                    m += _independent(basis, m, y[:, q].astype(float))[1] > 0
                if m > before:
                    t[:m, before:m] = basis[:m] @ multiply(np.ascontiguousarray(basis[before:m].T))
                    t[before:m, :m] = t[:m, before:m].T
                spent += c * f.degree + m - before
                values, s = _ritz(t[:m, :m])
                whole = at >= first and (m == before or values[-2:].max() <= f.low)
                if whole or m == size:
                    break
            _combine(basis, m, s)
            if not whole:
                return None
            first = max(k, int((values > f.low).sum()))

    for _ in range(k):
        m += _independent(basis, m, draws.uniform(-0.5, 0.5, n))[1] > 0
    first = True
    while True:
        # Pending vectors are multiplied in turn.
        enough = min(size, 48) if first else size
        while done < m < enough:
            budget()
            dots, length = _independent(basis, m, multiply(basis[done]))
            h[:m, done] = dots
            if length:
                h[m, done] = length
                m += 1
            spent, done = spent + 1, done + 1
            if done % 4 == 0 and done >= k:
                values, s = _ritz(h[:done, :done])
                if np.all(np.linalg.norm(h[done:m, :done] @ s[:, :k], axis=0) <= 0.5 * tol * values[:k]):
                    break
        if done == 0:
            return np.zeros(0), np.zeros((0, n)), np.zeros(0), spent
        values, s = _ritz(h[:done, :done])
        found, exact = min(k, done), done == m
        result = checked(s[:, :found].T @ basis[:done])
        if result:
            return result
        if exact:
            raise RuntimeError("an invariant space without convergence")
        if first and done > found + 2:
            # The widest gap: values close to those wanted stay above it.
            ends = values[found - 1 : found + (done - found) // 2 + 1]
            count = found + int(np.argmax(ends[:-1] - ends[1:]))
            low = values[count]
            reach = math.acosh(2 * values[count - 1] / low - 1) if 0 < low < values[count - 1] else 0.0
            degree = math.ceil(math.acosh(RAISED * math.sqrt(n)) / reach) if reach else MOST_DEGREE + 1
            if degree <= MOST_DEGREE:
                _combine(basis, done, s[:, :count])
                result = above(Filter(multiply, low, values[0], degree), count)
                if result:
                    return result
                # On from the best of them, which are begun with as they are.
                h[:], m, done, first = 0.0, k, 0, False
                continue
        first = False
        kept, pending = min(done - 1, found + (done - found) // 2), m - done
        coupling = h[done:m, :done] @ s[:, :kept]
        _combine(basis, done, s[:, :kept])
        basis[kept : kept + pending] = basis[done:m]
        h[:] = 0.0
        h[:kept, :kept] = np.diag(values[:kept])
        h[kept : kept + pending, :kept] = coupling
        done, m = kept, kept + pending
