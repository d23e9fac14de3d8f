"""Algebra of log-space factor tables: rows (scope, sizes, logp), assignments with the last variable fastest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Table:
    scope: tuple[int, ...]
    logp: np.ndarray

    def _spread(self, scope: tuple[int, ...]) -> np.ndarray:
        order = [self.scope.index(v) for v in scope if v in self.scope]
        t = np.transpose(self.logp, order)
        return t.reshape([self.logp.shape[self.scope.index(v)] if v in self.scope else 1 for v in scope])

    def _with(self, other: Table, op: object) -> Table:
        scope = self.scope + tuple(v for v in other.scope if v not in self.scope)
        return Table(scope, op(self._spread(scope), other._spread(scope)))

    def __mul__(self, other: Table) -> Table:
        return self._with(other, np.add)

    def __truediv__(self, other: Table) -> Table:
        return self._with(other, np.subtract)

    def __add__(self, other: Table) -> Table:
        return self._with(other, np.logaddexp)

    def normalize(self) -> Table:
        m = self.logp.max()
        return Table(self.scope, self.logp - m - np.log(np.exp(self.logp - m).sum()))

    def shift_normalize(self) -> Table:
        return Table(self.scope, self.logp - self.logp.max())

    def marginalize(self, keep: tuple[int, ...], maximum: bool = False) -> Table:
        axes = tuple(i for i, v in enumerate(self.scope) if v not in keep)
        m = self.logp.max()
        t = self.logp.max(axis=axes) if maximum else np.log(np.exp(self.logp - m).sum(axis=axes)) + m
        return Table(tuple(v for v in self.scope if v in keep), t)

    def condition(self, values: dict[int, int]) -> Table:
        index = tuple(values.get(v, slice(None)) for v in self.scope)
        return Table(tuple(v for v in self.scope if v not in values), self.logp[index])

    def convolve(self, message: Table) -> Table:
        """The product with a message, summed over the message's variables."""
        return (self * message).marginalize(tuple(v for v in self.scope if v not in message.scope))

    def damp(self, old: Table, damping: float) -> Table:
        return Table(self.scope, (1 - damping) * self.logp + damping * old._spread(self.scope))

    def l1_diff(self, other: Table) -> float:
        return float(np.abs(np.exp(self.logp) - np.exp(other._spread(self.scope))).sum())

    def expectation(self) -> np.ndarray:
        p = np.exp(self.normalize().logp)
        return np.array([(p.sum(axis=tuple(j for j in range(p.ndim) if j != i)) * np.arange(n)).sum() for i, n in enumerate(p.shape)])

    def best(self) -> tuple[int, ...]:
        return tuple(int(i) for i in np.unravel_index(self.logp.argmax(), self.logp.shape))

    def sample(self, u: float) -> tuple[int, ...]:
        p = np.exp(self.normalize().logp).ravel().cumsum()
        return tuple(int(i) for i in np.unravel_index(min(int(np.searchsorted(p, u * p[-1])), len(p) - 1), self.logp.shape))


def agreement(scope: tuple[int, int], size: int, penalty: float) -> Table:
    """0 where the two variables agree, -penalty elsewhere."""
    return Table(scope, np.where(np.eye(size, dtype=bool), 0.0, -penalty))


def laplace(scope: tuple[int, int], size: int, penalty: float) -> Table:
    """-penalty times the distance of the two states."""
    i = np.arange(size)
    return Table(scope, -penalty * np.abs(i[:, None] - i[None, :]).astype(float))


@dataclass(frozen=True)
class SparseTable:
    """A factor of few assignments: ``logp`` by assignment (a tuple of states in the order of the scope); all others are
    impossible (-inf)."""

    scope: tuple[int, ...]
    sizes: tuple[int, ...]
    logp: dict[tuple[int, ...], float]

    @staticmethod
    def of(table: Table) -> SparseTable:
        cells = {tuple(map(int, i)): float(table.logp[tuple(i)]) for i in np.argwhere(np.isfinite(table.logp))}
        return SparseTable(table.scope, table.logp.shape, cells)

    def dense(self) -> Table:
        out = np.full(self.sizes, -np.inf)
        for x, v in self.logp.items():
            out[x] = v
        return Table(self.scope, out)

    def _with(self, other: SparseTable, sign: int) -> SparseTable:
        """Joined on the common variables; dividing by an impossible assignment leaves it impossible."""
        shared = [v for v in other.scope if v in self.scope]
        fresh = [i for i, v in enumerate(other.scope) if v not in self.scope]
        by: dict[tuple[int, ...], list[tuple[tuple[int, ...], float]]] = {}
        for y, v in other.logp.items():
            by.setdefault(tuple(y[other.scope.index(u)] for u in shared), []).append((tuple(y[i] for i in fresh), v))
        own = [self.scope.index(u) for u in shared]
        cells = {x + rest: a + sign * b for x, a in self.logp.items() for rest, b in by.get(tuple(x[i] for i in own), ())}
        return SparseTable(self.scope + tuple(other.scope[i] for i in fresh), self.sizes + tuple(other.sizes[i] for i in fresh), cells)

    def __mul__(self, other: SparseTable) -> SparseTable:
        return self._with(other, 1)

    def __truediv__(self, other: SparseTable) -> SparseTable:
        return self._with(other, -1)

    def normalize(self) -> SparseTable:
        values = np.array(list(self.logp.values()))
        total = values.max() + np.log(np.exp(values - values.max()).sum())
        return SparseTable(self.scope, self.sizes, {x: v - float(total) for x, v in self.logp.items()})

    def marginalize(self, keep: tuple[int, ...], maximum: bool = False) -> SparseTable:
        places = [i for i, v in enumerate(self.scope) if v in keep]
        out: dict[tuple[int, ...], float] = {}
        for x, v in self.logp.items():
            key = tuple(x[i] for i in places)
            out[key] = v if key not in out else max(out[key], v) if maximum else float(np.logaddexp(out[key], v))
        return SparseTable(tuple(self.scope[i] for i in places), tuple(self.sizes[i] for i in places), out)

    def condition(self, values: dict[int, int]) -> SparseTable:
        fixed = {self.scope.index(v): s for v, s in values.items() if v in self.scope}
        places = [i for i in range(len(self.scope)) if i not in fixed]
        cells = {tuple(x[i] for i in places): v for x, v in self.logp.items() if all(x[i] == s for i, s in fixed.items())}
        return SparseTable(tuple(self.scope[i] for i in places), tuple(self.sizes[i] for i in places), cells)

    def best(self) -> tuple[int, ...]:
        return max(self.logp, key=lambda x: (self.logp[x], tuple(-s for s in x)))
