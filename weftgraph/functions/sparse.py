"""Sparse recovery for use inside batches."""

from __future__ import annotations

import numpy as np


def cosamp(a: np.ndarray, y: np.ndarray, k: int, iterations: int = 10, tol: float = 1e-4) -> np.ndarray:
    """The vector of at most k non-zero entries that best solves a x = y, by compressive sampling matching pursuit."""
    n = a.shape[1]
    x, rest = np.zeros(n), y.astype(float)
    for _ in range(iterations):
        proxy = a.T @ rest
        strongest = np.argsort(-np.abs(proxy), kind="stable")[: 2 * k]
        support = np.union1d(strongest, np.flatnonzero(x)).astype(int)
        fit, *_ = np.linalg.lstsq(a[:, support], y, rcond=None)
        best = np.argsort(-np.abs(fit), kind="stable")[:k]
        x = np.zeros(n)
        x[support[best]] = fit[best]
        rest = y - a @ x
        if np.linalg.norm(rest) < tol:
            break
    return x
