"""Leading eigenvectors of a graph's normalised matrix in one task."""

import numpy as np
import pytest

from weftgraph.algorithms import cluster
from weftgraph.functions import eigen
from weftgraph.graph import Graph


def groups(n_groups: int, size: int, chained: bool, seed: int = 0) -> list[tuple[int, int]]:
    """Random graphs without an edge between them, or with one from each to the next."""
    draws, edges = np.random.default_rng(seed), []
    for g in range(n_groups):
        inner = draws.integers(0, size, (6 * size, 2)) + g * size
        ring = [(g * size + i, g * size + (i + 1) % size) for i in range(size)]
        edges += [*ring, *((int(a), int(b)) for a, b in inner if a != b)]
        edges += [(g * size - 1, g * size)] if chained and g else []
    return edges


def dense(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = np.zeros((n, n))
    np.add.at(m, (np.r_[a, b], np.r_[b, a]), np.r_[w, w])
    scale = 1 / np.sqrt(m.sum(axis=1))
    return m * scale[:, None] * scale + np.eye(n)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize(("n_groups", "chained"), [(12, True), (12, False), (1, False), (40, True)])
def test_leading_against_numpy(monkeypatch, weighted, n_groups, chained):
    monkeypatch.setattr(eigen, "BLOCK", 64)
    size = 60
    a, b = np.array(groups(n_groups, size, chained)).T
    n, w = n_groups * size, np.random.default_rng(1).uniform(0.5, 1.5, len(a)) if weighted else np.ones(len(a))
    product = eigen.Adjacency(n, a, b, w if weighted else None)
    m = dense(n, a, b, w)
    x = np.random.default_rng(2).normal(size=(n, 3))
    assert np.allclose(product(x[product.place.argsort()])[product.place], m @ x)
    # 40 groups don't fit 30 vectors: it goes on by restarts.
    values, vectors, residuals, _ = eigen.leading(product, n, 3, 30 if n_groups == 40 else 60)
    assert values == pytest.approx(np.linalg.eigvalsh(m)[::-1][:3], abs=1e-10 if n_groups == 40 else 1e-12)
    u = vectors[:, product.place]
    assert np.abs(m @ u.T - u.T * values).max() < 2e-8 and np.allclose(u @ u.T, np.eye(3), atol=1e-9)
    with pytest.raises(RuntimeError, match="not converged"):
        eigen.leading(product, n, 3, 24, max_steps=5)


def test_leading_of_tiny_operators():
    values, vectors, _, _ = eigen.leading(eigen.Adjacency(2, np.array([0]), np.array([1])), 2, 3, 60)
    assert values == pytest.approx([2, 0], abs=1e-12) and vectors.shape == (2, 2)


def test_partition_without_joins_over_the_matrix(spark, monkeypatch):
    """Beyond what the driver decomposes, one task does it, and groups without edges between them aren't cut."""

    def no_joins(*_, **__):
        raise AssertionError("decomposed by joins over the whole matrix")

    monkeypatch.setattr(cluster, "SMALL_ENTRIES", 0, raising=False)
    monkeypatch.setattr(cluster, "svd", no_joins)
    g = Graph.build(spark.createDataFrame([(int(a) * 7 + 5, int(b) * 7 + 5) for a, b in groups(3, 40, False)], "src long, dst long"))
    parts = {r.id: r.cluster for r in cluster.partition_graph(g, 3).collect()}
    assert sorted(parts) == [7 * i + 5 for i in range(120)]
    assert all(len({parts[7 * i + 5] for i in range(q, q + 40)}) == 1 for q in (0, 40, 80)) and len(set(parts.values())) == 3
