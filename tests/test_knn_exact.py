"""Nearest neighbours by differences, far rows ruled out before."""

import numpy as np
import pytest

from inferna.operators import knn


@pytest.mark.parametrize("decimals", [None, 9])
def test_euclidean_neighbours_are_those_of_all_differences(decimals, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, (300, 6)).astype(float), rng.normal(size=(200, 6)) * 1e-9 + 1e3, rng.normal(size=(100, 6))])
    q = np.concatenate([x[::7], x[::11] + 1e-10, rng.normal(size=(20, 6))])
    every = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    counted = []
    real = np.einsum
    monkeypatch.setattr(knn.np, "einsum", lambda how, *a: (counted.append(a[0].size), real(how, *a))[1])
    rank = rng.permutation(len(x))
    kept = knn.first_equals(x, rank, 5)
    norms = np.sqrt((x[kept] ** 2).sum(axis=1))
    near = knn._distances(q, x[kept], norms, "euclidean", 5, 0.0 if decimals is None else 1e-9)
    if decimals is not None:
        every, near = np.round(every, decimals), np.round(near, decimals)
    assert kept[knn.nearest_rows(near, rank[kept], 5)].tolist() == knn.nearest_rows(every, rank, 5).tolist()
    assert sum(counted) < q.size + x.size * len(q) / 2   # far rows are ruled out without their differences
