"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection by Sturm
counts, inverse iteration with reorthogonalisation inside clusters. The matrix is a feature
dimension squared, never a corpus."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray):
    """Diagonal, off-diagonal and the Householder vectors of ``a`` = H T H^T."""
    a, n, reflectors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.abs(v).max()
        v = v / size if size else v  # no overflow in the norm
        norm = np.sqrt(v @ v)
        if not np.abs(v[1:]).any():
            reflectors.append(None)
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.sqrt(v @ v)
        block = a[k + 1:, k + 1:]
        p = 2 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x (Sturm sequence signs)."""
    tiny = np.finfo(float).tiny / EPS
    q = d[0] - x
    below = (q < 0).astype(int)
    with np.errstate(over="ignore"):  # an infinite quotient has the right sign
        for i in range(1, len(d)):
            q = np.where(np.abs(q) < tiny, -tiny, q)
            q = d[i] - x - e[i - 1] * (e[i - 1] / q)
            below += q < 0
    return below


def largest(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    span = (np.abs(d) + reach).max() * 4 * EPS + np.finfo(float).tiny
    low, high = np.full(k, (d - reach).min() - span), np.full(k, (d + reach).max() + span)
    place = len(d) - 1 - np.arange(k)
    for _ in range(1200):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        up = counts_below(d, e, mid) > place  # the wanted one lies below mid
        high, low = np.where(up, mid, high), np.where(up, low, mid)
    return low + (high - low) / 2


def _solver(d: np.ndarray, e: np.ndarray, x: float, least: float):
    """Solves (T - x I) y = b by elimination with row exchanges; pivots of 0 become ``least``."""
    n = len(d)
    main, first, second = d - x, np.append(e, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below, own, after = e[i], main[i + 1], first[i + 1]
        if abs(below) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / below
            main[i + 1], first[i + 1] = first[i] - factor[i] * own, -factor[i] * after
            main[i], first[i], second[i] = below, own, after
        else:
            main[i] = main[i] or least
            factor[i] = below / main[i]
            main[i + 1] = own - factor[i] * first[i]
    main = np.where(np.abs(main) < least, np.where(main < 0, -least, least), main)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        y[n - 1] /= main[n - 1]
        if n > 1:
            y[n - 2] = (y[n - 2] - first[n - 2] * y[n - 1]) / main[n - 2]
        for i in range(n - 3, -1, -1):
            y[i] = (y[i] - first[i] * y[i + 1] - second[i] * y[i + 2]) / main[i]
            if abs(y[i]) > 1e200:  # a direction is wanted, not a length
                y /= abs(y[i])
        return y
    return solve


def _orthogonal(y: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            y = y - (o @ y) * o
    return y


def leading(a: np.ndarray, k: int, cluster: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of symmetric ``a`` and their unit eigenvectors as rows,
    the entry of largest size positive. Values closer than ``cluster`` times the norm are one
    cluster, in which vectors are reorthogonalised at each step."""
    n = len(a)
    d, e, reflectors = tridiagonal(a.astype(float))
    norm = max(np.abs(d).max(), np.abs(e).max() if n > 1 else 0.0)
    if not norm:
        return np.zeros(k), np.eye(n)[:k]
    values, rng, found = largest(d, e, k), np.random.default_rng(11), []
    for j, x in enumerate(values):
        near = [v for v, y in zip(found, values) if abs(y - x) <= cluster * norm]
        # equal values: shifted a little, so that solves differ
        solve = _solver(d, e, x - EPS * norm * len(near), EPS * norm)
        y = _orthogonal(rng.standard_normal(n), near)
        for _ in range(6):
            y = solve(y / np.abs(y).max())
            y = y / np.abs(y).max()
            z = _orthogonal(y, near)
            # nothing new left: another start
            y = z if np.abs(z).max() > 1e-8 else _orthogonal(rng.standard_normal(n), near)
            y = y / np.sqrt(y @ y)
        found.append(_orthogonal(y, near))
        found[-1] /= np.sqrt(found[-1] @ found[-1])
    vectors = np.array(found)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        if v is not None:
            vectors[:, i + 1:] -= 2 * np.outer(vectors[:, i + 1:] @ v, v)
    out = []
    for y in vectors:  # rounding of the way back
        y = _orthogonal(y, out)
        out.append(y / np.sqrt(y @ y) * (1 if y[np.abs(y).argmax()] > 0 else -1))
    return values, np.array(out)
