"""A small weighted logistic regression for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of the columns of ``x`` and, last, the intercept (Newton steps, damped)."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(keep + (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x, x.T @ (weight * (y - p)) - keep @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
