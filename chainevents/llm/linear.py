"""Logistic regression for a bounded number of rows and features, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, bias: bool = True, steps: int = 25) -> np.ndarray:
    """Weights (the last for a constant, if ``bias``) by Newton steps on the ridge-penalised logistic loss."""
    if bias:
        x = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), ridge)
    if bias:
        penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def applied(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
