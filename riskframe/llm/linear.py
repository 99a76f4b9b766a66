"""Linear hinge-loss models by dual coordinate descent, over bounded samples of sparse rows."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 1.0, epochs: int = 15,
              seed: int = 3, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge loss; y is -1 or 1.  The bias is a constant feature."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            gradient = y[i] * (w[idx] @ val + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < tol:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, positive: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of ``1 / (1 + exp(-(a * margin + b)))`` by ridge-damped Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margin, np.ones(len(margin))]
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        g = x.T @ (p - target) + 1e-3 * beta
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
