"""Small numpy learners for sparse rows: a hinge-loss linear model and a logistic curve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def dual_coordinate_descent(
    rows: Sequence[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 1
) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model with hinge loss.

    Row i has the features ``rows[i]``, each with the value ``values[feature]``; y is +1 or -1. Each step solves
    the dual for one row exactly, its multiplier held to 0 .. cost.
    """
    w, bias = np.zeros(len(values)), 0.0
    x = [values[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in x])
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(rows)):
            gradient = y[i] * (x[i] @ w[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, positive: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), fitted by Newton's method with a light ridge."""
    scale = float(np.std(margin)) or 1.0
    x = np.column_stack([margin / scale, np.ones(len(margin))])
    n1 = positive.sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (len(positive) - n1 + 2))
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * t
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        t -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0] / scale), float(t[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
