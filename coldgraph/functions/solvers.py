"""Small dense problems (dimension-sized, on the driver) behind the spectral operators."""

from __future__ import annotations

import numpy as np


def fix_signs(columns: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude entry of every column positive."""
    if not columns.size:
        return columns
    picks = np.abs(columns).argmax(axis=0)
    signs = np.sign(columns[picks, np.arange(columns.shape[1])])
    return columns * np.where(signs == 0, 1.0, signs)


def generalized_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending solutions of ``a w = value b w`` with ``w' b w = 1``, b positive definite."""
    lower = np.linalg.cholesky((b + b.T) / 2)
    inverse = np.linalg.inv(lower)
    values, vectors = np.linalg.eigh(inverse @ ((a + a.T) / 2) @ inverse.T)
    return values, inverse.T @ vectors


def filter_roots(cut: float, degree: int) -> list[float]:
    """Roots of the Chebyshev polynomial on [-1, cut], large and small ones in turn.

    The product of (A - root) is small on that interval and grows fast above it.
    """
    angles = np.pi * (np.arange(degree) + 0.5) / degree
    roots = sorted((cut - 1) / 2 + (cut + 1) / 2 * np.cos(angles))
    half = degree // 2
    low, high = roots[:half], roots[half:][::-1]
    turns = [r for pair in zip(high, low) for r in pair]
    return [float(r) for r in turns + high[half:]]
