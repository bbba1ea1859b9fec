"""Logistic regression over hashed sparse features, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers (each once), values


class Params(NamedTuple):
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[Row], labels: np.ndarray, params: Params, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias. Rows are gone through in a fixed shuffled order in each epoch; no rows give zeros.

    FTRL-proximal: z gathers gradients less what the learning rates have moved, n their squares;
    a weight is zero while |z| stays within l1.
    """
    size = 1 << params.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    for _ in range(params.epochs if len(rows) else 0):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            idx, val = np.append(idx, size), np.append(val, 1.0)
            zi, ni = z[idx], n[idx]
            w = _weights(zi, ni, params, idx == size)
            g = (sigmoid(w @ val) - labels[i]) * val
            root = np.sqrt(ni + g * g)
            z[idx] = zi + g - (root - np.sqrt(ni)) / params.alpha * w
            n[idx] = ni + g * g
    w = _weights(z, n, params, np.arange(size + 1) == size)
    return w[:-1].astype(np.float32), float(w[-1])


def _weights(z: np.ndarray, n: np.ndarray, p: Params, bias: np.ndarray) -> np.ndarray:
    l1 = np.where(bias, 0.0, p.l1)
    w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def score(rows: list[Row], weights: np.ndarray, bias: float) -> np.ndarray:
    """Sparse dot products through the logistic function."""
    return sigmoid(np.array([weights[idx] @ val for idx, val in rows], dtype=np.float64) + bias)
