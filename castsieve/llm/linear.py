"""Small linear models on hashed features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(
    features: np.ndarray, targets: np.ndarray, weights: np.ndarray | None = None, steps: int = 200, decay: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of one logistic model per column of ``targets`` (0 to 1).

    Full-batch steps with a running scale per weight; the same rows in the same
    order give the same model.
    """
    n, width = features.shape
    share = (np.ones(n) if weights is None else weights).astype(np.float32)[:, None]
    share = share / share.sum()
    w, b = np.zeros((width, targets.shape[1]), np.float32), np.zeros(targets.shape[1], np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, b)]
    for step in range(1, steps + 1):
        error = (_sigmoid(features @ w + b) - targets).astype(np.float32) * share
        for x, gradient, (first, second) in zip((w, b), (features.T @ error + decay * w, error.sum(0)), moments):
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            scale = np.sqrt(second / (1 - 0.99**step)) + 1e-8
            x -= 0.1 * (first / (1 - 0.9**step)) / scale
    return w, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probability(features: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return _sigmoid(features @ model[0] + model[1])
