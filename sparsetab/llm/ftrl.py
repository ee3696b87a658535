"""Follow-the-regularised-leader updates for sparse logistic models."""

from __future__ import annotations

import numpy as np

BIAS = 0  # feature 0 is the bias; it is not regularised


class Ftrl:
    """Per-coordinate state (z, n) of FTRL-proximal; weights follow from it on demand.

    With ``positive``, weights other than the bias are never below 0.
    """

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, bias: float = 0.0,
                 positive: bool = False):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z[BIAS] = -bias * beta / alpha

    def at(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        free = idx == BIAS
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        gone = np.where(free, False, z >= -l1) if self.positive else np.abs(z) <= l1
        return np.where(gone, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def update(self, idx: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """One step; ``idx`` holds each coordinate once."""
        n = self.n[idx]
        grown = n + gradient * gradient
        self.z[idx] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[idx] = grown

    def weights(self) -> np.ndarray:
        return self.at(np.arange(len(self.z))).astype(np.float32)


def sigmoid(s):
    return 1.0 / (1.0 + np.exp(-np.clip(s, -30.0, 30.0)))
