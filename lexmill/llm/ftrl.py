"""Follow-the-regularised-leader (proximal) for sparse multinomial logistic regression with an elastic net."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of n_features x n_classes. Features of a row: (indices without repeats, values)."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features + 1, n_classes))  # the last row is the bias, without an L1 penalty
        self.n = np.zeros((n_features + 1, n_classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        if isinstance(at, slice):
            w[-1] = -z[-1] / ((self.beta + np.sqrt(n[-1])) / self.alpha + self.l2)
        elif at[-1] == len(self.z) - 1:
            w[-1] = -z[-1] / ((self.beta + np.sqrt(n[-1])) / self.alpha + self.l2)
        return w

    def step(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        at, x = np.append(idx, len(self.z) - 1), np.append(val, 1.0)
        w = self.weights(at)
        g = softmax(x @ w)
        g[y] -= 1
        grad = x[:, None] * g
        n = self.n[at]
        more = n + grad * grad
        self.z[at] += grad - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 2, seed: int = 0) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                self.step(*rows[i], labels[i])
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood on held-back rows; 1 without rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
