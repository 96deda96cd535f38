"""A convolutional network over bytes, in numpy: filters of several widths, max pooling, softmax.

A filter of width k is k tables of 256 rows, so that its response at a place is the sum of k looked-up rows. The
largest response over a window is pooled; hence the gradient reaches a filter through one place of each window
only, and training is a few lines. Zero bytes pad texts and short windows.
"""

from __future__ import annotations

import numpy as np


class ByteConvNet:
    def __init__(self, classes: int, filters: int = 16, widths: tuple[int, ...] = (2, 3, 4), seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.tables = [rng.normal(0, 0.3, (k, 256, filters)).astype(np.float32) for k in widths]
        self.out = rng.normal(0, 0.1, (filters * len(widths), classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def _response(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Responses at each place of the last axis but the last k - 1."""
        k = len(table)
        n = data.shape[-1] - k + 1
        total = table[0][data[..., :n]]
        for j in range(1, k):
            total += table[j][data[..., j : j + n]]
        return total

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest responses of the spans that begin at ``starts`` (ascending, not empty, up to the next one)."""
        padded = np.concatenate([data, np.zeros(max(self.widths) - 1, np.uint8)])
        parts = [np.maximum.reduceat(self._response(padded, t)[: len(data)], starts, axis=0) for t in self.tables]
        return np.concatenate(parts, axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on windows (n, length) with class numbers."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(epochs):
            step_rate = rate * (1 - epoch / epochs)
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, y = windows[rows], labels[rows]
                places, values = [], []
                for table in self.tables:
                    r = self._response(x, table)
                    place = r.argmax(axis=1)
                    places.append(place)
                    values.append(np.take_along_axis(r, place[:, None, :], axis=1)[:, 0, :])
                pooled = np.concatenate(values, axis=1)
                p = self.probabilities(pooled)
                p[np.arange(len(rows)), y] -= 1
                p /= len(rows)
                active = np.maximum(pooled, 0)
                back = (p @ self.out.T) * (pooled > 0)
                grads = []
                for i, (table, place) in enumerate(zip(self.tables, places)):
                    g = np.zeros_like(table)
                    mine = back[:, i * self.filters : (i + 1) * self.filters]
                    for j in range(len(table)):
                        np.add.at(g[j], (np.take_along_axis(x, place + j, axis=1), np.arange(self.filters)), mine)
                    grads.append(g)
                grads += [active.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= step_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def padded_windows(windows: list[bytes], length: int) -> np.ndarray:
    """(n, length) bytes; short windows are padded with zeros."""
    return np.frombuffer(b"".join(w[:length].ljust(length, b"\0") for w in windows), np.uint8).reshape(-1, length)
