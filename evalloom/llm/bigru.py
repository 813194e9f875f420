"""Bidirectional gated recurrent network over bytes in numpy: one label distribution at every position.

Windows of bytes run side by side, one step of all of them at a time. The input side is a table look-up (a byte selects
its row of gate inputs), so a step is one small matrix product a direction. Training is backpropagation through time
with Adam on windows whose positions all carry the window's label.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW = 12, 64
EPOCHS, BATCH, STEP = 6, 256, 0.01


def letters(x: np.ndarray) -> np.ndarray:
    """Positions that can tell a language: ASCII letters and bytes of longer characters."""
    low = x | 32
    return (x >= 128) | ((low >= 97) & (low <= 122))


class BiGru:
    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["E" + d] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 0.7 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p["W" + d] = r.normal(0, 0.3, (hidden, classes)).astype(np.float32)
        self.p["b"] = np.zeros(classes, np.float32)

    def _pass(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, N, H) of one direction, in the order of the steps."""
        e, u, k = self.p["E" + d], self.p["U" + d], self.h
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((*x.shape, k), np.float32)
        for t in range(x.shape[0]):
            a, b = np.take(e, x[t], 0), h @ u
            g = a[:, : 2 * k] + b[:, : 2 * k]
            g *= 0.5
            np.tanh(g, g)
            g *= 0.5
            g += 0.5
            n = b[:, 2 * k :] * g[:, k:]
            n += a[:, 2 * k :]
            np.tanh(n, n)
            if keep is not None:
                keep.append((h, g, n, b[:, 2 * k :]))
            o = out[t]
            np.subtract(h, n, o)
            o *= g[:, :k]
            o += n
            h = o
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, N) bytes to (T, N, classes) probabilities."""
        s = self._pass(x, "f") @ self.p["Wf"]
        s += (self._pass(x[::-1], "b") @ self.p["Wb"])[::-1]
        s += self.p["b"]
        s -= s.max(2, keepdims=True)
        np.exp(s, s)
        s /= s.sum(2, keepdims=True)
        return s

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the sum of the probabilities over its letter positions (N, classes), and their number."""
        s = self._pass(x, "f") @ self.p["Wf"]
        s += (self._pass(x[::-1], "b") @ self.p["Wb"])[::-1]
        s += self.p["b"]
        np.clip(s, -40, 40, s)
        np.exp(s, s)
        mask = letters(x)
        s *= (mask / (s @ np.ones(s.shape[2], np.float32)))[:, :, None]
        return s.sum(0), mask.sum(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over letter positions, and its gradients."""
        k, grads = self.h, {}
        kept = {"f": [], "b": []}
        hs = {"f": self._pass(x, "f", kept["f"]), "b": self._pass(x[::-1], "b", kept["b"])}
        s = hs["f"] @ self.p["Wf"] + (hs["b"] @ self.p["Wb"])[::-1] + self.p["b"]
        s -= s.max(2, keepdims=True)
        np.exp(s, s)
        s /= s.sum(2, keepdims=True)
        m = letters(x).astype(np.float32)
        m /= max(1.0, m.sum())
        n = np.arange(x.shape[1])
        loss = float(-(np.log(s[:, n, y] + 1e-9) * m).sum())
        s[:, n, y] -= 1
        s *= m[:, :, None]
        grads["b"] = s.sum((0, 1))
        for d in "fb":
            ds, xs = (s, x) if d == "f" else (s[::-1], x[::-1])
            grads["W" + d] = np.einsum("tnh,tnc->hc", hs[d], ds)
            dh_out = ds @ self.p["W" + d].T
            u = self.p["U" + d]
            ge, gu, dh = np.zeros_like(self.p["E" + d]), np.zeros_like(u), np.zeros((x.shape[1], k), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                h, g, c, bn = kept[d][t]
                z, r = g[:, :k], g[:, k:]
                dh = dh + dh_out[t]
                dc = dh * (1 - z) * (1 - c * c)
                da = np.concatenate([dh * (h - c) * z * (1 - z), dc * bn * r * (1 - r), dc], 1)
                db = da.copy()
                db[:, 2 * k :] = dc * r
                gu += h.T @ db
                np.add.at(ge, xs[t], da)
                dh = dh * z + db @ u.T
            grads["E" + d], grads["U" + d] = ge, gu
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> BiGru:
        """x: (N, T) bytes, y: (N,) classes."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        steps, total = 0, max(1, epochs * -(-len(y) // BATCH))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                at = order[i : i + BATCH]
                _, g = self.gradients(np.ascontiguousarray(x[at].T), y[at])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                clip = min(1.0, 1.0 / (norm + 1e-9))
                steps += 1
                rate = STEP * (1 - steps / (total + 1)) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                for k, w in self.p.items():
                    a = g[k] * clip
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.001 * (a * a - v[k])
                    w -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self
