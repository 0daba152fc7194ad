"""Gated recurrent units in numpy: steps over many sequences at once, backpropagation through time, and Adam."""

from __future__ import annotations

import numpy as np

f32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return f32(1) / (f32(1) + np.exp(-x))


def forward(x: np.ndarray, u: np.ndarray):
    """x: (steps, sequences, 3H) inputs of the update, reset and candidate gates; u: (H, 3H). Gives all states and what backward needs."""
    steps, b, h3 = x.shape
    h = h3 // 3
    states = np.zeros((steps + 1, b, h), f32)
    gates = np.empty((steps, b, 2 * h), f32)
    cand = np.empty((steps, b, h), f32)
    inner = np.empty((steps, b, h), f32)
    for t in range(steps):
        hu = states[t] @ u
        gates[t] = sigmoid(x[t, :, : 2 * h] + hu[:, : 2 * h])
        inner[t] = hu[:, 2 * h :]
        cand[t] = np.tanh(x[t, :, 2 * h :] + gates[t, :, h:] * inner[t])
        z = gates[t, :, :h]
        states[t + 1] = cand[t] + z * (states[t] - cand[t])
    return states[1:], (states, gates, cand, inner)


def backward(grad: np.ndarray, u: np.ndarray, cache) -> tuple[np.ndarray, np.ndarray]:
    """From gradients of all states those of x and u."""
    states, gates, cand, inner = cache
    steps, b, h = grad.shape
    dx = np.empty((steps, b, 3 * h), f32)
    du = np.zeros_like(u)
    d = np.zeros((b, h), f32)
    for t in range(steps - 1, -1, -1):
        d = d + grad[t]
        z, r = gates[t, :, :h], gates[t, :, h:]
        dc = d * (1 - z) * (1 - cand[t] ** 2)
        dz = d * (states[t] - cand[t]) * z * (1 - z)
        dr = dc * inner[t] * r * (1 - r)
        dx[t, :, :h], dx[t, :, h : 2 * h], dx[t, :, 2 * h :] = dz, dr, dc
        through = np.concatenate((dz, dr, dc * r), axis=1)
        du += states[t].T @ through
        d = d * z + through @ u.T
    return dx, du


def step(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One step without what backward needs."""
    n = h.shape[1]
    hu = h @ u
    g = x[:, : 2 * n] + hu[:, : 2 * n]
    np.negative(g, out=g)
    np.exp(g, out=g)
    g += f32(1)
    np.reciprocal(g, out=g)
    c = hu[:, 2 * n :]
    c *= g[:, n:]
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    out = h - c
    out *= g[:, :n]
    out += c
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = f32(min(1.0, clip / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += f32(0.1) * (g - self.m[k])
            self.v[k] += f32(0.01) * (g * g - self.v[k])
            m = self.m[k] / f32(1 - 0.9**self.t)
            v = self.v[k] / f32(1 - 0.99**self.t)
            self.params[k] -= f32(self.rate) * m / (np.sqrt(v) + f32(1e-8))
