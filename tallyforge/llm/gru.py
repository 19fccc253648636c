"""A gated recurrent layer in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Next state from the inputs' share of the gates (rows x 3H: update, reset, candidate)."""
    n = h.shape[1]
    inner = h @ u
    zr = sigmoid(gates[:, : 2 * n] + inner[:, : 2 * n])
    new = np.tanh(gates[:, 2 * n :] + zr[:, n:] * inner[:, 2 * n :])
    return new + zr[:, :n] * (h - new)


def forward(gates: np.ndarray, h: np.ndarray, u: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """States after each of T steps (T x rows x H) and what backward needs; a masked step keeps the state."""
    n, states, kept = h.shape[1], [], []
    for t in range(len(gates)):
        inner = h @ u
        zr = sigmoid(gates[t, :, : 2 * n] + inner[:, : 2 * n])
        new = np.tanh(gates[t, :, 2 * n :] + zr[:, n:] * inner[:, 2 * n :])
        after = new + zr[:, :n] * (h - new)
        if mask is not None:
            after = np.where(mask[t, :, None], after, h)
        kept.append((h, zr, new, inner[:, 2 * n :]))
        states.append(after)
        h = after
    return np.stack(states), kept


def backward(d_states: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u, through all T steps."""
    n = u.shape[0]
    d_gates, d_u, d_h = np.zeros((*d_states.shape[:2], 3 * n), np.float32), np.zeros_like(u), np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        h, zr, new, inner = kept[t]
        d = d_states[t] + d_h
        if mask is not None:
            live = mask[t, :, None]
            stay, d = np.where(live, 0, d), np.where(live, d, 0)
        z, r = zr[:, :n], zr[:, n:]
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_inner = np.concatenate((d_z, d_r, d_new * r), axis=1)
        d_gates[t] = np.concatenate((d_z, d_r, d_new), axis=1)
        d_u += h.T @ d_inner
        d_h = d * z + d_inner @ u.T
        if mask is not None:
            d_h += stay
    return d_gates, d_u


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 5.0 / norm) if norm else 1.0
        for k, g in grads.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            weights[k] -= (self.rate / (1 - 0.9**self.t)) * self.mean[k] / (np.sqrt(self.square[k] / (1 - 0.99**self.t)) + 1e-6)


class Room(dict):
    """Arrays that are used again by the next window of the same shape, so that no memory is asked for at each step."""

    def array(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        held = self.get(name)
        if held is None or held.shape != shape or held.dtype != kind:
            held = self[name] = np.empty(shape, kind)
        return held


def stream_step(gates: np.ndarray, h: np.ndarray, turn: np.ndarray, zr: np.ndarray, new: np.ndarray, inner: np.ndarray, after: np.ndarray) -> None:
    """Next states (``after``, H x streams) from the inputs' share of the gates (3H x streams); ``turn`` is u transposed, the rest is filled for stream_back."""
    n = len(h)
    np.matmul(turn, h, out=inner)
    np.add(gates[: 2 * n], inner[: 2 * n], out=zr)
    sigmoid(zr)
    np.multiply(zr[n:], inner[2 * n :], out=new)
    new += gates[2 * n :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=after)
    after *= zr[:n]
    after += new


def stream_back(d: np.ndarray, h: np.ndarray, zr: np.ndarray, new: np.ndarray, inner: np.ndarray, u: np.ndarray, d_gates: np.ndarray, d_inner: np.ndarray, spare: np.ndarray) -> None:
    """Fill the gradients of the gates' inputs and of their inner part from that of the state after, which becomes that of the state before."""
    n = len(h)
    z, r, d_new = zr[:n], zr[n:], d_gates[2 * n :]
    np.multiply(new, new, out=spare)
    np.subtract(1, spare, out=spare)
    np.subtract(1, z, out=d_new)
    np.multiply(d_new, z, out=d_gates[:n])
    d_new *= spare
    d_new *= d
    np.subtract(h, new, out=spare)
    spare *= d
    d_gates[:n] *= spare
    np.subtract(1, r, out=spare)
    spare *= r
    spare *= inner[2 * n :]
    np.multiply(d_new, spare, out=d_gates[n : 2 * n])
    d_inner[:] = d_gates
    d_inner[2 * n :] *= r
    d *= z
    d += np.matmul(u, d_inner, out=spare)
