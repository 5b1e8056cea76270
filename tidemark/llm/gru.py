"""Gated recurrent layers in numpy: forward, backward and Adam."""

from __future__ import annotations

import math

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def step(a: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New state, gates (reset, update) and candidate from input part ``a`` and recurrent part ``g``, both (rows, 3 width)."""
    gates = sigmoid(a[:, : 2 * width] + g[:, : 2 * width])
    n = np.tanh(a[:, 2 * width :] + gates[:, :width] * g[:, 2 * width :])
    return n + gates[:, width:] * (h - n), gates, n


def run(a: np.ndarray, wh: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """States (time, rows, width) for input parts ``a`` (time, rows, 3 width); ``keep`` (time, rows): 0 clears the state first."""
    width = wh.shape[0]
    out = np.empty((*a.shape[:2], width), dtype=F32)
    for t in range(len(a)):
        if keep is not None:
            h = h * keep[t][:, None]
        h, _, _ = step(a[t], h @ wh, h, width)
        out[t] = h
    return out


def forward(a: np.ndarray, wh: np.ndarray, h: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, list]:
    """As run(), with what backward() needs."""
    width, states, kept = wh.shape[0], np.empty((*a.shape[:2], wh.shape[0]), dtype=F32), []
    for t in range(len(a)):
        before = h * keep[t][:, None]
        g = before @ wh
        h, gates, n = step(a[t], g, before, width)
        states[t] = h
        kept.append((before, g, gates, n))
    return states, kept


def backward(d_states: np.ndarray, kept: list, wh: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of ``wh``."""
    width = wh.shape[0]
    da = np.empty((*d_states.shape[:2], 3 * width), dtype=F32)
    dg = np.empty_like(da)
    dh, back = np.zeros_like(d_states[0]), np.ascontiguousarray(wh.T)
    for t in range(len(d_states) - 1, -1, -1):
        before, g, gates, n = kept[t]
        r, z = gates[:, :width], gates[:, width:]
        dh += d_states[t]
        rest = F32(1) - gates
        rest *= gates
        dn = dh * (F32(1) - z)
        dn *= F32(1) - n * n
        dz = (before - n) * dh
        dz *= rest[:, width:]
        dr = dn * g[:, 2 * width :]
        dr *= rest[:, :width]
        da[t, :, :width], da[t, :, width : 2 * width], da[t, :, 2 * width :] = dr, dz, dn
        dg[t, :, : 2 * width] = da[t, :, : 2 * width]
        dn *= r
        dg[t, :, 2 * width :] = dn
        dh *= z
        dh += dg[t] @ back
        dh *= keep[t][:, None]
    befores = np.concatenate([k[0] for k in kept])
    return da, befores.T @ dg.reshape(-1, 3 * width)


def apart(w: np.ndarray) -> np.ndarray:
    """Weights or input parts (rows, 3 width) as (3, rows, width)."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))


def together(w: np.ndarray) -> np.ndarray:
    """(3, rows, width) as (rows, 3 width)."""
    return w.transpose(1, 0, 2).reshape(w.shape[1], -1)


class Layer:
    """forward() and backward() for many windows of at most ``time`` steps: reset, update and candidate lie apart, so that a
    step runs over whole stretches of memory, and arrays are made once."""

    def __init__(self, time: int, rows: int, width: int):
        shape = (time, rows, width)
        self.g, self.da = np.empty((time, 3, rows, width), dtype=F32), np.empty((3, *shape), dtype=F32)
        self.n, self.before, self.states, self.dg = (np.empty(shape, dtype=F32) for _ in range(4))
        self.one, self.two = (np.empty(shape[1:], dtype=F32) for _ in range(2))

    @np.errstate(over="ignore")
    def forward(self, a: np.ndarray, wh: np.ndarray, h: np.ndarray, clear: np.ndarray) -> np.ndarray:
        """States of input parts ``a`` (3, time, rows, width), good until the next call; ``clear`` (time, rows): clears the state first."""
        for t in range(a.shape[1]):
            before, g, n, out = self.before[t], self.g[t], self.n[t], self.states[t]
            before[:] = h
            before[np.flatnonzero(clear[t])] = 0  # beginnings are few
            np.matmul(before, wh, out=g)
            gates = g[:2]
            gates += a[:2, t]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += F32(1)
            np.reciprocal(gates, out=gates)
            np.multiply(gates[0], g[2], out=n)
            n += a[2, t]
            n *= F32(2)
            np.exp(n, out=n)  # tanh x = 1 - 2 / (1 + exp 2x), in half the time of numpy's
            n += F32(1)
            np.divide(F32(-2), n, out=n)
            n += F32(1)
            np.subtract(before, n, out=out)
            out *= gates[1]
            out += n
            h = out
        return self.states[: a.shape[1]]

    def backward(self, d_states: np.ndarray, wh: np.ndarray, clear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the last input parts, (3, time, rows, width), and of ``wh``."""
        time, (one, two), width = len(d_states), (self.one, self.two), wh.shape[1]
        dh, back = np.zeros_like(d_states[0]), np.ascontiguousarray(wh.transpose(0, 2, 1))
        for t in range(time - 1, -1, -1):
            (r, z, hidden), n, dg = self.g[t], self.n[t], self.dg[t]
            dr, dz, dn = self.da[0, t], self.da[1, t], self.da[2, t]
            dh += d_states[t]
            np.subtract(F32(1), z, out=one)
            np.multiply(dh, one, out=dn)
            np.multiply(n, n, out=two)
            np.subtract(F32(1), two, out=two)
            dn *= two
            one *= z
            np.subtract(self.before[t], n, out=dz)
            dz *= dh
            dz *= one
            np.subtract(F32(1), r, out=one)
            one *= r
            np.multiply(dn, hidden, out=dr)
            dr *= one
            np.multiply(dn, r, out=dg)
            dh *= z
            for x, w in zip((dr, dz, dg), back):
                dh += np.matmul(x, w, out=two)
            dh[np.flatnonzero(clear[t])] = 0
        befores, da = self.before[:time].reshape(-1, width).T, self.da[:, :time]
        return da, np.stack([befores @ x.reshape(-1, width) for x in (da[0], da[1], self.dg[:time])])


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.w, self.rate, self.clip, self.t = weights, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = F32(min(1.0, self.clip / (norm + 1e-9)))
        fix1, fix2 = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g = g * scale
            m *= F32(0.9)
            m += F32(0.1) * g
            g *= g
            g *= F32(0.001)
            v *= F32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += F32(1e-8 * math.sqrt(fix2))
            np.divide(m, g, out=g)
            g *= F32(self.rate / fix1 * math.sqrt(fix2))
            self.w[k] -= g


def rows_sum(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``values`` rows by ``index``."""
    index = index.astype(np.uint16) if size <= 1 << 16 else index  # sorted by counting
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
    out = np.zeros((size, values.shape[1]), dtype=F32)
    if len(at):
        out[at[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out
