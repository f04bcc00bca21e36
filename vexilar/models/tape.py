"""Reverse-mode gradients of numpy arrays, for the few operations that the networks and losses need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array with what it came from: pairs of a parent and the function from its own gradient to the parent's."""

    def __init__(self, value, parents: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()) -> None:
        self.value, self.parents, self.grad = np.asarray(value), parents, None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other: Var) -> Var:
        return Var(self.value + other.value, ((self, lambda g: g), (other, lambda g: g)))

    def scaled(self, k: float) -> Var:
        return Var(self.value * k, ((self, lambda g: g * k),))

    def backward(self) -> None:
        """Fills in the gradients of all that this scalar came from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        for v in order:
            v.grad = np.zeros_like(v.value)
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            for p, back in v.parents:
                p.grad = p.grad + back(v.grad)


def linear(x: Var, w: Var, b: Var) -> Var:
    return Var(x.value @ w.value + b.value, ((x, lambda g: g @ w.value.T), (w, lambda g: x.value.T @ g), (b, lambda g: g.sum(axis=0))))


def conv(x: Var, w: Var, b: Var | None = None, stride: int = 1, padding: int = 0, dilation: int = 1) -> Var:
    """x (rows, channels, length) with filters w (out, channels, width)."""
    k = w.shape[2]
    wide = np.pad(x.value, ((0, 0), (0, 0), (padding, padding)))
    n = (wide.shape[2] - dilation * (k - 1) - 1) // stride + 1
    at = np.arange(n)[:, None] * stride + np.arange(k)[None, :] * dilation
    seen = wide[:, :, at].transpose(0, 2, 1, 3).reshape(len(wide) * n, -1)  # a row a place: channels by width
    flat = w.value.reshape(w.shape[0], -1)

    def rows(g: np.ndarray) -> np.ndarray:
        return g.transpose(0, 2, 1).reshape(-1, g.shape[1])

    def to_x(g: np.ndarray) -> np.ndarray:
        back = (rows(g) @ flat).reshape(len(wide), n, wide.shape[1], k)
        out = np.zeros_like(wide)
        for j in range(k):
            out[:, :, j * dilation : j * dilation + stride * (n - 1) + 1 : stride] += back[..., j].transpose(0, 2, 1)
        return out[:, :, padding : out.shape[2] - padding]

    y = (seen @ flat.T).reshape(len(wide), n, -1).transpose(0, 2, 1)
    parents = [(x, to_x), (w, lambda g: (rows(g).T @ seen).reshape(w.shape))]
    if b is not None:
        y = y + b.value[None, :, None]
        parents.append((b, lambda g: g.sum(axis=(0, 2))))
    return Var(y, tuple(parents))


def _standard(x: Var, axes: tuple[int, ...], gain: Var, bias: Var, shape: tuple[int, ...], eps: float, stats: tuple[np.ndarray, np.ndarray] | None) -> Var:
    """(x - mean) / deviation * gain + bias over axes; stats: fixed ones, which have no gradient."""
    mean, var = stats or (x.value.mean(axis=axes, keepdims=True), x.value.var(axis=axes, keepdims=True))
    inv = 1 / np.sqrt(var + eps)
    z = (x.value - mean) * inv
    g0, own = gain.value.reshape(shape), tuple(i for i, n in enumerate(shape) if n == 1)

    def to_x(g: np.ndarray) -> np.ndarray:
        g = g * g0
        if stats is not None:
            return g * inv
        return inv * (g - g.mean(axis=axes, keepdims=True) - z * (g * z).mean(axis=axes, keepdims=True))

    return Var(z * g0 + bias.value.reshape(shape), ((x, to_x), (gain, lambda g: (g * z).sum(axis=own)), (bias, lambda g: g.sum(axis=own))))


def batch_norm(x: Var, gain: Var, bias: Var, running: tuple[np.ndarray, np.ndarray], training: bool, momentum: float = 0.1, eps: float = 1e-5) -> Var:
    """By channel over rows and places; in training the running statistics move on, else they are used."""
    shape = (1, -1, 1)
    if not training:
        return _standard(x, (0, 2), gain, bias, (1, x.shape[1], 1), eps, (running[0].reshape(shape), running[1].reshape(shape)))
    n = x.value.size // x.shape[1]
    running[0][:] = (1 - momentum) * running[0] + momentum * x.value.mean(axis=(0, 2))
    running[1][:] = (1 - momentum) * running[1] + momentum * x.value.var(axis=(0, 2)) * n / max(n - 1, 1)
    return _standard(x, (0, 2), gain, bias, (1, x.shape[1], 1), eps, None)


def layer_norm(x: Var, gain: Var, bias: Var, eps: float = 1e-5) -> Var:
    return _standard(x, (1,), gain, bias, (1, x.shape[1]), eps, None)


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), ((x, lambda g: g * (x.value > 0)),))


def silu(x: Var) -> Var:
    s = 1 / (1 + np.exp(-x.value))
    return Var(x.value * s, ((x, lambda g: g * (s + x.value * s * (1 - s))),))


def tanh(x: Var) -> Var:
    t = np.tanh(x.value)
    return Var(t, ((x, lambda g: g * (1 - t * t)),))


def concat(parts: list[Var], axis: int) -> Var:
    edges = np.cumsum([0] + [p.shape[axis] for p in parts])
    cut = lambda a, b: (lambda g: np.take(g, np.arange(a, b), axis=axis))
    return Var(np.concatenate([p.value for p in parts], axis=axis), tuple((p, cut(a, b)) for p, a, b in zip(parts, edges, edges[1:])))


def max_pool(x: Var, k: int) -> Var:
    n = x.shape[2] // k
    blocks = x.value[:, :, : n * k].reshape(*x.shape[:2], n, k)
    top = blocks.argmax(axis=3)[..., None]

    def to_x(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        np.put_along_axis(out[:, :, : n * k].reshape(*x.shape[:2], n, k), top, g[..., None], axis=3)
        return out

    return Var(np.take_along_axis(blocks, top, axis=3)[..., 0], ((x, to_x),))


def mean_over_places(x: Var) -> Var:
    n = x.shape[2]
    return Var(x.value.mean(axis=2), ((x, lambda g: np.repeat(g[:, :, None] / n, n, axis=2)),))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def weighted_over_places(x: Var, score: Var) -> Var:
    """The mean of x over places, weighed by the softmax of score (rows, 1, places)."""
    w = softmax(score.value, 2)
    out = (x.value * w).sum(axis=2)

    def to_score(g: np.ndarray) -> np.ndarray:
        own = (g[:, :, None] * x.value).sum(axis=1, keepdims=True)
        return w * (own - (own * w).sum(axis=2, keepdims=True))

    return Var(out, ((x, lambda g: g[:, :, None] * w), (score, to_score)))


def rows_of(x: Var, at: np.ndarray) -> Var:
    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        np.add.at(out, at, g)
        return out

    return Var(x.value[at], ((x, back),))


def columns_of(x: Var, a: int, b: int) -> Var:
    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        out[:, a:b] = g
        return out

    return Var(x.value[:, a:b], ((x, back),))


def unit_rows(x: Var, eps: float = 1e-12) -> Var:
    n = np.maximum(np.linalg.norm(x.value, axis=1, keepdims=True), eps)
    z = x.value / n
    return Var(z, ((x, lambda g: (g - z * (g * z).sum(axis=1, keepdims=True)) / n),))
