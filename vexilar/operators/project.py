"""Plane projections of one round's rows for plots: neighbour embeddings by gradient descent, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vexilar.operators.cluster import pca

#: Rows of a group: t-SNE holds a few matrices of rows by rows, the neighbour graph only one strip of them.
MOST_TSNE, MOST_GRAPH = 5_000, 100_000


def _start(x: np.ndarray, dims: int, size: float) -> np.ndarray:
    y = pca(x, dims)
    y = np.hstack([y, np.zeros((len(y), dims - y.shape[1]))])
    spread = y[:, :1].std()
    return y / spread * size if spread > 0 else y


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, rate: float = 200.0) -> np.ndarray:
    """Exact t-SNE from the principal components: the same rows give the same picture.

    Widths of the neighbourhoods are found by bisection; attraction is exaggerated in the first quarter. Fewer than
    three rows stay at their components.
    """
    n = len(x)
    if n > MOST_TSNE:
        raise ValueError(f"{n} rows are too many for exact t-SNE; the limit is {MOST_TSNE}")
    y = _start(x, dims, 1e-4)
    if n < 3:
        return y
    sq = (x * x).sum(axis=1)
    d2 = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(d2, np.inf)
    goal, low, high, beta = np.log(min(perplexity, (n - 1) / 3 if n > 4 else 1.0)), np.zeros(n), np.full(n, np.inf), np.full(n, 1 / np.median(d2[np.isfinite(d2)]).clip(1e-12))
    for _ in range(60):
        shifted = (d2 - d2.min(axis=1, keepdims=True)) * beta[:, None]
        p = np.exp(-shifted)
        p /= p.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        flat = entropy > goal
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    move, gain = np.zeros_like(y), np.ones_like(y)
    for k in range(rounds):
        d2y = ((y[:, None] - y[None]) ** 2).sum(axis=2) if n <= 1_000 else np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0)
        near = 1 / (1 + d2y)
        np.fill_diagonal(near, 0)
        q = np.maximum(near / near.sum(), 1e-12)
        w = ((12.0 if k < rounds // 4 else 1.0) * p - q) * near
        grad = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(move), gain * 0.8, gain + 0.2), 0.01)
        move = (0.5 if k < rounds // 4 else 0.8) * move - rate * gain * grad
        y = y + move
        y = y - y.mean(axis=0)
    return y


def _curve(min_dist: float) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + a d^2b) is nearest to 1 up to min_dist and to exp(min_dist - d) beyond, by a search of grids."""
    d = np.linspace(0, 3, 300)
    want = np.where(d < min_dist, 1.0, np.exp(min_dist - d))
    a0, a1, b0, b1 = 0.1, 5.0, 0.4, 2.0
    for _ in range(8):
        a, b = np.linspace(a0, a1, 25), np.linspace(b0, b1, 25)
        miss = ((1 / (1 + a[:, None, None] * d[None, None] ** (2 * b[None, :, None])) - want) ** 2).sum(axis=2)
        i, j = np.unravel_index(miss.argmin(), miss.shape)
        a0, a1, b0, b1 = a[max(i - 1, 0)], a[min(i + 1, 24)], b[max(j - 1, 0)], b[min(j + 1, 24)]
    return float((a0 + a1) / 2), float((b0 + b1) / 2)


def neighbour_layout(x: np.ndarray, dims: int = 2, neighbours: int = 15, min_dist: float = 0.05, first: int = 50, rounds: int = 300, seed: int = 7) -> np.ndarray:
    """A layout of the fuzzy graph of cosine neighbours of the first principal components (UMAP's objective).

    Every row's neighbours weigh exp(-(d - nearest) / width), with widths that make the weights add up to
    log2(neighbours); both directions are joined as a + b - ab. Edges attract by their weight, drawn rows repel.
    """
    n = len(x)
    if n > MOST_GRAPH:
        raise ValueError(f"{n} rows are too many for one layout; the limit is {MOST_GRAPH}")
    y = _start(x, dims, 1.0)
    if n < 4:
        return y
    z = pca(x, min(first, n, x.shape[1]))
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    k = min(neighbours, n - 1)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for lo in range(0, n, 512):
        d = np.maximum(1 - z[lo : lo + 512] @ z.T, 0)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[lo : lo + 512], dist[lo : lo + 512] = at, np.take_along_axis(d, at, axis=1)
    off, low, high, width = dist - dist[:, :1], np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):
        much = np.exp(-off / width[:, None]).sum(axis=1) > np.log2(max(k, 2))
        low, high = np.where(much, low, width), np.where(much, width, high)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2).clip(1e-6)
    weight = np.exp(-off / width[:, None]).ravel()
    src, dst = np.repeat(np.arange(n), k), near.ravel()
    keys, inverse = np.unique(np.concatenate([src * n + dst, dst * n + src]), return_inverse=True)
    one, two = np.zeros(len(keys)), np.zeros(len(keys))
    one[inverse[: len(src)]] = weight
    two[inverse[len(src) :]] = weight
    w, (i, j) = one + two - one * two, np.divmod(keys, n)
    a, b = _curve(min_dist)
    rng, y = np.random.default_rng(seed), y * 10
    for r in range(rounds):
        rate = 1 - r / rounds
        on = rng.random(len(w)) < w / w.max()
        s, t = i[on], j[on]
        gap = y[s] - y[t]
        d2 = (gap**2).sum(axis=1).clip(1e-9)
        pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * gap, -4, 4)
        step = np.zeros_like(y)
        np.add.at(step, s, pull)
        for _ in range(5):
            other = rng.integers(0, n, len(s))
            gap = y[s] - y[other]
            d2 = (gap**2).sum(axis=1)
            push = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * gap, -4, 4)
            np.add.at(step, s, np.where((other != s)[:, None], push, 0) / 5)
        y = y + rate * step / max(1.0, np.sqrt(k) / 2)
    return y - y.mean(axis=0)


METHODS = {"pca": lambda x: pca(x, 2), "tsne": tsne, "neighbours": neighbour_layout}


def project(df: DataFrame, keys: list[str], method: str = "pca", vec: str = "v") -> DataFrame:
    """(keys, id, x, y): each group's rows in the plane; method: pca, tsne or neighbours. A group is one task."""
    kinds, place = dict(df.dtypes), METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        xy = place(np.stack(pdf[vec].to_numpy()).astype(float))
        xy = np.hstack([xy, np.zeros((len(xy), 2 - xy.shape[1]))])
        return pdf[[*keys, "id"]].assign(x=xy[:, 0], y=xy[:, 1])

    return df.select(*keys, "id", vec).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", "x double", "y double"]))
