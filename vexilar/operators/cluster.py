"""Spectral embedding, density clustering and two-way splits of one round's rows, in numpy.

A round is bounded by the experiment (thousands of rows) and is one task of ``applyInPandas``; many rounds, receivers
or seeds run side by side as groups. No matrix of rows by rows is held. Labels are dense from 0, noise is -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vexilar.operators.density import spanning_tree
from vexilar.operators.knn import _distances as knn_distances

#: Rows of a group that one task takes; beyond it they are refused. Memory grows with the rows, time with their square.
MOST_ROWS = 200_000
#: Nodes up to which eigenvectors come from the whole matrix; rows that distances are worked out for at once.
DENSE_NODES, STRIP = 3_000, 256


def _checked(n: int) -> None:
    if n > MOST_ROWS:
        raise ValueError(f"a group of {n} rows is too large for one task; the limit is {MOST_ROWS}")


class Affinity:
    """A symmetric sparse matrix without its diagonal, scaled by the roots of its row sums on both sides."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, n: int) -> None:
        off = (row != col) & (weight != 0)
        order = np.lexsort((col[off], row[off]))
        self.n, self.row, self.col, w = n, row[off][order], col[off][order], weight[off][order]
        self.degree = np.bincount(self.row, w, n)
        self.root = np.sqrt(np.where(self.degree > 0, self.degree, 1.0))
        self.weight = w / self.root[self.row] / self.root[self.col]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with the columns of x. A node without edges has the eigenvalue 1, as in the Laplacian's 0."""
        out = np.stack([np.bincount(self.row, self.weight * c[self.col], self.n) for c in x.T], axis=1)
        return out + x * (self.degree <= 0)[:, None]

    def dense(self) -> np.ndarray:
        out = np.diag((self.degree <= 0).astype(float))
        out[self.row, self.col] += self.weight
        return out


def top_eigenvectors(m: Affinity, k: int, seed: int = 0, tolerance: float = 1e-9, rounds: int = 200) -> np.ndarray:
    """Eigenvectors of the k greatest eigenvalues, by falling value: of the whole matrix, or by a block Krylov method.

    The block is wider than k, so that values of higher multiplicity, one for each part of a graph, are all found. Each
    round multiplies a block by the matrix a few times and keeps the best of what it spans, until residuals vanish.
    """
    if m.n <= DENSE_NODES:
        values, vectors = np.linalg.eigh(m.dense())
        return vectors[:, ::-1][:, :k]
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(m.n, min(m.n, k + 12))))[0]
    for _ in range(rounds):
        span, now = [block], block
        for _ in range(8):
            now = m.times(now)
            for _ in range(2):  # twice, as once leaves rounding behind
                for q in span:
                    now = now - q @ (q.T @ now)
            now = np.linalg.qr(now)[0]
            span.append(now)
        basis = np.hstack(span)
        image = m.times(basis)
        values, inner = np.linalg.eigh(basis.T @ image)
        best = inner[:, ::-1][:, : block.shape[1]]
        block = basis @ best
        if np.linalg.norm((image @ best - block * values[::-1][: block.shape[1]])[:, :k], axis=0).max() < tolerance:
            return block[:, :k]
    raise RuntimeError(f"the eigenvectors of a graph of {m.n} nodes did not settle in {rounds} rounds")


def embedded(m: Affinity, dims: int) -> np.ndarray:
    """Laplacian eigenmaps: min(dims, n - 2) columns, the trivial one left out.

    Columns are scaled by the square root of degrees as usual, and their sign makes the greatest component positive.
    """
    _checked(m.n)
    k = min(dims, m.n - 2)
    if k < 1:
        return np.zeros((m.n, 0))
    out = top_eigenvectors(m, k + 1)[:, 1:] / m.root[:, None]
    top = np.abs(out).argmax(axis=0)
    return out * np.where(out[top, np.arange(k)] < 0, -1.0, 1.0)


def spectral_embedding(weights: np.ndarray, dims: int = 16) -> np.ndarray:
    """``embedded`` of a symmetric affinity matrix."""
    row, col = np.nonzero(weights)
    return embedded(Affinity(row, col, weights[row, col], len(weights)), dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def _core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's distance to its k-th nearest, itself the first."""
    sq = (x * x).sum(axis=1)
    return np.concatenate([np.partition(knn_distances(x[i : i + STRIP], x, sq), k - 1, axis=1)[:, k - 1] for i in range(0, len(x), STRIP)])


def _ordered(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    order = np.lexsort((b, a, w))
    return list(zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True))


def hdbscan(x: np.ndarray, min_cluster_size: int = 10, min_samples: int = 5, method: str = "eom") -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) by hierarchical density clustering, Euclidean; a point is its own first neighbour.

    method: 'eom' takes the clusters of greatest stability, 'leaf' the leaves of the condensed tree. The root is never
    a cluster. Labels follow the order of each cluster's first row.
    """
    n = len(x)
    _checked(n)
    labels, probs = np.full(n, -1), np.zeros(n)
    if n < max(2, min_cluster_size):
        return labels, probs
    x = np.asarray(x, float)
    core = _core_distances(x, min(min_samples, n))
    # single linkage: children and height of each merged node
    parent = np.arange(2 * n - 1)
    children: dict[int, tuple[int, int, float]] = {}
    size = np.ones(2 * n - 1, int)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (a, b, h) in enumerate(_ordered(*spanning_tree(np.arange(n), x, core))):
        a, b, node = find(a), find(b), n + k
        children[node] = (a, b, h)
        parent[a] = parent[b] = node
        size[node] = size[a] + size[b]
    # condensed tree: a cluster's births, the points that leave it and when, and its child clusters
    clusters = [{"birth": 0.0, "points": [], "children": [], "parent": -1}]
    stack = [(2 * n - 2, 0)]
    lam = lambda h: 1.0 / h if h > 0 else np.inf

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            a = todo.pop()
            if a < n:
                out.append(a)
            else:
                todo += children[a][:2]
        return out

    while stack:
        node, c = stack.pop()
        if node < n:
            clusters[c]["points"].append((node, np.inf))
            continue
        a, b, h = children[node]
        big = [z for z in (a, b) if size[z] >= min_cluster_size]
        if len(big) == 2:
            for z in big:
                clusters.append({"birth": lam(h), "points": [], "children": [], "parent": c})
                clusters[c]["children"].append((len(clusters) - 1, lam(h), size[z]))
                stack.append((z, len(clusters) - 1))
        else:
            for z in (a, b):
                if z in big:
                    stack.append((z, c))
                else:
                    clusters[c]["points"] += [(p, lam(h)) for p in leaves(z)]
    top = max((l for c in clusters for _, l in c["points"] if np.isfinite(l)), default=1.0)
    for c in clusters:
        c["points"] = [(p, min(l, top)) for p, l in c["points"]]
        c["birth"] = min(c["birth"], top)
        c["stability"] = sum(l - c["birth"] for _, l in c["points"]) + sum((min(l, top) - c["birth"]) * m for _, l, m in c["children"])
    chosen: set[int] = set()
    if method == "leaf":
        chosen = {k for k, c in enumerate(clusters) if k and not c["children"]}
    else:
        best = [0.0] * len(clusters)
        for k in range(len(clusters) - 1, 0, -1):
            below = sum(best[z] for z, *_ in clusters[k]["children"])
            if clusters[k]["children"] and below > clusters[k]["stability"]:
                best[k] = below
            else:
                best[k] = clusters[k]["stability"]
                chosen.add(k)
        taken = set()
        for k in sorted(chosen):  # parents have smaller numbers
            p = clusters[k]["parent"]
            while p > 0 and p not in taken:
                p = clusters[p]["parent"]
            if p <= 0:
                taken.add(k)
        chosen = taken

    def members(k: int) -> list[tuple[int, float]]:
        out, todo = [], [k]
        while todo:
            z = todo.pop()
            out += clusters[z]["points"]
            todo += [y for y, *_ in clusters[z]["children"]]
        return out

    groups = sorted((members(k) for k in chosen), key=lambda g: min(p for p, _ in g))
    for label, g in enumerate(groups):
        most = max(l for _, l in g)
        for p, l in g:
            labels[p], probs[p] = label, (1.0 if most == 0 else min(l, most) / most)
    return labels, probs


def two_means(x: np.ndarray, seed: int = 0, rounds: int = 100, starts: int = 10) -> np.ndarray:
    """Labels 0 or 1 of the best of several 2-means runs with spread-out seeded starts; the first row is in 0."""
    rng, best, out = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        a = x[rng.integers(len(x))]
        far = ((x - a) ** 2).sum(axis=1)
        b = x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else a
        centre, labels = np.stack([a, b]), None
        for _ in range(rounds):
            d = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centre = np.stack([x[labels == k].mean(axis=0) if (labels == k).any() else centre[k] for k in (0, 1)])
        cost = d.min(axis=1).sum()
        if cost < best - 1e-12:
            best, out = cost, labels
    return out if not len(out) or out[0] == 0 else 1 - out


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 300, starts: int = 10) -> np.ndarray:
    """min(k, rows) centres: the best of several k-means runs with spread-out seeded starts."""
    rng, k, best, out = np.random.default_rng(seed), min(k, len(x)), np.inf, x[:0]
    for _ in range(starts):
        centre = x[rng.integers(len(x))][None]
        while len(centre) < k:
            far = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum() if far.sum() > 0 else None)]])
        labels = None
        for _ in range(rounds):
            d = ((x[:, None] - centre[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centre = np.stack([x[labels == j].mean(axis=0) if (labels == j).any() else centre[j] for j in range(k)])
        cost = d.min(axis=1).sum()
        if cost < best - 1e-12:
            best, out = cost, centre
    return out


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with plain Euclidean distances; 0 with fewer than two clusters, and for rows alone in one."""
    values = np.unique(labels)
    if len(values) < 2:
        return 0.0
    member = (labels[:, None] == values[None, :]).astype(float)
    sums = np.concatenate([_distances(x[i : i + STRIP], x) @ member for i in range(0, len(x), STRIP)])
    sizes = member.sum(axis=0)
    own = np.searchsorted(values, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def pca(x: np.ndarray, dims: int = 2) -> np.ndarray:
    """Principal components of centred rows, each with its greatest loading positive."""
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    vt = vt[:dims] * np.where(vt[np.arange(min(dims, len(vt))), np.abs(vt[:dims]).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return centred @ vt.T


def cluster_groups(df: DataFrame, keys: list[str], vec: str = "v", min_cluster_size: int = 10, min_samples: int = 5, method: str = "eom") -> DataFrame:
    """(keys, id, cluster, probability): density clusters of each group of rows; groups run as separate tasks."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        labels, probs = hdbscan(np.stack(pdf[vec].to_numpy()), min_cluster_size, min_samples, method)
        return pdf[[*keys, "id"]].assign(cluster=labels, probability=probs)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", "cluster bigint", "probability double"])
    return df.select(*keys, "id", vec).groupBy(*keys).applyInPandas(run, schema)


def project_groups(df: DataFrame, keys: list[str], vec: str = "v") -> DataFrame:
    """(keys, id, x, y): the first two principal components of each group."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        xy = pca(np.stack(pdf[vec].to_numpy()), 2)
        xy = np.hstack([xy, np.zeros((len(xy), 2 - xy.shape[1]))])
        return pdf[[*keys, "id"]].assign(x=xy[:, 0], y=xy[:, 1])

    return df.select(*keys, "id", vec).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", "x double", "y double"]))
