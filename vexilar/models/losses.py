"""Losses over logits and features, as scalars with gradients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vexilar.models.tape import Var, columns_of, rows_of, softmax, unit_rows


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def soft_cross_entropy(logits: Var, targets: np.ndarray, weights: np.ndarray | None = None) -> Var:
    """Cross-entropy with rows of target shares: the mean, or the weighted mean."""
    share = np.full(len(targets), 1 / len(targets)) if weights is None else weights / (weights.sum() + 1e-8)
    each = _logsumexp(logits.value) * targets.sum(axis=1) - (targets * logits.value).sum(axis=1)
    back = lambda g: g * share[:, None] * (softmax(logits.value) * targets.sum(axis=1, keepdims=True) - targets)
    return Var((each * share).sum(), ((logits, back),))


def cross_entropy(logits: Var, labels: np.ndarray, weights: np.ndarray | None = None) -> Var:
    return soft_cross_entropy(logits, np.eye(logits.shape[1], dtype=logits.value.dtype)[labels], weights)


def distillation(logits: Var, teacher: np.ndarray, temperature: float = 2.0) -> Var:
    """Divergence of the softened student from the softened teacher on the teacher's classes, times temperature squared."""
    k, t = teacher.shape[1], temperature
    target = softmax(teacher / t)
    part = columns_of(logits, 0, k).scaled(1 / t)
    entropy = -(target * np.log(np.maximum(target, 1e-30))).sum(axis=1).mean()
    loss = soft_cross_entropy(part, target)
    return Var((loss.value - entropy) * t * t, ((loss, lambda g: g * t * t),))


def contrastive(features: Var, labels: np.ndarray, temperature: float = 0.2) -> Var:
    """Supervised contrastive loss over a batch: rows of a class attract each other; 0 where no row has a partner."""
    z = unit_rows(features)
    n = len(labels)
    other = ~np.eye(n, dtype=bool)
    same = (labels[:, None] == labels[None, :]) & other
    partners = same.sum(axis=1)
    valid = partners > 0
    if n < 2 or not valid.any():
        return Var(np.zeros((), features.value.dtype), ((features, lambda g: np.zeros_like(features.value)),))
    s = np.where(other, z.value @ z.value.T / temperature, -np.inf)
    share = same / np.maximum(partners, 1)[:, None]
    each = _logsumexp(s) - (np.where(other, s, 0.0) * share).sum(axis=1)

    def back(g: np.ndarray) -> np.ndarray:
        ds = (softmax(s, 1) - share) * (valid / valid.sum())[:, None]
        return g * (ds + ds.T) @ z.value / temperature

    return Var(each[valid].mean(), ((z, back),))


def dummies_second(logits: Var, labels: np.ndarray, dummies: int) -> Var:
    """How far the last ``dummies`` logits are from holding all that the true class leaves."""
    hidden = logits.value.copy()
    hidden[np.arange(len(labels)), labels] = -np.inf
    last = np.full_like(hidden, -np.inf)
    last[:, -dummies:] = logits.value[:, -dummies:]
    back = lambda g: g * (softmax(hidden) - softmax(last)) / len(labels)
    return Var((_logsumexp(hidden) - _logsumexp(last)).mean(), ((logits, back),))


def placeholders(features: Var, logits: Var, labels: np.ndarray, head: Callable[[Var], Var], dummies: int, rng: np.random.Generator, beta: float = 1.0, gamma: float = 1.0, share: float = 0.5) -> dict[str, Var]:
    """loss and its parts: known (cross-entropy of the real classes), second (``dummies_second``), mixed.

    mixed: means of two rows' features of different classes are taken for unknowns and belong to the dummies alike.
    """
    known = logits.shape[1] - dummies
    if len(labels) and not 0 <= labels.min() <= labels.max() < known:
        raise ValueError(f"labels must be from 0 to {known - 1}")
    parts = {"known": cross_entropy(columns_of(logits, 0, known), labels), "second": dummies_second(logits, labels, dummies)}
    loss = parts["known"] + parts["second"].scaled(beta)
    with_whom = rng.permutation(len(labels))
    at = np.flatnonzero(labels != labels[with_whom])
    if len(at):
        mixed = rows_of(features, at).scaled(share) + rows_of(features, with_whom[at]).scaled(1 - share)
        target = np.zeros((len(at), logits.shape[1]), logits.value.dtype)
        target[:, known:] = 1 / dummies
        parts["mixed"] = soft_cross_entropy(head(mixed), target)
        loss = loss + parts["mixed"].scaled(gamma)
    return {"loss": loss, **parts}
