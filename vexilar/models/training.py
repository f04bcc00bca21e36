"""Training by tasks, and features and predictions of a table's records.

An epoch is a job: every task starts from the same weights, goes over its own rows in batches, and returns its weights;
their mean over rows starts the next epoch. With one shard that is ordinary training. The driver holds one set of
weights a shard, of at most MOST_SHARDS, and rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.functions.rf import augment
from vexilar.models import losses
from vexilar.models.networks import Network
from vexilar.models.tape import Var, concat, rows_of
from vexilar.operators.knn import matrix
from vexilar.session import materialize

SHARD_ROWS, MOST_SHARDS = 20_000, 32
#: Records that go forward through a network at once where nothing is learned: a batch's activations are some 100 KB a record.
FORWARD_ROWS = 256


@dataclass(frozen=True)
class Recipe:
    """Settings of a training run; rates: learning rates by the beginnings of names, of which the longest that fits counts."""

    epochs: int = 20
    batch: int = 64
    rates: dict[str, float] = field(default_factory=lambda: {"": 1e-3})
    decay: float = 1e-4
    clip: float | None = None
    vary: bool = True
    contrast: float = 0.0
    temperature: float = 0.2
    beta: float = 1.0
    gamma: float = 1.0
    seed: int = 7


class AdamW:
    """Adam with decoupled decay over those parameters that have a rate."""

    def __init__(self, net: Network, recipe: Recipe, state: dict[str, np.ndarray] | None = None) -> None:
        self.net, self.recipe, state = net, recipe, state or {}
        fits = lambda n: [r for r in recipe.rates if n.startswith(r)]
        self.rate = {n: recipe.rates[max(fits(n), key=len)] for n in net.params if fits(n)}
        zero = lambda n: np.zeros_like(net.params[n])
        self.one = {n: state.get(f"o:{n}", zero(n)) for n in self.rate}
        self.two = {n: state.get(f"t:{n}", zero(n)) for n in self.rate}
        self.step = int(state.get("steps", 0))

    def state(self) -> dict[str, np.ndarray]:
        return {f"o:{n}": v for n, v in self.one.items()} | {f"t:{n}": v for n, v in self.two.items()} | {"steps": np.array(float(self.step))}

    def update(self, p: dict[str, Var]) -> None:
        grads = {n: p[n].grad if p[n].grad is not None else np.zeros_like(p[n].value) for n in self.rate}
        if self.recipe.clip is not None:
            size = np.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grads.values()))
            grads = {n: g * min(1.0, self.recipe.clip / (size + 1e-6)) for n, g in grads.items()}
        self.step += 1
        for n, g in grads.items():
            self.one[n] = 0.9 * self.one[n] + 0.1 * g
            self.two[n] = 0.999 * self.two[n] + 0.001 * g * g
            move = self.one[n] / (1 - 0.9**self.step) / (np.sqrt(self.two[n] / (1 - 0.999**self.step)) + 1e-8)
            self.net.params[n] = (self.net.params[n] * (1 - self.rate[n] * self.recipe.decay) - self.rate[n] * move).astype(self.net.dtype)


def _records(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([matrix(batch.column(c)) for c in ("i", "q")], axis=1)


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and logits of records, FORWARD_ROWS at a time, so that memory doesn't grow with what a worker gets at once."""
    parts = [tuple(v.value for v in net.forward(x[lo : lo + FORWARD_ROWS])) for lo in range(0, len(x), FORWARD_ROWS)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _varied(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.stack(augment(x[:, 0], x[:, 1], int(rng.integers(1 << 31))), axis=1)


Step = Callable[[Network, AdamW, np.ndarray, np.ndarray, np.ndarray, np.random.Generator], tuple[float, int]]


def closed_set_step(recipe: Recipe) -> Step:
    """Cross-entropy on varied records, with a contrastive loss between two variations or, with dummies, their losses."""

    def step(net: Network, opt: AdamW, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[float, int]:
        p = net.variables()
        feature, logits = net.forward(_varied(x, rng) if recipe.vary else x, p, training=True)
        if net.dummies:
            loss = losses.placeholders(feature, logits, y, lambda f: net.head(f, p), net.dummies, rng, recipe.beta, recipe.gamma)["loss"]
        else:
            loss = losses.cross_entropy(logits, y)
        if recipe.contrast:
            other, _ = net.forward(_varied(x, rng) if recipe.vary else x, p, training=True)
            loss = loss + losses.contrastive(concat([feature, other], 0), np.concatenate([y, y]), recipe.temperature).scaled(recipe.contrast)
        loss.backward()
        opt.update(p)
        return float(loss.value), int((logits.value[:, : net.classes].argmax(axis=1) == y).sum())

    return step


def incremental_step(recipe: Recipe, teacher: Network, memory: tuple[np.ndarray, np.ndarray], replay: float = 1.0, distill: float = 1.0, temperature: float = 2.0, contrast: float = 0.05, sure: float = 0.6) -> Step:
    """Weighted cross-entropy on new rows, that of replayed ones, distillation on those, and a contrastive loss on sure rows.

    Each batch goes with the next of the memory's, which begins again at its end.
    """
    mx, my = memory
    place = [0]

    def step(net: Network, opt: AdamW, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[float, int]:
        at = (place[0] + np.arange(min(recipe.batch, len(my)))) % max(len(my), 1)
        place[0] += len(at)
        n, p = len(y), net.variables()
        still = tuple(part for part in ("stem", "layer1", "layer2", "layer3") if not any(part.startswith(r) or r == "" for r in recipe.rates))
        feature, logits = net.forward(np.concatenate([x, mx[at]]), p, training=True, fixed=still)
        new, old = np.arange(n), n + np.arange(len(at))
        loss = losses.cross_entropy(rows_of(logits, new), y, w)
        if len(at):
            replayed = rows_of(logits, old)
            loss = loss + losses.cross_entropy(replayed, my[at]).scaled(replay)
            loss = loss + losses.distillation(replayed, teacher.forward(mx[at])[1].value[:, : teacher.classes], temperature).scaled(distill)
        chosen = np.concatenate([new[w >= sure], old])
        loss = loss + losses.contrastive(rows_of(feature, chosen), np.concatenate([y, my[at]])[chosen], recipe.temperature).scaled(contrast)
        loss.backward()
        opt.update(p)
        return float(loss.value), int((logits.value[:n].argmax(axis=1) == y).sum())

    return step


def _epochs(df: DataFrame, net: Network, recipe: Recipe, make: Callable[[], Step], epochs: int) -> Iterator[tuple[int, Network, float, float]]:
    """(epoch, network, mean loss, accuracy on its rows) after each epoch. df: label, weight, i, q."""
    rows = materialize(df.select(F.col("label").cast("bigint").alias("label"), F.col("weight").cast("double").alias("weight"), "i", "q"), "training_rows")
    n = rows.count()
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD_ROWS)))
    rows = materialize(rows.repartition(shards), "training_shards") if shards > 1 else rows.coalesce(1)
    kind, state = (net.kind, net.classes, net.features, net.dummies, net.dtype), net.to_bytes()
    for epoch in range(1, epochs + 1):

        def run(batches: Iterator[pa.RecordBatch], state: bytes = state, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            own = Network(kind[0], kind[1], kind[2], kind[3], dtype=kind[4])
            opt, step, rng = AdamW(own, recipe, own.load_bytes(state)), make(), np.random.default_rng((recipe.seed, epoch))
            seen, loss, right = 0, 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, w = _records(batch), batch.column("label").to_numpy(), batch.column("weight").to_numpy()
                order = rng.permutation(len(y))
                for k in range(0, len(order), recipe.batch):
                    at = order[k : k + recipe.batch]
                    got = step(own, opt, x[at], y[at], w[at], rng)
                    seen, loss, right = seen + len(at), loss + got[0] * len(at), right + got[1]
            if seen:
                yield pa.RecordBatch.from_pydict({"n": [seen], "loss": [loss], "right": [right], "state": pa.array([own.to_bytes(**opt.state())], pa.large_binary())})

        found = rows.mapInArrow(run, "n bigint, loss double, right bigint, state binary").collect()  # a row a shard
        if not found:
            return
        total = sum(r["n"] for r in found)
        sums: dict[str, np.ndarray] = {}
        for r in found:
            part = Network(*kind[:4], dtype=kind[4])
            for name, v in _named(part, part.load_bytes(bytes(r["state"]))).items():
                sums[name] = sums.get(name, 0) + v.astype(float) * (r["n"] / total)
        out = Network(*kind[:4], dtype=kind[4])
        out.params = {name: sums[f"p:{name}"].astype(net.dtype) for name in out.params}
        out.buffers = {name: sums[f"b:{name}"].astype(net.dtype) for name in out.buffers}
        state = out.to_bytes(**{name: v for name, v in sums.items() if name[:2] not in ("p:", "b:")})
        yield epoch, out, sum(r["loss"] for r in found) / total, sum(r["right"] for r in found) / total


def _named(net: Network, more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"p:{n}": v for n, v in net.params.items()} | {f"b:{n}": v for n, v in net.buffers.items()} | more


def evaluate(df: DataFrame, net: Network) -> tuple[float, float]:
    """(accuracy, mean loss) over the real classes; (0, infinity) without rows. df: label, i, q."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                net, y = sent.value, batch.column("label").to_numpy()
                logits = Var(_forward(net, _records(batch))[1][:, : net.classes])
                yield pa.RecordBatch.from_pydict({"n": [len(y)], "right": [int((logits.value.argmax(axis=1) == y).sum())], "loss": [float(losses.cross_entropy(logits, y).value) * len(y)]})

    own = df.select(F.col("label").cast("bigint").alias("label"), "i", "q")
    r = own.mapInArrow(run, "n bigint, right bigint, loss double").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("loss").alias("loss")).first()
    return (r["right"] / r["n"], r["loss"] / r["n"]) if r["n"] else (0.0, float("inf"))


def train_closed_set(train: DataFrame, validation: DataFrame, net: Network, recipe: Recipe | None = None) -> tuple[Network, DataFrame]:
    """The network of the epoch with the best validation accuracy, of equal ones the least loss, and the history.

    Tables: label, i, q. history: epoch, train_loss, train_accuracy, validation_loss, validation_accuracy, is_best.
    Without training rows the network stays as it is.
    """
    recipe = recipe or Recipe()
    best, top, history = net, (-1.0, float("inf")), []
    for epoch, now, loss, accuracy in _epochs(train.withColumn("weight", F.lit(1.0)), net, recipe, lambda: closed_set_step(recipe), recipe.epochs):
        right, lost = evaluate(validation, now)
        better = right > top[0] + 1e-12 or abs(right - top[0]) <= 1e-12 and lost < top[1]
        if better:
            best, top = now, (right, lost)
        history.append((epoch, loss, accuracy, lost, right, better))
    kinds = "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double, is_best boolean"
    return best, train.sparkSession.createDataFrame(history, kinds)


def train_incremental(student: Network, teacher: Network, current: DataFrame, memory: DataFrame, recipe: Recipe | None = None, warm_up: int = 2, joint: int = 8, head_rate: float = 1e-3, body_rate: float = 1e-4, **weights: float) -> Network:
    """The student after a round: its head alone, then with the last block and the feature layer.

    current: label, weight, i, q; memory: label, i, q, a few rows a class, which go along with every task. teacher: the
    network before the round.
    """
    base = recipe or Recipe(clip=5.0)
    rows = memory.select("label", "i", "q").collect()  # a replay memory is bounded by rows a class
    x = np.array([[r["i"], r["q"]] for r in rows]) if rows else np.zeros((0, 2, 1))
    kept = (x, np.array([r["label"] for r in rows], np.int64))
    stages = ((warm_up, {"head": head_rate}), (joint, {"head": head_rate, "layer3": body_rate, "feature": body_rate}))
    for epochs, rates in stages:
        own = Recipe(base.epochs, base.batch, rates, base.decay, base.clip, False, base.contrast, base.temperature, base.beta, base.gamma, base.seed)
        for _, student, _, _ in _epochs(current, student, own, lambda own=own: incremental_step(own, teacher, kept, **weights), epochs):
            pass
    return student


def extract(df: DataFrame, net: Network) -> DataFrame:
    """``df`` (i, q) with feature, logits (real classes, then dummies) and pred (of the real ones), a batch at a time."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("feature array<double>, logits array<double>, pred bigint")
    def run(i: pd.Series, q: pd.Series) -> pd.DataFrame:
        if not len(i):
            return pd.DataFrame({"feature": [], "logits": [], "pred": []})
        feature, logits = (v.astype(float) for v in _forward(sent.value, np.stack([np.stack(i.to_numpy()), np.stack(q.to_numpy())], axis=1)))
        return pd.DataFrame({"feature": list(feature), "logits": list(logits), "pred": logits[:, : sent.value.classes].argmax(axis=1)})

    found = df.withColumn("_f", run("i", "q"))
    return found.select(*df.columns, "_f.feature", "_f.logits", "_f.pred")
