"""Toxicity by a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's embedding is the mean of rows that the word and its beginnings hash to, so that inflected and compound forms
of a known word are near it. Filters of several widths slide over the words, and the maximum of each over the whole
text goes to a logistic layer. A model is a few small arrays, so it travels with the tasks. Training reads every
labelled row of its folds: few on the driver, more in rounds of all tasks, whose weights are averaged after each. Scoring
reads every text whole, in runs of words that overlap by a filter's width.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vexilar.llm.arrow import give_back, map_arrow, slices
from vexilar.llm.text import own_columns
from vexilar.operators.prefix import running
from vexilar.session import brief_shuffles, materialize

#: Labelled rows, and words of all of them together, that the driver learns from by itself; more are left to the tasks.
LOCAL_ROWS, LOCAL_WORDS = 24_000, 6_000_000
#: Labelled rows of a shard, shards at most, and rows and words that a task holds at once.
SHARD_ROWS, MOST_SHARDS, HELD_ROWS, HELD_WORDS = 10_000, 32, 20_000, 4_000_000
#: Labels that are broadcast at most; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Score above which predicted is 1: a fixed value of the contract.
CUT = 0.3
#: Share of toxic ones among what a calibrated cut rejects, at least.
PRECISION = 0.7
#: Words of a text that are scored at once.
RUN = 65_536


@dataclass
class Settings:
    buckets: int = 1 << 16
    width: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    prefixes: tuple[int, ...] = (3, 5, 7)
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 5
    least_steps: int = 1_000  # small samples are read more often, 40 times at most

    @property
    def parts(self) -> int:
        """Embedding rows a word has: its own and one for each prefix length."""
        return 1 + len(self.prefixes)


class Model:
    """Weights: e (buckets x width), a filter bank w_k (k * width x filters) with bias b_k for each width k, v, c."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.p = {"e": rng.normal(0, 0.3, (s.buckets, s.width)).astype(np.float32)}
        self.p["e"][0] = 0  # of padding
        for k in s.widths:
            self.p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * s.width), (k * s.width, s.filters)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(s.filters, np.float32)
        self.p["v"] = rng.normal(0, 0.1, s.filters * len(s.widths)).astype(np.float32)
        self.p["c"] = np.float32(-1.0)
        self.shift, self.scale = 0.0, 1.0
        self.thresholds: dict[str, float] = {}

    def _windows(self, x: np.ndarray, k: int) -> np.ndarray:
        """(n, k * width) views of the embedded words x, zeros after the end."""
        if k == 1:
            return x
        padded = np.concatenate([x, np.zeros((k - 1, x.shape[1]), x.dtype)])
        return np.concatenate([padded[i : i + len(x)] for i in range(k)], axis=1)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """(n, width) embeddings of words given by their (n, parts) rows; row 0 adds nothing."""
        out = self.p["e"][ids[:, 0]]
        for part in range(1, ids.shape[1]):
            out += self.p["e"][ids[:, part]]
        return out / np.float32(ids.shape[1])

    def pool(self, x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, dict]:
        """Maxima of every filter over each text; x: all texts' embedded words end to end, as ``_layout`` puts them.

        Filters begin at the rows from starts to stops, so that none reaches beyond a text's own padding.
        """
        edges = np.stack([starts, stops], axis=1).ravel()
        out, kept = [], {"x": x}
        for k in self.s.widths:
            wide = self._windows(x, k)
            a = wide @ self.p[f"w{k}"]
            out.append(np.maximum.reduceat(a, edges, axis=0)[::2])
            kept[k] = (wide, a)
        return np.concatenate(out, axis=1), kept

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.p[f"b{k}"] for k in self.s.widths])
        return np.maximum(pooled + bias, 0) @ self.p["v"] + self.p["c"]

    def scores(self, logits: np.ndarray) -> np.ndarray:
        """Probabilities after calibration, which puts the best cut at CUT."""
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def _layout(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (arrays of one row a word) end to end, where each begins, and where it ends.

    Each is followed by ``pad`` rows of zeros, an empty one has a row of zeros, and one more stands at the very end.
    """
    zeros = np.zeros((pad + 1, *texts[0].shape[1:]), texts[0].dtype)
    parts = [p for t in texts for p in (t, zeros[:pad] if len(t) else zeros)]
    sizes = np.array([max(len(t), 1) for t in texts])
    starts = np.cumsum(sizes + pad) - sizes - pad
    return np.concatenate([*parts, zeros[:1]]), starts, starts + sizes


WORD = re.compile(r"[^\W_]+")


def _hash(word: str, seed: int) -> int:
    try:
        return xxh64_intdigest(word, seed)
    except UnicodeEncodeError:  # half a surrogate pair
        return xxh64_intdigest(word.encode(errors="replace"), seed)


def word_rows(word: str, s: Settings, heads: dict[str, int] | None = None) -> list[int]:
    """The embedding rows of a lower-case word: its hash, and that of each beginning it is longer than, else 0. heads: known rows of beginnings."""
    heads, most = {} if heads is None else heads, s.buckets - 1
    rows = [_hash(word, 0) % most + 1]
    for n in s.prefixes:
        if len(word) <= n:
            rows.append(0)
            continue
        head = word[:n]
        if (row := heads.get(head)) is None:
            heads[head] = row = _hash(head, n) % most + 1
        rows.append(row)
    return rows


class Words:
    """Numbers for words, with the embedding rows of each; begins afresh when it holds ``most``."""

    def __init__(self, s: Settings, most: int = 150_000) -> None:
        self.s, self.most = s, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.heads: dict[str, int] = {}  # a beginning's length is its seed, so beginnings of all lengths share it
        self.rows = np.zeros((0, self.s.parts), np.int32)
        self.fresh = array("i")  # flat: no object a word

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words in order."""
        return self.numbers(WORD.findall((text or "").lower()))

    def of_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """``of`` each text; each of their different words is looked up once."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        flat = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        every = self.numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        return np.split(every, np.cumsum([len(w) for w in words])[:-1])

    def numbers(self, words: list[str]) -> np.ndarray:
        found = list(map(self.number.get, words))
        if None in found:
            fresh = dict.fromkeys(w for w, n in zip(words, found) if n is None)
            for w in fresh:
                self.fresh.extend(word_rows(w, self.s, self.heads))
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            found = list(map(self.number.__getitem__, words))
        return np.array(found, np.int32)

    def table(self) -> np.ndarray:
        """(numbers, parts): the embedding rows of all numbers given out."""
        if self.fresh:
            self.rows = np.concatenate([self.rows, np.array(self.fresh, np.int32).reshape(-1, self.s.parts)])
            self.fresh = array("i")
        return self.rows


def gradients(m: Model, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(loss, gradients but of the embeddings, embedding rows that have one, theirs) of a batch laid out by ``_layout``.

    loss: the mean logistic loss. Row 0, padding, has no gradient.
    """
    s = m.s
    pooled, kept = m.pool(m.embed(ids), starts, stops)
    bias = np.concatenate([m.p[f"b{k}"] for k in s.widths])
    active = np.maximum(pooled + bias, 0)
    logits = np.clip(active @ m.p["v"] + m.p["c"], -30, 30)
    loss = float(np.mean(np.logaddexp(0, logits) - y * logits))
    miss = (1 / (1 + np.exp(-logits)) - y) / len(y)
    grads = {"v": active.T @ miss, "c": miss.sum()}
    back = np.outer(miss, m.p["v"]) * (pooled + bias > 0)
    dx = np.zeros_like(kept["x"])
    for j, k in enumerate(s.widths):
        wide, a = kept[k]
        part = back[:, j * s.filters : (j + 1) * s.filters]
        top = np.stack([lo + a[lo:hi].argmax(axis=0) for lo, hi in zip(starts, stops)])  # rows x filters
        grads[f"b{k}"] = part.sum(axis=0)
        gw = np.zeros_like(m.p[f"w{k}"])
        for f in range(s.filters):
            gw[:, f] = wide[top[:, f]].T @ part[:, f]
            to = np.outer(part[:, f], m.p[f"w{k}"][:, f]).reshape(len(y), k, s.width)
            for i in range(k):
                at = top[:, f] + i
                ok = at < len(ids)
                np.add.at(dx, at[ok], to[ok, i])
        grads[f"w{k}"] = gw
    used = np.flatnonzero(np.abs(dx).sum(axis=1))
    words, inverse = np.unique(ids[used].ravel(), return_inverse=True)
    ge = np.zeros((len(words), s.width), dx.dtype)
    np.add.at(ge, inverse.ravel(), np.repeat(dx[used] / s.parts, s.parts, axis=0))
    ge[words == 0] = 0
    return loss, grads, words, ge


def _epochs(s: Settings, rows: int) -> int:
    return max(s.epochs, min(40, -(-s.least_steps * s.batch // rows)))


def _rate(s: Settings, epoch: int, epochs: int) -> float:
    return s.rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))


class Adam:
    """Adam on a model's weights, with moments of its own."""

    def __init__(self, m: Model) -> None:
        self.m, self.steps = m, 0
        self.moment = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in m.p.items()}

    def epoch(self, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """Once over the texts: those of like length share a batch, batches come in random order."""
        s = self.m.s
        order = np.argsort([len(t) + rng.integers(0, 50) for t in texts], kind="stable")
        batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            self._step(gradients(self.m, *_layout([texts[r] for r in rows], max(s.widths) - 1), y[rows]), rate)

    def _step(self, found: tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray], rate: float) -> None:
        m, (_, grads, words, ge) = self.m, found
        self.steps += 1
        correct = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for n, g in grads.items():
            one, two = self.moment[n]
            one = 0.9 * one + 0.1 * g
            two = 0.999 * two + 0.001 * g * g
            self.moment[n] = (one, two)
            m.p[n] = (m.p[n] - rate * correct * one / (np.sqrt(two) + 1e-8)).astype(np.float32)
        one, two = self.moment["e"]
        one[words] = 0.9 * one[words] + 0.1 * ge
        two[words] = 0.999 * two[words] + 0.001 * ge * ge
        m.p["e"][words] -= rate * correct * one[words] / (np.sqrt(two[words]) + 1e-8)

    def state(self) -> dict[str, np.ndarray]:
        """Weights and moments by name, each flat."""
        every = {f"p:{n}": v for n, v in self.m.p.items()} | {f"{k}:{n}": v for n, pair in self.moment.items() for k, v in zip("12", pair)}
        return {n: np.asarray(v, np.float32).ravel() for n, v in every.items()}

    def load(self, state: dict[str, np.ndarray], steps: int) -> None:
        shaped = lambda k, n: state[f"{k}:{n}"].reshape(np.shape(self.m.p[n])).copy()
        self.moment = {n: (shaped("1", n), shaped("2", n)) for n in self.m.p}
        self.m.p = {n: shaped("p", n) for n in self.m.p}
        self.steps = steps


def train(texts: list[np.ndarray], labels: np.ndarray, settings: Settings | None = None) -> Model:
    """Fits a model with Adam on the logistic loss. texts: (words, parts) arrays of rows; labels: 0 or 1.

    With no row of one of the classes there is nothing to learn: the model then scores every text with the share of
    toxic rows (0 without rows).
    """
    s = settings or Settings()
    m = Model(s)
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        m.p["v"][:] = 0
        m.p["c"] = np.float32(-30 if len(y) == 0 or y[0] == 0 else 30)
        return m
    rng, adam = np.random.default_rng(s.seed + 1), Adam(m)
    epochs = _epochs(s, len(texts))
    for epoch in range(epochs):
        adam.epoch(texts, y, rng, _rate(s, epoch, epochs))
    return m


def best_range(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(below, at most): the cuts (score >= cut is toxic) with the best F1 of those with a precision of at least PRECISION.

    Without such a cut only the greatest score is above it.
    """
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[hits < PRECISION * np.arange(1, len(y) + 1)] = 0
    f1[:-1][s[:-1] == s[1:]] = 0  # a cut can't part equal scores
    k = int(f1.argmax())
    return (float(s[k + 1]) if k + 1 < len(s) else float(s[k])), float(s[k])


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of ``best_range`` in log-odds."""
    ends = np.clip(best_range(scores, labels), 1e-9, 1 - 1e-9)
    return float(1 / (1 + np.exp(-np.log(ends / (1 - ends)).mean())))


def score_texts(m: Model, texts: list[np.ndarray], vectors: np.ndarray | None = None) -> np.ndarray:
    """Calibrated scores of whole texts, in runs of at most RUN words.

    texts: (words, parts) arrays of rows, or with ``vectors`` arrays of row numbers in that table of embeddings.
    """
    pad = max(m.s.widths) - 1
    best = np.full((len(texts), m.s.filters * len(m.s.widths)), -np.inf, np.float32)
    queue: list[tuple[int, np.ndarray, bool]] = []
    held = 0

    def flush() -> None:
        nonlocal queue, held
        if queue:
            x, starts, stops = _layout([m.embed(t) if vectors is None else vectors[t] for _, t, _ in queue], pad)
            stops = np.where([more for *_, more in queue], starts + RUN, stops)  # where a text goes on, the next run has the rest
            np.maximum.at(best, [r for r, *_ in queue], m.pool(x, starts, stops)[0])
        queue, held = [], 0

    for r, t in enumerate(texts):
        for lo in range(0, max(len(t), 1), RUN):
            part = t[lo : lo + RUN + pad]
            queue.append((r, part, lo + RUN < len(t)))
            held += len(part)
            if held >= RUN:
                flush()
    flush()
    return m.scores(m.logits(best)) if len(texts) else np.zeros(0)


# ---- Spark ----

def _kind(s: Settings) -> type:
    """The numbers that embedding rows are stored as."""
    return np.uint16 if s.buckets <= 1 << 16 else np.int32


def _make_rows(s: Settings):
    kind = _kind(s)

    def make():
        words = Words(s)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = words.of_all(batch.column("_text").to_pylist())
            table = words.table().astype(kind)
            kept = [batch.column(n) for n in ("_id", "_h", "toxic", "lang")]
            out = pa.RecordBatch.from_arrays([*kept, pa.array(map(len, ids), pa.int32()), pa.array([table[i].tobytes() for i in ids], pa.binary())], names=["_id", "_h", "toxic", "lang", "n", "ids"])
            if len(words.number) > words.most:
                words.clear()
            return out

        return step

    return make


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, rows: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, toxic, lang, n, ids): the labelled documents of the folds to learn from; ids holds a text's embedding rows, n its words.

    With ``rows`` at most so many, chosen by a hash of the id.

    Folds: crc32 of the id as text modulo 4; remainder 2 is held out. Rows without a label, text or id aren't used; of
    an id with several labels the greatest counts, of one with several texts the least. The choice is the same at every run.
    """
    lab = own_columns(labels, _lid="doc_id", _toxic="toxic").where("_toxic is not null and _lid is not null").where("crc32(cast(_lid as string)) % 4 <> 2")
    lab = lab.groupBy("_lid").agg(F.max("_toxic").alias("_toxic"))
    chosen = lab.withColumn("_h", F.xxhash64("_lid", F.lit(11)))
    if rows is not None:
        chosen = chosen.orderBy("_h", "_lid").limit(rows)  # top-k: a heap a task
    few = (labels.count() if rows is None else rows) <= BROADCAST_LABELS
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    own = own_columns(docs, _id=doc_id, _text=text, _lang=lang.cast("string"))
    found = own.join(F.broadcast(chosen) if few else chosen, F.col("_id") == F.col("_lid")).select("_id", "_h", F.col("_toxic").cast("int").alias("toxic"), F.coalesce("_lang", F.lit("")).alias("lang"), F.col("_text").cast("string").alias("_text"))
    # one row an id, the least text: only rows whose ids repeat are shuffled with their texts
    kept = ["_id", "_h", "toxic", "lang", "_text"]
    least = lambda df: df.groupBy("_id").agg(F.min(F.struct("_text", "lang")).alias("_t"), F.max("_h").alias("_h"), F.max("toxic").alias("toxic")).select("_id", "_h", "toxic", F.col("_t.lang").alias("lang"), F.col("_t._text").alias("_text"))
    repeated = materialize(found.groupBy("_id").count().where("count > 1").select("_id"), "repeated_ids") if few else None
    if repeated is None or (many := repeated.count()) > BROADCAST_LABELS:
        found = least(found)
    elif many:
        by = F.broadcast(repeated)
        found = found.join(by, "_id", "left_anti").select(kept).union(least(found.join(by, "_id", "left_semi")).select(kept))
    return map_arrow(found, _make_rows(settings), f"_id {dict(found.dtypes)['_id']}, _h bigint, toxic int, lang string, n int, ids binary", "_text")


def _held(batches: Iterator[pa.RecordBatch], parts: int, kind: type) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(texts, labels) of the rows of a task, at most HELD_ROWS rows or HELD_WORDS words, or one row, at a time."""
    texts, y, words = [], [], 0
    for batch in batches:
        for ids, toxic in zip(batch.column("ids").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            t = np.frombuffer(ids, kind).reshape(-1, parts)
            if texts and (len(texts) == HELD_ROWS or words + len(t) > HELD_WORDS):
                yield texts, np.array(y, np.float32)
                texts, y, words = [], [], 0
            texts.append(t)
            y.append(toxic)
            words += len(t)
    if texts:
        yield texts, np.array(y, np.float32)


#: Numbers of a weight that one row holds on its way to the mean.
PIECE = 65_536


def _mean_state(rows: DataFrame, s: Settings, sent, epoch: int, rate: float) -> tuple[dict[str, np.ndarray], int]:
    """Weights and moments after an epoch, averaged over shards by their rows, and the steps of the longest; sent: (state, steps)."""
    kind = _kind(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, rows = Adam(Model(s)), 0
        adam.load(*sent.value)
        began, rng = adam.steps, np.random.default_rng((s.seed, epoch))
        for texts, y in _held(batches, s.parts, kind):
            adam.epoch(texts, y, rng, rate)
            rows += len(y)
        for name, v in adam.state().items() if rows else ():
            for lo in range(0, len(v), PIECE):
                yield pa.RecordBatch.from_pydict({"name": [name], "at": [lo], "rows": [rows], "steps": [adam.steps - began], "v": [v[lo : lo + PIECE].tobytes()]})
        give_back()

    def mean(t: pa.Table) -> pa.Table:
        n = t.column("rows").to_numpy()
        v = sum(np.frombuffer(x, np.float32) * (k / n.sum()) for x, k in zip(t.column("v").to_pylist(), n.tolist(), strict=True))
        return pa.table({"name": t.column("name")[:1], "at": t.column("at")[:1], "rows": [int(n.sum())], "steps": [int(t.column("steps").to_numpy().max())], "v": [v.astype(np.float32).tobytes()]})

    schema = "name string, at bigint, rows bigint, steps bigint, v binary"
    found = rows.select("toxic", "ids").mapInArrow(run, schema).groupBy("name", "at").applyInArrow(mean, schema).collect()  # one set of weights
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["name"], r["at"])):
        pieces.setdefault(r["name"], []).append(bytes(r["v"]))
    return {n: np.frombuffer(b"".join(v), np.float32) for n, v in pieces.items()}, max(r["steps"] for r in found)


def _best_ranges(scored: DataFrame, keys: list[str]) -> list[Row]:
    """(keys, below, most, hits): ``best_range`` of (keys, score, toxic) for each key, and the toxic rows; a row a key."""
    each = scored.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("toxic").cast("bigint").alias("hits"))
    sums = running(each, keys, [F.desc("score")], {"every": "h"}, h=F.col("hits"), k=F.col("n"))
    f1 = F.when(F.col("h") >= PRECISION * F.col("k"), 2 * F.col("h") / (F.col("k") + F.col("every"))).otherwise(0.0)
    best = sums.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), F.col("score").alias("most"))).alias("_b"), F.max("every").alias("every"))
    best = best.select(*keys, F.col("_b.most").alias("most"), F.col("every").alias("hits"))
    both = each.join(F.broadcast(best.drop("hits")), keys) if keys else each.crossJoin(F.broadcast(best.drop("hits")))  # a row a language
    lower = both.groupBy(*keys, "most").agg(F.max(F.when(F.col("score") < F.col("most"), F.col("score"))).alias("below"))
    out = lower.join(best.drop("most"), keys) if keys else lower.crossJoin(best.drop("most"))
    return out.select(*keys, F.coalesce("below", "most").alias("below"), "most", "hits").collect()


def fit_on(rows: DataFrame, settings: Settings) -> Model:
    """``fit`` over stored ``training_rows`` of any number: shards learn side by side, and the driver holds one set of weights.

    Every row is learned from or, a fifth of them by hash, calibrates.
    """
    s = settings
    # hashes of ids, not their places: the same rows calibrate however the table is stored
    held_back = F.pmod(F.col("_h"), F.lit(5)) == 0
    learned, counts = rows.where(~held_back), rows.where(~held_back).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).first()
    n, hits = counts["n"], counts["hits"] or 0
    if not 0 < hits < n:
        return train([], np.zeros(0), s) if not hits else train([np.zeros((0, s.parts), np.int32)], np.ones(1), s)
    shards = min(MOST_SHARDS, -(-n // SHARD_ROWS))
    with brief_shuffles(rows.sparkSession):
        learned = materialize(learned.select("_h", "_id", "toxic", "ids").repartition(shards, "_h").sortWithinPartitions("_h", "_id"), "toxicity_shards")
    m = Model(s)
    now, epochs, context = (Adam(m).state(), 0), _epochs(s, n), rows.sparkSession.sparkContext
    for epoch in range(epochs):
        sent = context.broadcast(now)  # 3 sets of buckets x width floats, whatever the input
        with brief_shuffles(rows.sparkSession):  # a set of weights a shard
            state, steps = _mean_state(learned, s, sent, epoch, _rate(s, epoch, epochs))
        now = (state, now[1] + steps)
        sent.destroy()
    adam = Adam(m)
    adam.load(*now)
    sent = context.broadcast(m)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = [np.frombuffer(x, _kind(s)).reshape(-1, s.parts) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(score_texts(sent.value, ids), pa.float64())], names=["lang", "toxic", "score"])

    scored = materialize(rows.where(held_back).select("lang", "toxic", "ids").mapInArrow(score, "lang string, toxic int, score double"), "toxicity_scores")
    seen, toxic = scored.agg(F.count("*"), F.sum("toxic")).first()
    if not 0 < (toxic or 0) < seen:
        return m
    middle = lambda below, most: float(1 / (1 + np.exp(-_log_odds(np.array([below, most])).mean())))
    every = _best_ranges(scored, [])[0]
    cut = min(max(middle(every["below"], every["most"]), 1e-4), 1 - 1e-4)
    m.shift = float(np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut)))
    for r in _best_ranges(scored, ["lang"]):
        if r["hits"] >= 20:
            below, most = 1 / (1 + np.exp(-(_log_odds(np.array([r["below"], r["most"]])) + m.shift)))
            m.thresholds[r["lang"]] = CUT if below < CUT <= most else middle(below, most)
    return m


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, rows: int | None = None, words: int | None = None, **columns: str) -> Model:
    """A calibrated model from all labelled rows of the folds to learn from.

    Up to LOCAL_ROWS rows and LOCAL_WORDS words come to the driver as bucket numbers; more are learned from where they lie, see
    ``fit_on``. A caller may ask for fewer, ``rows`` rows and ``words`` words at most: rows are taken in the
    order of their hash, and one that doesn't fit is passed over for those after it. A fifth of them (by hash) isn't trained on and calibrates: a shift of
    the logit puts the best F1 at CUT, and each language with at least 20 toxic rows there gets a threshold: CUT if
    that is among its best, else one of its own. Scores don't see the language.
    """
    s = settings or Settings()
    with brief_shuffles(docs.sparkSession):  # of texts, where labels are many
        stored = materialize(training_rows(docs, labels, s, rows, **columns).withColumn("_row", F.monotonically_increasing_id()), "toxicity_rows")
    if rows is None and words is None:
        n, every = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n > LOCAL_ROWS or every > LOCAL_WORDS:
            return fit_on(stored, s)
    words = LOCAL_WORDS if words is None else words
    picked, held, skipped = [], 0, 0
    for r in stored.select("_h", "_id", "_row", "n").orderBy("_h", "_id", "_row").toLocalIterator():
        if held + r["n"] > words:
            skipped += 1
            continue
        held += r["n"]
        picked.append((r["_row"],))
    if skipped:
        stored = stored.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "_row bigint")), "_row")
    texts, toxic, langs = [], [], []
    for r in stored.select("_h", "_id", "_row", "toxic", "lang", "ids").orderBy("_h", "_id", "_row").toLocalIterator():
        texts.append(np.frombuffer(r["ids"], _kind(s)).reshape(-1, s.parts))
        toxic.append(r["toxic"])
        langs.append(r["lang"])
    y, lang = np.array(toxic, np.float32), np.array(langs)
    part = np.arange(len(y)) % 5 == 0
    m = train([t for t, p in zip(texts, part) if not p], y[~part], s)
    if part.any() and 0 < y[part].sum() < part.sum():
        raw = score_texts(m, [t for t, p in zip(texts, part) if p])
        cut = min(max(best_cut(raw, y[part]), 1e-4), 1 - 1e-4)
        m.shift = float(np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut)))
        shifted = 1 / (1 + np.exp(-(np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1)) + m.shift)))
        for name in np.unique(lang[part]):
            own = lang[part] == name
            if y[part][own].sum() >= 20:
                below, most = best_range(shifted[own], y[part][own])
                m.thresholds[str(name)] = CUT if below < CUT <= most else best_cut(shifted[own], y[part][own])
    return m


def _make_scorer(sent):
    def make():
        m = sent.value
        words = Words(m.s)
        vectors = np.zeros((0, m.s.width), np.float32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal vectors
            texts = words.of_all(batch.column("_text").to_pylist())
            if len(words.number) > len(vectors):
                vectors = np.concatenate([vectors, m.embed(words.table()[len(vectors) :])])
            scores = score_texts(m, texts, vectors)
            if len(words.number) > words.most:
                words.clear()
                vectors = vectors[:0]
            return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_lang"), pa.array(scores, pa.float64())], names=["_id", "_lang", "score"])

        return step

    return make


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (score >= CUT), flagged.

    flagged uses the threshold calibrated for the row's language where there is one, else CUT. Null and empty texts
    are scored as texts without words; repeated rows each get a row; ids may be null (held_out is false then); other
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: buckets x width floats, whatever the input
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    own = own_columns(docs, _id=doc_id, _lang=F.coalesce(lang.cast("string"), F.lit("")), _text=F.col(f"`{text}`").cast("string"))
    found = map_arrow(own, _make_scorer(sent), f"_id {dict(docs.dtypes)[doc_id]}, _lang string, score double", "_text")
    limit = F.lit(CUT)
    for name, cut in model.thresholds.items():
        limit = F.when(F.col("_lang") == name, F.lit(cut)).otherwise(limit)
    held = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select(F.col("_id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))


def _make_judge(sent, names: list[str], text: str, lang: str | None):
    def make():
        scorer, cuts = _make_scorer(sent)(), sent.value.thresholds

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows, pa.string())
            scored = scorer(pa.RecordBatch.from_arrays([none, none, batch.column(text)], names=["_id", "_lang", "_text"]))
            langs = batch.column(lang).to_pylist() if lang else [None] * batch.num_rows
            kept = pa.compute.less(scored.column("score"), pa.array([cuts.get(x or "", CUT) for x in langs], pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names).filter(kept)

        return step

    return make


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that score below the threshold of their language, all columns unchanged.

    A language without a threshold of its own, or a table without the column ``lang``, has CUT. Null texts count as
    empty ones; repeated rows stay repeated; an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    known = lang if dict(docs.dtypes).get(lang) == "string" else None
    return map_arrow(docs, _make_judge(sent, docs.columns, text, known), schema, text)
