"""Networks from records (rows, 2, length) to features and logits: a residual one, and a wide-fronted one for long records."""

from __future__ import annotations

import io
import json

import numpy as np

from vexilar.models import tape
from vexilar.models.tape import Var
from vexilar.sources.store import read_range, store, write_file

# Fixed values: (name, channels in, out, width, stride, dilation) of the residual blocks, and the fronts' widths.
BLOCKS = {
    "residual": (("layer1", 32, 64, 7, 2, 1), ("layer2", 64, 128, 5, 2, 1), ("layer3", 128, 128, 3, 2, 1)),
    "long": (("layer1", 96, 128, 9, 2, 1), ("layer2", 128, 256, 7, 2, 2), ("layer3", 256, 256, 5, 2, 2)),
}
FRONTS = {"residual": ((7, 1),), "long": ((7, 2), (15, 2), (31, 2))}


class Network:
    """params and buffers by name; classes real ones, then ``dummies`` virtual ones for what is unknown."""

    def __init__(self, kind: str = "residual", classes: int = 10, features: int = 128, dummies: int = 0, seed: int = 7, dtype=np.float32) -> None:
        self.kind, self.classes, self.features, self.dummies, self.dtype = kind, classes, features, dummies, dtype
        self.params: dict[str, np.ndarray] = {}
        self.buffers: dict[str, np.ndarray] = {}
        rng = np.random.default_rng(seed)

        def uniform(*shape: int) -> np.ndarray:
            bound = 1 / np.sqrt(np.prod(shape[1:]))
            return rng.uniform(-bound, bound, shape).astype(dtype)

        def norm(name: str, n: int, running: bool = True) -> None:
            self.params[f"{name}.gain"], self.params[f"{name}.bias"] = np.ones(n, dtype), np.zeros(n, dtype)
            if running:
                self.buffers[f"{name}.mean"], self.buffers[f"{name}.var"] = np.zeros(n, dtype), np.ones(n, dtype)

        for width, _ in FRONTS[kind]:
            self.params[f"stem{width}.w"] = uniform(32, 2, width)
        norm("stem", 32 * len(FRONTS[kind]))
        for name, a, b, width, _, _ in BLOCKS[kind]:
            self.params[f"{name}.one.w"], self.params[f"{name}.two.w"], self.params[f"{name}.skip.w"] = uniform(b, a, width), uniform(b, b, width), uniform(b, a, 1)
            for part in ("one", "two", "skip"):
                norm(f"{name}.{part}", b)
        last = BLOCKS[kind][-1][2]
        if kind == "long":
            self.params |= {"attention.one.w": uniform(64, last, 1), "attention.one.b": np.zeros(64, dtype), "attention.two.w": uniform(1, 64, 1), "attention.two.b": np.zeros(1, dtype)}
            norm("feature.norm", features, running=False)
        self.params["feature.w"], self.params["feature.b"] = uniform(features, last).T.copy(), np.zeros(features, dtype)
        self.params["head.w"], self.params["head.b"] = uniform(classes + dummies, features).T.copy(), np.zeros(classes + dummies, dtype)

    def variables(self) -> dict[str, Var]:
        return {n: Var(v) for n, v in self.params.items()}

    def _norm(self, x: Var, p: dict[str, Var], name: str, training: bool) -> Var:
        return tape.batch_norm(x, p[f"{name}.gain"], p[f"{name}.bias"], (self.buffers[f"{name}.mean"], self.buffers[f"{name}.var"]), training)

    def head(self, feature: Var, p: dict[str, Var]) -> Var:
        return tape.linear(feature, p["head.w"], p["head.b"])

    def forward(self, x: np.ndarray, p: dict[str, Var] | None = None, training: bool = False, fixed: tuple[str, ...] = ()) -> tuple[Var, Var]:
        """(features, logits). fixed: parts whose running statistics stay in training too, by the beginnings of their names."""
        p = p or self.variables()
        act = tape.relu if self.kind == "residual" else tape.silu
        learns = lambda name: training and not name.startswith(fixed) if fixed else training
        x = Var(np.asarray(x, self.dtype))
        x = tape.concat([tape.conv(x, p[f"stem{w}.w"], stride=s, padding=w // 2) for w, s in FRONTS[self.kind]], 1)
        x = act(self._norm(x, p, "stem", learns("stem")))
        if self.kind == "long":
            x = tape.max_pool(x, 4)
        for name, _, _, width, stride, dilation in BLOCKS[self.kind]:
            pad = dilation * (width // 2)
            y = act(self._norm(tape.conv(x, p[f"{name}.one.w"], None, stride, pad, dilation), p, f"{name}.one", learns(name)))
            y = self._norm(tape.conv(y, p[f"{name}.two.w"], None, 1, pad, dilation), p, f"{name}.two", learns(name))
            x = act(y + self._norm(tape.conv(x, p[f"{name}.skip.w"], None, stride), p, f"{name}.skip", learns(name)))
        if self.kind == "long":
            score = tape.conv(tape.tanh(tape.conv(x, p["attention.one.w"], p["attention.one.b"])), p["attention.two.w"], p["attention.two.b"])
            feature = tape.linear(tape.weighted_over_places(x, score), p["feature.w"], p["feature.b"])
            feature = tape.layer_norm(feature, p["feature.norm.gain"], p["feature.norm.bias"])
        else:
            feature = tape.linear(tape.mean_over_places(x), p["feature.w"], p["feature.b"])
        return feature, self.head(feature, p)

    def widened(self, classes: int, rows: np.ndarray | None = None, seed: int = 7) -> Network:
        """A copy with more classes; rows: weights of the new ones (new, features), without bias, else drawn anew."""
        out = Network(self.kind, classes, self.features, self.dummies, seed, self.dtype)
        fresh_w, fresh_b = out.params["head.w"].copy(), out.params["head.b"].copy()
        out.params = {n: v.copy() for n, v in self.params.items()}
        out.buffers = {n: v.copy() for n, v in self.buffers.items()}
        old = self.classes
        w, b = fresh_w, fresh_b
        w[:, :old], b[:old] = self.params["head.w"][:, :old], self.params["head.b"][:old]
        if self.dummies:
            w[:, classes:], b[classes:] = self.params["head.w"][:, old:], self.params["head.b"][old:]
        if rows is not None:
            w[:, old:classes], b[old:classes] = np.asarray(rows).T, 0
        out.params["head.w"], out.params["head.b"] = w, b
        return out

    # -- storage --

    def to_bytes(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"p:{n}": v for n, v in self.params.items()}, **{f"b:{n}": v for n, v in self.buffers.items()}, **more)
        return out.getvalue()

    def load_bytes(self, data: bytes) -> dict[str, np.ndarray]:
        """Takes over stored values; returns what was stored beside them."""
        z = np.load(io.BytesIO(data), allow_pickle=False)
        self.params = {n[2:]: z[n] for n in z.files if n.startswith("p:")}
        self.buffers = {n[2:]: z[n] for n in z.files if n.startswith("b:")}
        return {n: z[n] for n in z.files if n[:2] not in ("p:", "b:")}

    def save(self, path: str, **metadata) -> None:
        """A checkpoint: an archive of arrays with its shape and the metadata as JSON."""
        about = json.dumps({"kind": self.kind, "classes": self.classes, "features": self.features, "dummies": self.dummies, "metadata": metadata})
        write_file(path, self.to_bytes(about=np.array(about)))


def load(path: str) -> tuple[Network, dict]:
    """(network, metadata) of a checkpoint."""
    files, at = store(path)
    data = read_range(path, 0, files.get_file_info(at).size)
    about = json.loads(str(np.load(io.BytesIO(data), allow_pickle=False)["about"]))
    net = Network(about["kind"], about["classes"], about["features"], about["dummies"])
    net.load_bytes(data)
    return net, about["metadata"]
