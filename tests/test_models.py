"""Networks and losses against finite differences and plain loops; training on planted records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexilar.models import losses, networks, tape, training


def slopes(f, arrays, rng, picks=6, step=1e-6):
    """Largest gap between gradients and finite differences at a few places of every array. f: arrays to a scalar Var."""
    made = {n: tape.Var(v.copy()) for n, v in arrays.items()}
    f(made).backward()
    gap = 0.0
    for n, v in arrays.items():
        for _ in range(picks):
            at = tuple(rng.integers(0, s) for s in v.shape)
            ends = []
            for sign in (1, -1):
                moved = {m: tape.Var(w.copy()) for m, w in arrays.items()}
                moved[n].value[at] += sign * step
                ends.append(float(f(moved).value))
            gap = max(gap, abs((ends[0] - ends[1]) / (2 * step) - float(made[n].grad[at])))
    return gap


@pytest.mark.parametrize("kind,length", [("residual", 24), ("long", 160)])
def test_gradients_of_networks(kind, length):
    rng = np.random.default_rng(1)
    net = networks.Network(kind, 3, 8, 2, dtype=np.float64)
    x, y = rng.normal(size=(4, 2, length)), np.array([0, 1, 2, 1])
    kept = {n: v.copy() for n, v in net.buffers.items()}

    def loss(p):
        net.buffers = {n: v.copy() for n, v in kept.items()}
        feature, logits = net.forward(x, p, training=True)
        return losses.cross_entropy(logits, y) + losses.contrastive(feature, y).scaled(0.3)

    assert slopes(loss, net.params, rng, 2) < 2e-5
    fixed = lambda p: losses.cross_entropy(net.forward(x, p)[1], y)
    assert slopes(fixed, net.params, rng, 1) < 2e-5


def test_convolutions_match_loops():
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(2, 3, 17)), rng.normal(size=(4, 3, 5)), rng.normal(size=4)
    for stride, padding, dilation in ((1, 0, 1), (2, 2, 1), (3, 4, 2)):
        got = tape.conv(tape.Var(x), tape.Var(w), tape.Var(b), stride, padding, dilation).value
        wide = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
        n = (wide.shape[2] - dilation * 4 - 1) // stride + 1
        want = np.array([[[sum(wide[r, c, t * stride + j * dilation] * w[o, c, j] for c in range(3) for j in range(5)) + b[o] for t in range(n)] for o in range(4)] for r in range(2)])
        assert np.allclose(got, want)


def test_losses_against_loops_and_slopes():
    rng = np.random.default_rng(3)
    z, f, y = rng.normal(size=(7, 6)), rng.normal(size=(7, 5)), np.array([0, 1, 2, 3, 0, 1, 3])
    w, t = rng.random(7), rng.normal(size=(7, 4))
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert float(losses.cross_entropy(tape.Var(z), y).value) == pytest.approx(-logp[np.arange(7), y].mean())
    assert float(losses.cross_entropy(tape.Var(z), y, w).value) == pytest.approx(-(w * logp[np.arange(7), y]).sum() / (w.sum() + 1e-8))
    soft = lambda a: np.exp(a) / np.exp(a).sum(1, keepdims=True)
    p, q = soft(t / 2), soft(z[:, :4] / 2)
    assert float(losses.distillation(tape.Var(z), t).value) == pytest.approx(4 * (p * np.log(p / q)).sum(1).mean())
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    each = []
    for i in range(7):
        others = [j for j in range(7) if j != i]
        total = sum(np.exp(u[i] @ u[j] / 0.2) for j in others)
        mates = [j for j in others if y[j] == y[i]]
        if mates:
            each.append(-np.mean([u[i] @ u[j] / 0.2 - np.log(total) for j in mates]))
    assert float(losses.contrastive(tape.Var(f), y).value) == pytest.approx(np.mean(each))
    hidden = [np.delete(z[i], y[i]) for i in range(7)]
    want = np.mean([np.log(np.exp(h).sum()) - np.log(np.exp(h[-2:]).sum()) for h in hidden])
    assert float(losses.dummies_second(tape.Var(z), y, 2).value) == pytest.approx(want)
    head = rng.normal(size=(5, 6))

    def placeholder(v):
        return losses.placeholders(v["f"], tape.linear(v["f"], v["w"], v["b"]), y, lambda x: tape.linear(x, v["w"], v["b"]), 2, np.random.default_rng(0))["loss"]

    arrays = {"f": f, "w": head, "b": rng.normal(size=6)}
    assert slopes(placeholder, arrays, rng) < 1e-6
    for loss in (lambda v: losses.cross_entropy(v["z"], y, w), lambda v: losses.distillation(v["z"], t), lambda v: losses.contrastive(v["z"], y), lambda v: losses.dummies_second(v["z"], y, 2)):
        assert slopes(loss, {"z": z}, rng) < 1e-6
    assert float(losses.contrastive(tape.Var(f), np.arange(7)).value) == 0.0
    with pytest.raises(ValueError, match="labels"):
        losses.placeholders(tape.Var(f), tape.Var(z), np.full(7, 5), None, 2, rng)


def tones(spark, classes, per_class, seed, first=0):
    """Records of a tone a class, with random phases and noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(first, first + classes):
        for k in range(per_class):
            t = 2 * np.pi * (c + 1) / 32 * np.arange(64) + rng.uniform(0, 2 * np.pi)
            rows.append((len(rows) + 10_000 * c, c, 1.0, (np.cos(t) + rng.normal(0, 0.3, 64)).tolist(), (np.sin(t) + rng.normal(0, 0.3, 64)).tolist()))
    return spark.createDataFrame(rows, "id bigint, label bigint, weight double, i array<double>, q array<double>")


@pytest.fixture(scope="module")
def trained(spark):
    known = tones(spark, 3, 40, 0)
    recipe = training.Recipe(epochs=4, batch=16, rates={"": 2e-3}, contrast=0.1)
    return known, *training.train_closed_set(known, tones(spark, 3, 10, 1), networks.Network("residual", 3, 16), recipe)


def test_training_keeps_the_best_epoch(spark, trained, tmp_path):
    known, net, history = trained
    rows = history.orderBy("epoch").collect()
    best = [r for r in rows if r["is_best"]][-1]
    assert len(rows) == 4 and best["validation_accuracy"] == max(r["validation_accuracy"] for r in rows) > 0.9
    assert training.evaluate(tones(spark, 3, 10, 1), net) == pytest.approx((best["validation_accuracy"], best["validation_loss"]))
    net.save(f"{tmp_path}/net.npz", epoch=best["epoch"])
    again, about = networks.load(f"{tmp_path}/net.npz")
    assert about == {"epoch": best["epoch"]} and all((again.params[n] == v).all() for n, v in net.params.items())
    out = training.extract(known, net)
    one = {r["id"]: (r["pred"], r["feature"]) for r in out.collect()}
    two = {r["id"]: (r["pred"], r["feature"]) for r in training.extract(known.repartition(3), again).collect()}
    assert all(one[k][0] == two[k][0] and np.allclose(one[k][1], two[k][1], atol=1e-5) for k in one) and len(one) == 120 and len(one[0][1]) == 16
    assert training.extract(known.limit(0), net).count() == 0


def test_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(training, "SHARD_ROWS", 50)
    net, history = training.train_closed_set(tones(spark, 2, 60, 0), tones(spark, 2, 10, 1), networks.Network("residual", 2, 8, 2), training.Recipe(epochs=3, batch=16, rates={"": 2e-3}, vary=False))
    assert history.agg(F.max("validation_accuracy")).first()[0] > 0.9
    empty = tones(spark, 2, 1, 0).limit(0)
    same, none = training.train_closed_set(empty, empty, net)
    assert same is net and none.count() == 0


def test_incremental_training_learns_and_keeps(spark, trained):
    known, net, _ = trained
    new = tones(spark, 2, 40, 5, first=3)
    means = training.extract(new, net).select("label", F.posexplode("feature").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).orderBy("label", "k").collect()
    rows = np.array([r["x"] for r in means]).reshape(2, 16)
    student = net.widened(5, rows / np.linalg.norm(rows, axis=1, keepdims=True))
    assert np.allclose(student.params["head.w"][:, :3], net.params["head.w"]) and student.params["head.w"].shape == (16, 5)
    memory = known.where("id % 10000 % 4 = 0")
    after = training.train_incremental(student, net, new, memory, training.Recipe(batch=16, clip=5.0), 2, 6, 5e-3, 2e-3)
    assert training.evaluate(tones(spark, 2, 10, 6, first=3), after)[0] > 0.8 and training.evaluate(tones(spark, 3, 10, 7), after)[0] > 0.8
    untouched = [n for n in net.params if n.startswith(("stem", "layer1", "layer2"))]
    assert all((after.params[n] == net.params[n]).all() for n in untouched) and all((after.buffers[n] == net.buffers[n]).all() for n in net.buffers if n.startswith(("stem", "layer1", "layer2")))


def test_predictions_go_forward_in_slices(spark, monkeypatch):
    """A worker's memory doesn't follow the batch it gets; features are those of all records at once."""
    net = networks.Network("residual", 3, 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2, 16))
    want, logits = (v.value for v in net.forward(x))
    sizes = []
    monkeypatch.setattr(networks.Network, "forward", lambda self, y, *a, f=networks.Network.forward, **k: (sizes.append(len(y)), f(self, y, *a, **k))[1])
    got = training._forward(net, x)
    assert np.allclose(got[0], want, atol=1e-5) and np.allclose(got[1], logits, atol=1e-5)
    assert max(sizes) <= training.FORWARD_ROWS and sum(sizes) == 600
