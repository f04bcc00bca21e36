"""Signal features of I/Q records (columns i and q, array<double> of equal length).

Two forms: JVM expressions for the amplitude and I/Q statistics, and one Arrow-batched function for all named views,
which needs Fourier transforms. A view is a list of named formulas over a batch of records; shared quantities are
computed once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS, WIDE_EPS = 1e-8, 1e-6


def _shape(x: np.ndarray, power: int, eps: float) -> np.ndarray:
    """Standardised moment of rows, not centred on that of a normal distribution."""
    c = x - x.mean(axis=1, keepdims=True)
    return ((c / (x.std(axis=1, keepdims=True) + eps)) ** power).mean(axis=1)


class Records:
    """A batch of records of one length, with the quantities that features share."""

    def __init__(self, i: np.ndarray, q: np.ndarray) -> None:
        self.i, self.q = i, q

    z = cached_property(lambda r: r.i + 1j * r.q)
    power = cached_property(lambda r: r.i**2 + r.q**2)
    amp = cached_property(lambda r: np.sqrt(r.power + EPS))  # for the base view: eps under the root
    envelope = cached_property(lambda r: np.sqrt(r.power))
    phase = cached_property(lambda r: np.unwrap(np.arctan2(r.q, r.i), axis=1))
    turn = cached_property(lambda r: np.diff(r.phase, axis=1))
    quantiles = cached_property(lambda r: dict(zip((10, 25, 50, 75, 90, 99), np.quantile(r.envelope, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99], axis=1))))
    edge = cached_property(lambda r: np.diff(r.envelope, axis=1))

    @cached_property
    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        """(power, share of power) of the unshifted transform."""
        p = np.abs(np.fft.fft(self.z, axis=1)) ** 2
        return p, p / (p.sum(axis=1, keepdims=True) + EPS)

    def band(self, low: float, shifted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share, centroid, distance from it) over frequencies from low to 1."""
        share = self.spectrum[1]
        share = np.fft.fftshift(share, axes=1) if shifted else share
        f = np.linspace(low, 1.0, share.shape[1])
        c = (share * f).sum(axis=1)
        return share, c, f - c[:, None]

    @cached_property
    def active(self) -> np.ndarray:
        """Samples in a pulse: above half way from the median to the 90 % quantile of the envelope."""
        mid, high = self.quantiles[50], self.quantiles[90]
        return self.envelope >= (mid + 0.5 * (high - mid))[:, None]

    @cached_property
    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """(angle from one sample to the next, whether both are active)."""
        return np.angle(self.z[:, 1:] * np.conj(self.z[:, :-1])), self.active[:, 1:] & self.active[:, :-1]

    @cached_property
    def drift(self) -> tuple[np.ndarray, np.ndarray]:
        a, on = self.step
        return np.diff(a, axis=1), on[:, 1:] & on[:, :-1]

    @cached_property
    def balance(self) -> dict[str, np.ndarray]:
        """Central second moments of the two channels."""
        i, q = self.i - self.i.mean(axis=1, keepdims=True), self.q - self.q.mean(axis=1, keepdims=True)
        m = {"ii": (i * i).mean(axis=1), "qq": (q * q).mean(axis=1), "iq": (i * q).mean(axis=1)}
        return m | {"sum": m["ii"] + m["qq"] + EPS, "pseudo": m["ii"] - m["qq"] + 2j * m["iq"]}


def _masked(x: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
    n = np.maximum(on.sum(axis=1), 1)
    mean = (x * on).sum(axis=1) / n
    off = np.abs(x - mean[:, None]) * on
    return {"mean": mean, "std": np.sqrt((off**2).sum(axis=1) / n + EPS), "mad": off.sum(axis=1) / n}


Formula = Callable[[Records], np.ndarray]


def _correlation(r: Records) -> np.ndarray:
    return r.balance["iq"] / (r.i.std(axis=1) * r.q.std(axis=1) + EPS)


def _entropy(r: Records) -> np.ndarray:
    p = r.spectrum[1]
    return -(p * np.log(p + EPS)).sum(axis=1) / (np.log(p.shape[1]) + EPS)


def _spread(r: Records) -> np.ndarray:
    share, _, off = r.band(0.0, False)
    return np.sqrt((share * off**2).sum(axis=1))


BASE: dict[str, Formula] = {
    "amp_mean": lambda r: r.amp.mean(axis=1),
    "amp_std": lambda r: r.amp.std(axis=1),
    "amp_max": lambda r: r.amp.max(axis=1),
    "amp_min": lambda r: r.amp.min(axis=1),
    "amp_rms": lambda r: np.sqrt((r.amp**2).mean(axis=1) + EPS),
    "papr": lambda r: (r.amp**2).max(axis=1) / ((r.amp**2).mean(axis=1) + EPS),
    "amp_skew": lambda r: _shape(r.amp, 3, EPS),
    "amp_kurtosis": lambda r: _shape(r.amp, 4, EPS),
    "phase_mean": lambda r: r.phase.mean(axis=1),
    "phase_std": lambda r: r.phase.std(axis=1),
    "freq_offset_mean": lambda r: r.turn.mean(axis=1),
    "freq_offset_std": lambda r: r.turn.std(axis=1),
    "i_power": lambda r: (r.i**2).mean(axis=1),
    "q_power": lambda r: (r.q**2).mean(axis=1),
    "iq_power_ratio": lambda r: (r.i**2).mean(axis=1) / ((r.q**2).mean(axis=1) + EPS),
    "iq_power_diff": lambda r: np.abs((r.i**2).mean(axis=1) - (r.q**2).mean(axis=1)),
    "i_mean": lambda r: r.i.mean(axis=1),
    "q_mean": lambda r: r.q.mean(axis=1),
    "i_std": lambda r: r.i.std(axis=1),
    "q_std": lambda r: r.q.std(axis=1),
    "iq_corr": _correlation,
    "spectral_entropy": _entropy,
    "spectral_centroid": lambda r: r.band(0.0, False)[1],
    "spectral_bandwidth": _spread,
}


def _extension() -> dict[str, Formula]:
    """Eight statistics each of the envelope, the phase and its steps."""
    of: dict[str, Formula] = {"envelope": lambda r: r.envelope, "phase": lambda r: r.phase, "turn": lambda r: r.turn}
    stats: dict[str, Callable[[np.ndarray], np.ndarray]] = {
        "mean": lambda x: x.mean(axis=1), "std": lambda x: x.std(axis=1), "skew": lambda x: _shape(x, 3, WIDE_EPS), "kurtosis": lambda x: _shape(x, 4, WIDE_EPS),
        "q25": lambda x: np.quantile(x, 0.25, axis=1), "q75": lambda x: np.quantile(x, 0.75, axis=1), "peak": lambda x: np.abs(x).max(axis=1), "power": lambda x: (x**2).mean(axis=1),
    }
    return {f"wide_{n}_{s}": lambda r, g=g, h=h: h(g(r)) for n, g in of.items() for s, h in stats.items()}


def _eigen_ratio(r: Records) -> np.ndarray:
    b = r.balance
    gap = np.abs(b["pseudo"])
    return (b["sum"] + gap) / (b["sum"] - gap + EPS)


def _moment(k: int) -> Formula:
    def f(r: Records) -> np.ndarray:
        share, _, off = r.band(-1.0, True)
        width = np.sqrt((share * off**2).sum(axis=1, keepdims=True) + EPS)
        return (share * (off / (width + EPS)) ** k).sum(axis=1)

    return f


def _rolloff(r: Records) -> np.ndarray:
    share = r.band(-1.0, True)[0]
    return (np.cumsum(share, axis=1) >= 0.90).argmax(axis=1) / (share.shape[1] - 1)


TRANSIENT: dict[str, Formula] = {
    "span_80": lambda r: r.quantiles[90] - r.quantiles[10],
    "span_50": lambda r: r.quantiles[75] - r.quantiles[25],
    "crest": lambda r: r.quantiles[99] / (r.quantiles[50] + EPS),
    "papr": lambda r: r.power.max(axis=1) / (r.power.mean(axis=1) + EPS),
    "duty": lambda r: r.active.mean(axis=1),
    "transition_rate": lambda r: (r.active[:, 1:] != r.active[:, :-1]).mean(axis=1),
    "edge_mean": lambda r: np.abs(r.edge).mean(axis=1),
    "edge_std": lambda r: np.abs(r.edge).std(axis=1),
    "edge_q90": lambda r: np.quantile(np.abs(r.edge), 0.9, axis=1),
    "edge_max": lambda r: np.abs(r.edge).max(axis=1),
    "rise_mean": lambda r: np.clip(r.edge, 0, None).mean(axis=1),
    "rise_std": lambda r: np.clip(r.edge, 0, None).std(axis=1),
    "fall_mean": lambda r: np.clip(-r.edge, 0, None).mean(axis=1),
    "fall_std": lambda r: np.clip(-r.edge, 0, None).std(axis=1),
}
OSCILLATOR: dict[str, Formula] = {
    **{f"step_{s}": lambda r, s=s: _masked(*r.step)[s] for s in ("mean", "std", "mad")},
    **{f"drift_{s}": lambda r, s=s: _masked(*r.drift)[s] for s in ("mean", "std", "mad")},
    "step_abs": lambda r: np.abs(r.step[0]).mean(axis=1),
    "step_all_std": lambda r: r.step[0].std(axis=1),
}
HARDWARE: dict[str, Formula] = {
    "log_power_ratio": lambda r: np.log((r.balance["ii"] + EPS) / (r.balance["qq"] + EPS)),
    "power_difference": lambda r: (r.balance["ii"] - r.balance["qq"]) / r.balance["sum"],
    "correlation": lambda r: r.balance["iq"] / (np.sqrt(r.balance["ii"] * r.balance["qq"]) + EPS),
    "pseudo_share": lambda r: np.abs(r.balance["pseudo"]) / r.balance["sum"],
    "pseudo_angle": lambda r: np.angle(r.balance["pseudo"]),
    "dc_leakage": lambda r: np.hypot(r.i.mean(axis=1), r.q.mean(axis=1)) / (np.sqrt(r.balance["sum"]) + EPS),
    "eigen_ratio": _eigen_ratio,
}
SHAPE: dict[str, Formula] = {
    "entropy": lambda r: -(r.spectrum[1] * np.log(r.spectrum[1] + EPS)).sum(axis=1) / np.log(r.i.shape[1]),
    "centroid": lambda r: r.band(-1.0, True)[1],
    "bandwidth": lambda r: np.sqrt((r.band(-1.0, True)[0] * r.band(-1.0, True)[2] ** 2).sum(axis=1) + EPS),
    "skew": _moment(3),
    "kurtosis": _moment(4),
    "flatness": lambda r: np.exp(np.log(r.spectrum[0] + EPS).mean(axis=1)) / (r.spectrum[0].mean(axis=1) + EPS),
    "peak": lambda r: r.spectrum[0].max(axis=1) / (r.spectrum[0].mean(axis=1) + EPS),
    "rolloff_90": _rolloff,
}

_names = list(BASE)
VIEWS: dict[str, dict[str, Formula]] = {
    "amplitude_8d": {n: BASE[n] for n in _names[:8]},
    "phase_frequency_4d": {n: BASE[n] for n in _names[8:12]},
    "iq_imbalance_9d": {n: BASE[n] for n in _names[12:21]},
    "spectral_3d": {n: BASE[n] for n in _names[21:]},
    "all24_base": BASE,
    "all48_extended": {**BASE, **_extension()},
    "transient_14d": TRANSIENT,
    "oscillator_8d": OSCILLATOR,
    "iq_hardware_7d": HARDWARE,
    "spectral_shape_8d": SHAPE,
    "hardware_23d": {**{f"osc_{k}": v for k, v in OSCILLATOR.items()}, **{f"iq_{k}": v for k, v in HARDWARE.items()}, **{f"spec_{k}": v for k, v in SHAPE.items()}},
    "all37d": {**{f"tr_{k}": v for k, v in TRANSIENT.items()}, **{f"osc_{k}": v for k, v in OSCILLATOR.items()}, **{f"iq_{k}": v for k, v in HARDWARE.items()}, **{f"spec_{k}": v for k, v in SHAPE.items()}},
}


def features(i: np.ndarray, q: np.ndarray, view: str = "all24_base") -> np.ndarray:
    """(records, features) of a view; NaN and infinities become 0."""
    r = Records(np.asarray(i, float), np.asarray(q, float))
    with np.errstate(all="ignore"):
        out = np.stack([f(r) for f in VIEWS[view].values()], axis=1)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def feature_udf(view: str = "all24_base"):
    """A function of (i, q): the view's vector of each record; records of one length in a batch are computed together. Null records: null."""

    @F.pandas_udf("array<double>")
    def run(i: pd.Series, q: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(i), dtype=object)
        length = np.array([-1 if a is None or b is None or len(a) != len(b) else len(a) for a, b in zip(i, q)])
        for n in np.unique(length[length > 1]):
            at = np.flatnonzero(length == n)
            found = features(np.stack(i.to_numpy()[at]), np.stack(q.to_numpy()[at]), view)
            for k, row in zip(at, found):
                out.iat[int(k)] = row
        return out

    return run


def feature_column(i: Column | str, q: Column | str, view: str = "all24_base") -> Column:
    """The view's vector of each record, see ``feature_udf``."""
    return feature_udf(view)(i, q)


def amplitude_expressions(df: DataFrame, i: str = "i", q: str = "q") -> DataFrame:
    """Adds the eight amplitude features by JVM expressions."""
    m = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x) / size({c})"
    out = df.withColumn("_a", F.expr(f"zip_with({i}, {q}, (x, y) -> sqrt(x * x + y * y + {EPS}))"))
    out = out.withColumn("amp_mean", F.expr(m("_a"))).withColumn("_p", F.expr("transform(_a, x -> x * x)"))
    out = out.withColumn("amp_std", F.expr(f"sqrt({m('transform(_a, x -> (x - amp_mean) * (x - amp_mean))')})"))
    out = out.withColumn("_z", F.expr(f"transform(_a, x -> (x - amp_mean) / (amp_std + {EPS}))"))
    return out.select(
        *df.columns, "amp_mean", "amp_std", F.array_max("_a").alias("amp_max"), F.array_min("_a").alias("amp_min"), F.expr(f"sqrt({m('_p')} + {EPS})").alias("amp_rms"),
        F.expr(f"array_max(_p) / ({m('_p')} + {EPS})").alias("papr"), F.expr(m("transform(_z, x -> x * x * x)")).alias("amp_skew"), F.expr(m("transform(_z, x -> x * x * x * x)")).alias("amp_kurtosis"),
    )


def balance_expressions(df: DataFrame, i: str = "i", q: str = "q") -> DataFrame:
    """Adds the nine I/Q balance features by JVM expressions."""
    m = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x) / size({c})"
    out = df.withColumn("i_power", F.expr(m(f"transform({i}, x -> x * x)"))).withColumn("q_power", F.expr(m(f"transform({q}, x -> x * x)")))
    out = out.withColumn("i_mean", F.expr(m(i))).withColumn("q_mean", F.expr(m(q)))
    std = lambda c, mean: F.sqrt(F.expr(m(f"transform({c}, x -> (x - {mean}) * (x - {mean}))")))
    out = out.withColumn("i_std", std(i, "i_mean")).withColumn("q_std", std(q, "q_mean"))
    cov = F.expr(m(f"zip_with({i}, {q}, (x, y) -> (x - i_mean) * (y - q_mean))"))
    return out.select(
        *df.columns, "i_power", "q_power", (F.col("i_power") / (F.col("q_power") + EPS)).alias("iq_power_ratio"), F.abs(F.col("i_power") - F.col("q_power")).alias("iq_power_diff"),
        "i_mean", "q_mean", "i_std", "q_std", (cov / (F.col("i_std") * F.col("q_std") + EPS)).alias("iq_corr"),
    )


# -- row-wise signal preparation --


def rms_normalize(df: DataFrame, i: str = "i", q: str = "q", floor: float = 1e-12, eps: float = 0.0) -> DataFrame:
    """Divides both channels by the root of the record's mean power (at least ``floor``), plus ``eps``."""
    e = F.expr(f"sqrt(greatest(aggregate(zip_with({i}, {q}, (x, y) -> x * x + y * y), 0D, (a, x) -> a + x) / size({i}), {floor})) + {eps}")
    return df.withColumn("_e", e).withColumn(i, F.expr(f"transform({i}, x -> x / _e)")).withColumn(q, F.expr(f"transform({q}, x -> x / _e)")).drop("_e")


def channel_zscore(df: DataFrame, *channels: str, eps: float = 1e-8) -> DataFrame:
    for c in channels:
        df = df.withColumn("_m", F.expr(f"aggregate({c}, 0D, (a, x) -> a + x) / size({c})"))
        df = df.withColumn("_s", F.expr(f"sqrt(aggregate({c}, 0D, (a, x) -> a + (x - _m) * (x - _m)) / size({c})) + {eps}")).withColumn(c, F.expr(f"transform({c}, x -> (x - _m) / _s)")).drop("_m", "_s")
    return df


def windows(df: DataFrame, channels: list[str], length: int, stride: int, count: int | None = None) -> DataFrame:
    """One row a window: windows begin every ``stride`` samples, ``count`` of them or as many as fit."""
    fits = F.floor((F.size(channels[0]) - length) / stride)
    last = F.least(fits, F.lit(count - 1)) if count else fits
    rows = df.where(F.size(channels[0]) >= length).withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    for c in channels:
        rows = rows.withColumn(c, F.slice(c, (F.col("window") * stride + 1).cast("int"), length))
    return rows


def up_chirp(n: int, spread: int = 7) -> np.ndarray:
    """A reference chirp of n samples that rises through the whole band once, oversampled from 2**spread chips."""
    t = np.arange(n) * (2**spread / n)
    return np.exp(1j * np.pi * (t * t / 2**spread - t))


def chirp_samples(spark: SparkSession, n: int, spread: int = 7) -> DataFrame:
    """(k, i, q): the samples of ``up_chirp`` as rows."""
    t = F.col("k") * (2**spread / n)
    turn = F.pi() * (t * t / 2**spread - t)
    return spark.range(n).select(F.col("id").alias("k")).select("k", F.cos(turn).alias("i"), F.sin(turn).alias("q"))


def _blocks(x: np.ndarray, offset: int, n: int, count: int) -> np.ndarray:
    return x[offset : offset + n * count].reshape(count, n)


def chirp_offset(x: np.ndarray, n: int, spread: int = 7, coarse: int = 8, count: int = 4) -> int:
    """Where symbols begin: the offset whose dechirped blocks have the sharpest spectral peaks, coarse, then fine."""
    down = np.conj(up_chirp(n, spread))

    def sharp(offset: int) -> float:
        if offset < 0 or offset + n * count > len(x):
            return -np.inf
        p = np.abs(np.fft.fft(_blocks(x, offset, n, count) * down, axis=1)) ** 2
        return float((p.max(axis=1) / (p.sum(axis=1) + 1e-12)).mean())

    first = max(range(0, n, coarse), key=sharp)
    return max(range(first - coarse, first + coarse + 1), key=sharp)


def dechirped(x: np.ndarray, n: int, length: int, spread: int = 7) -> np.ndarray:
    """(symbols, length): aligned symbols without offset, of unit power, dechirped, peak moved to bin 0, decimated."""
    start = chirp_offset(x, n, spread)
    count = (len(x) - start) // n
    s = _blocks(x, start, n, count)
    s = s - s.mean(axis=1, keepdims=True)
    s = s / (np.sqrt((np.abs(s) ** 2).mean(axis=1, keepdims=True)) + 1e-12) * np.conj(up_chirp(n, spread))
    peak = np.abs(np.fft.fft(s, axis=1)).argmax(axis=1)
    s = s * np.exp(-2j * np.pi * peak[:, None] * np.arange(n)[None, :] / n)
    return s[:, :: n // length][:, :length]


def augment(i: np.ndarray, q: np.ndarray, seed: int, amplitude: float = 0.1, degrees: float = 5.0, shift: int = 4, snr: tuple[float, float] = (30.0, 40.0)) -> tuple[np.ndarray, np.ndarray]:
    """Seeded variation of records: gain, phase turn, circular shift and white noise."""
    rng = np.random.default_rng(seed)
    n = len(i)
    z = (i + 1j * q) * rng.uniform(1 - amplitude, 1 + amplitude, (n, 1)) * np.exp(1j * np.deg2rad(rng.uniform(-degrees, degrees, (n, 1))))
    z = np.stack([np.roll(r, s) for r, s in zip(z, rng.integers(-shift, shift + 1, n))])
    noise = np.sqrt((np.abs(z) ** 2).mean(axis=1, keepdims=True) / 10 ** (rng.uniform(*snr, (n, 1)) / 10) / 2)
    z = z + noise * (rng.normal(size=z.shape) + 1j * rng.normal(size=z.shape))
    return z.real, z.imag


def augmented(df: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``df`` (id, i, q) with varied channels: each record by a generator of its own, from its id and the seed."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [augment(np.asarray(i, float)[None], np.asarray(q, float)[None], abs(hash((seed, int(k)))), **options) for k, i, q in zip(batch["id"], batch["i"], batch["q"])]
            yield batch.assign(i=[a[0] for a, _ in out], q=[b[0] for _, b in out])

    return df.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in df.columns))
