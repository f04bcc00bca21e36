"""Scalar helpers and a registry of named feature functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vexilar.functions import rf

_features: dict[str, Callable[[Column | str, Column | str], Column]] = {name: (lambda i, q, name=name: rf.feature_column(i, q, name)) for name in rf.VIEWS}


def register(name: str, make: Callable[[Column | str, Column | str], Column]) -> None:
    """Adds or replaces a feature function: (i, q) columns to a vector column."""
    _features[name] = make


def feature(name: str) -> Callable[[Column | str, Column | str], Column]:
    return _features[name]


def safe_name(c: Column) -> Column:
    """Lower-case file name: blanks and marks as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), F.lit("_"))


def argmax(v: Column | str) -> Column:
    """Index of the greatest element, the first of equal ones; e.g. of one-hot labels."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    return F.transform(v, lambda x: F.exp(x - F.array_max(v)) / F.aggregate(v, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(v))))


def running_sum(v: Column) -> Column:
    """Sums of each beginning of an array; time grows with its length. Null arrays: null."""

    @F.pandas_udf("array<double>")
    def sums(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.cumsum(np.asarray(x, float)))

    return sums(v)


def differences(v: Column) -> Column:
    """Each element less the one before; one element shorter."""
    return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)


def rotate(v: Column, k: int) -> Column:
    """Circular shift to the right by k."""
    n = F.size(v)
    cut = n - F.pmod(F.lit(k), n)
    return F.concat(F.slice(v, cut + 1, n - cut), F.slice(v, 1, cut))


def argsort(v: Column | str) -> Column:
    """Places of the elements in rising order; equal ones keep theirs."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def outer(a: Column, b: Column) -> Column:
    """Products of every element of a with every one of b, row after row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


# -- complex columns: pairs of arrays (real, imaginary) --


def magnitude(i: Column, q: Column) -> Column:
    return F.zip_with(i, q, lambda x, y: F.sqrt(x * x + y * y))


def angle(i: Column, q: Column) -> Column:
    return F.zip_with(i, q, lambda x, y: F.atan2(y, x))


def turned(i: Column, q: Column, radians: Column) -> tuple[Column, Column]:
    """Both channels after a turn by an angle."""
    return F.zip_with(i, q, lambda x, y: x * F.cos(radians) - y * F.sin(radians)), F.zip_with(i, q, lambda x, y: x * F.sin(radians) + y * F.cos(radians))


def step_product(i: Column, q: Column) -> tuple[Column, Column]:
    """Each sample times the conjugate of the one before; one element shorter."""
    n = F.size(i) - 1
    now = F.arrays_zip(F.slice(i, 2, n).alias("i"), F.slice(q, 2, n).alias("q"))
    last = F.arrays_zip(F.slice(i, 1, n).alias("i"), F.slice(q, 1, n).alias("q"))
    return F.zip_with(now, last, lambda a, b: a["i"] * b["i"] + a["q"] * b["q"]), F.zip_with(now, last, lambda a, b: a["q"] * b["i"] - a["i"] * b["q"])


def spectrum_power(i: Column, q: Column) -> Column:
    """Squared magnitudes of the discrete Fourier transform, for short records: a product a pair of bins and samples."""
    n = F.size(i)
    both = F.arrays_zip(i.alias("i"), q.alias("q"))

    def power(k: Column) -> Column:
        turn = lambda t: 2 * F.pi() * k * t / n
        part = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda a, x: a + x)
        return F.pow(part(lambda s, t: s["i"] * F.cos(turn(t)) + s["q"] * F.sin(turn(t))), F.lit(2)) + F.pow(part(lambda s, t: s["q"] * F.cos(turn(t)) - s["i"] * F.sin(turn(t))), F.lit(2))

    return F.transform(F.sequence(F.lit(0), n - 1), power)


def blake2b_128(data: Column) -> Column:
    """Hexadecimal BLAKE2b digests of 16 bytes; null for null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        import hashlib

        return x.map(lambda b: None if b is None else hashlib.blake2b(bytes(b), digest_size=16).hexdigest())

    return run(data)


def float32_bytes(v: Column) -> Column:
    """A vector's 32-bit floats, little-endian, as bytes: what content digests of records are taken of."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)
