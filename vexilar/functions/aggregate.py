"""Vector statistics as mergeable states: a row a group and task goes through the shuffle, not a row a component.

A state is (rows, and by component: values, mean, squared deviations). Each task folds its rows into one state a group in Arrow batches; states of
one group then meet in one task, where they are merged in passing. Tasks of many groups hand out their states early, so
memory is bounded whatever the number of groups, and no task ever holds a group's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.session import ship

#: Numbers in the states that a task keeps before it hands them out.
HELD_NUMBERS = 4_000_000


#: The vectors of a state.
PARTS = ("count", "mean", "m2")


class State:
    """Rows, and the count, mean and summed squared deviations of each component's values (Chan, Golub and LeVeque, 1979)."""

    __slots__ = ("n", "count", "mean", "m2")

    def __init__(self, n: int, count: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        self.n, self.count, self.mean, self.m2 = n, count, mean, m2

    def add(self, n: int, count: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        if len(mean) != len(self.mean):
            raise ValueError(f"a group has vectors of {len(self.mean)} and of {len(mean)} components")
        every, apart = self.count + count, mean - self.mean
        share = count / np.maximum(every, 1)
        self.mean = np.where(self.count == 0, mean, np.where(count == 0, self.mean, self.mean + apart * share))
        self.m2 = self.m2 + m2 + np.where((self.count == 0) | (count == 0), 0.0, apart * apart * self.count * share)
        self.n, self.count = self.n + n, every


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix, which of its values are there) of each length; null vectors are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values, there = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())
    ends = np.cumsum(np.maximum(sizes, 0))
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        if len(at) * size == len(values):
            yield at, values.reshape(len(at), int(size)), there.reshape(len(at), int(size))
        else:
            place = (ends[at] - size)[:, None] + np.arange(size)[None, :]
            yield at, values[place], there[place]


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number for each row, equal where all keys are (null equals null)."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        d = batch.column(k).dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _emitted(states: dict, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    keys = list(states)
    columns = [pa.array([key[i] for key in keys], t) for i, t in enumerate(kinds)]
    held = list(states.values())
    vectors = [pa.array([np.asarray(getattr(s, part), float) for s in held], pa.list_(pa.float64())) for part in PARTS]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s.n for s in held], pa.int64()), *vectors], names=[*names, "_n", *(f"_{p}" for p in PARTS)])


def vector_states(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys, _n, _count, _mean, _m2): the vectors of each group, and of each component the values, their mean and squared deviations.

    No keys: one group. Null vectors and null components don't count; a component without values has mean 0 and count
    0. Vectors of one group have one length.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_n bigint", *(f"_{p} array<double>" for p in PARTS)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, held, types = {}, 0, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            code = _codes(batch, keys)
            for at, x, there in _matrices(batch.column(batch.schema.get_field_index(v))):
                order = np.argsort(code[at], kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(code[at][order]) != 0))
                x, there = x[order], there[order]
                n = np.diff(np.append(starts, len(x)))
                total = lambda y, starts=starts: np.add.reduceat(y, starts, axis=0) if y.shape[1] else np.zeros((len(starts), 0))
                count = total(there.astype(float))
                mean = total(x) / np.maximum(count, 1)
                off = np.where(there, x - np.repeat(mean, n, axis=0), 0.0)
                m2 = total(off * off)
                first = pa.array(at[order[starts]])
                names = zip(*[batch.column(k).take(first).to_pylist() for k in keys], strict=True) if keys else [()]
                for i, key in enumerate(names):
                    if (old := states.get(key)) is None:
                        states[key] = State(int(n[i]), count[i], mean[i], m2[i])
                        held += 3 * x.shape[1] + 8
                    else:
                        old.add(int(n[i]), count[i], mean[i], m2[i])
            if held > HELD_NUMBERS:
                yield _emitted(states, types, keys)
                states, held = {}, 0
        if states:
            yield _emitted(states, types, keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, types = None, None, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            done = {}
            named = zip(*[batch.column(k).to_pylist() for k in keys], strict=True) if keys else [()] * batch.num_rows
            parts = [_rows(batch.column(c)) for c in (f"_{p}" for p in PARTS)]
            for i, (key, n) in enumerate(zip(named, batch.column("_n").to_pylist(), strict=True)):
                if state is not None and key == now:
                    state.add(n, *(p[i] for p in parts))
                    continue
                if state is not None:
                    done[now] = state
                now, state = key, State(n, *(p[i] for p in parts))
            if done:
                yield _emitted(done, types, keys)
        if state is not None:
            yield _emitted({now: state}, types, keys)

    partial = df.select(*keys, v).mapInArrow(fold, schema)
    if not keys:
        return partial.repartition(1).mapInArrow(merge, schema)  # a row a task of the first step, merged in passing
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(column.value_lengths()))
    return np.split(values, ends[:-1]) if len(ends) else []


def means() -> Column:
    """A state's means; null for components without values."""
    return F.zip_with("_mean", "_count", lambda m, c: F.when(c > 0, m))


def deviations() -> Column:
    """A state's population standard deviations; null for components without values."""
    return F.zip_with("_m2", "_count", lambda x, c: F.when(c > 0, F.sqrt(x / c)))
