"""Vector code compression with whole numbers, entries filtered by segment-mean lower bounds.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook that rounds of assigning
and averaging improve. The squared distance of a part and an entry is at least the sum, over blocks of the part, of the
block's length times the squared difference of its means, plus the squared difference of the norms of what the means
leave. That bound is taken for one block, then for two, then for four: entries whose bound lies above the distance of
the most promising entry are out, and the survivors get exact whole-number distances. Bounds are lowered by more than
their rounding, so that no nearest entry is lost.

A round is one pass over the vectors in Arrow batches. A task keeps sums by part and entry, a few thousand numbers, which
Spark adds up; only codebooks reach the driver and go back to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import own_columns
from vexilar.session import materialize, ship

#: Fixed values of the contract.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Blocks a part is cut into, coarse to fine.
LEVELS = (1, 2, 4)
#: Rows worked on at once; share of squared norms by which a bound is lowered.
STRIP, MARGIN = 4_096, 1e-6
#: Labels that are broadcast with their errors at most; more are joined by shuffle.
BROADCAST_LABELS = 100_000


class Segments:
    """Block means and norms of residuals of whole-number rows, at each level."""

    def __init__(self, x: np.ndarray) -> None:
        rows, width = x.shape
        f = x.astype(np.float64)
        self.square = (f * f).sum(axis=1)
        self.levels = []
        for blocks in LEVELS:
            starts = np.unique(np.arange(min(blocks, max(width, 1))) * width // max(1, min(blocks, width or 1)))
            lengths = np.diff(np.append(starts, width)).astype(np.float64)
            sums = np.add.reduceat(f, starts, axis=1) if width else np.zeros((rows, 1))
            means = sums / np.maximum(lengths, 1)
            rest = np.sqrt(np.maximum(self.square - (means * means * lengths).sum(axis=1), 0.0))
            self.levels.append((means * np.sqrt(lengths), rest))  # scaled, so that squares count for a block's length


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) nearest to each row, ties to the lower entry, and how many exact distances that took."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    a, b, rows = Segments(x), Segments(book), np.arange(len(x))
    means, rest = a.levels[0]
    their_means, their_rest = b.levels[0]
    bound = (rest[:, None] - their_rest[None, :]) ** 2
    for k in range(means.shape[1]):
        bound += (means[:, k, None] - their_means[None, :, k]) ** 2
    guess = bound.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    slack = MARGIN * (a.square[:, None] + b.square[None, :]) + 1.0
    row, entry = np.nonzero(bound - slack <= best[:, None])
    for (means, rest), (their_means, their_rest) in zip(a.levels[1:], b.levels[1:], strict=True):
        bound = ((means[row] - their_means[entry]) ** 2).sum(axis=1) + (rest[row] - their_rest[entry]) ** 2
        kept = bound - slack[row, entry] <= best[row]
        row, entry = row[kept], entry[kept]
    exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, rows)  # the guess always stays, so each row has a survivor
    least = np.minimum.reduceat(exact, starts) if len(rows) else exact
    first = np.flatnonzero(exact == least[row])
    first = first[np.searchsorted(row[first], rows)]
    return entry[first], exact[first], len(exact) + len(x)


@dataclass
class Vectors:
    """The kept rows of a table: (_id, _label, _v: array<double> without nulls), the greatest length, and so the parts'."""

    rows: DataFrame
    width: int

    @property
    def part(self) -> int:
        return -(-self.width // PARTS)


def kept_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Vectors:
    """Rows whose vector is there and holds neither nulls nor values that aren't finite.

    Vectors shorter than the longest, or than a multiple of the parts, count as having zeros after their end.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = own_columns(df, _id=vec_id, _label=label, _v=F.col(f"`{vector}`").cast("array<double>")).where(F.col("_v").isNotNull() & F.forall("_v", finite))
    return Vectors(own, own.agg(F.max(F.size("_v"))).first()[0] or 0)


def whole_numbers(batch: pa.RecordBatch, part: int) -> np.ndarray:
    """The batch's vectors as floor(SCALE x), by row, part position and place in the part."""
    held = batch.column(batch.schema.get_field_index("_v"))
    values, ends = held.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.diff(held.offsets.to_numpy())))
    size, width = np.diff(ends), PARTS * part
    if len(size) and (size == width).all():
        x = values.reshape(len(size), width)
    else:
        x = np.zeros((len(size), width))
        row = np.repeat(np.arange(len(size)), size)
        x[row, np.arange(len(values)) - ends[row]] = values
    x = np.floor(SCALE * x)
    if x.size and 4.0 * width * float(np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError(f"components of {np.abs(x).max() / SCALE} are too large: squared distances would not fit 64 bits")
    return x.astype(np.int64).reshape(len(size), PARTS, part)


def first_books(vectors: Vectors) -> list[np.ndarray]:
    """Each part position's entries at the start: those of the rows with the smallest ids, equal ids by their vectors."""
    rows = vectors.rows.select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(ENTRIES).toArrow()
    found = [whole_numbers(b, vectors.part) for b in rows.to_batches()]
    whole = np.concatenate(found) if found else np.zeros((0, PARTS, vectors.part), np.int64)
    return [np.ascontiguousarray(whole[:, p]) for p in range(PARTS)]


def _improved(vectors: Vectors, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries that no part takes stay."""
    part, sent = vectors.part, vectors.rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        total = [np.zeros((len(b), part + 1), np.int64) for b in now]
        for batch in batches:
            for k in range(0, batch.num_rows, STRIP):
                x = whole_numbers(batch.slice(k, STRIP), part)
                for p, book in enumerate(now):
                    taken = (nearest_entries(x[:, p], book)[0][:, None] == np.arange(len(book))).T.astype(np.int64)
                    total[p][:, :part] += taken @ x[:, p]
                    total[p][:, part] += taken.sum(axis=1)
        every = [(p, e, i, int(t)) for p, rows in enumerate(total) for e, row in enumerate(rows) if row[part] for i, t in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*every, strict=True)] if every else [pa.array([], pa.int64())] * 4, names=["p", "e", "i", "t"])

    added = vectors.rows.select("_v").mapInArrow(sums, "p bigint, e bigint, i bigint, t bigint").groupBy("p", "e", "i").agg(F.sum("t").alias("t"))
    of = {(r["p"], r["e"], r["i"]): r["t"] for r in added.collect()}  # numbers of one set of codebooks
    out = [b.copy() for b in books]
    for p, book in enumerate(out):
        for e in range(len(book)):
            if n := of.get((p, e, part)):
                book[e] = [of[p, e, i] // n for i in range(part)]
    return out


def train_books(vectors: Vectors, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, (entries, places) by part position, after ``rounds`` rounds over all rows."""
    books = first_books(vectors)
    for _ in range(rounds if len(books[0]) and vectors.width else 0):
        books = _improved(vectors, books)
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: Vectors, books: list[np.ndarray]) -> DataFrame:
    """(_id, _label, code, error), one row a row: two hex digits a part, and the summed squared distances."""
    part, sent, kinds = vectors.part, vectors.rows.sparkSession.sparkContext.broadcast(books), dict(vectors.rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, STRIP):
                some = batch.slice(k, STRIP)
                x = whole_numbers(some, part)
                found = [nearest_entries(x[:, p], book) for p, book in enumerate(now)]
                code = np.stack([e for e, *_ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = sum((d for _, d, _ in found), np.zeros(len(x), np.int64))
                codes = [code[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(x))]
                yield pa.RecordBatch.from_arrays([some.column("_id"), some.column("_label"), pa.array(codes, pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"])

    return vectors.rows.mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code", out: str = "vector") -> DataFrame:
    """``codes`` with the vector that each code stands for (array<double>): entries in part order, scaled back."""
    table = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in book]) for book in books]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out, F.concat(*[F.get(table[p], at(p)) for p in range(PARTS)]))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each kept row of ``df``.

    Rows without a vector, or whose vector holds nulls or values that aren't finite, are dropped; repeated rows and ids
    each keep a row; null ids come last where first entries are chosen, null labels are one label. With fewer kept rows
    than entries, each is an entry; vectors without components have code zeros and error 0. Components whose squares
    would not fit 64 bits are refused. Other columns are ignored; an empty table gives no row.
    """
    ship(df.sparkSession)
    vectors = kept_vectors(df, vec_id, vector, label)
    books = train_books(vectors, rounds)
    coded = materialize(encode(vectors, books), "codes")
    by_label = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of"), "label_errors")
    few = by_label.count() <= broadcast_labels
    joined = coded.join(F.broadcast(by_label) if few else by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
