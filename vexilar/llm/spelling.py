"""Spelling variants by full neighbourhood generation.

Every word emits its whole neighbourhood over the observed alphabet: each distinct string that one deletion, one
replacement or one insertion makes of it. What is left after a filter of the vocabulary is hash-joined to the
vocabulary; equal strings are neighbours, so no distance is ever computed. Nearest forms are then followed to their
roots by doubling.

A neighbourhood has some (2 length + 1) x letters strings, a thousand for a word. Workers give each of them a 64-bit
polynomial value, from those of the word's beginnings and ends and without making the string, and look it up in a Bloom
filter of the vocabulary's values. The few that may be words become strings and are shuffled to the join, which decides.
The filter has a bounded size; a vocabulary too large for it only lets more candidates through to the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import ascii_lower, own_columns
from vexilar.session import materialize, ship

# Fixed values of the contract: what separates runs of letters, after A-Z are in lower case.
NOT_LETTERS = r"[^a-zÀ-ÿ]+"
#: 64-bit cells of the filter for each word, and at most (64 MB).
CELLS_A_WORD, MOST_CELLS = 1, 1 << 23
#: Cells of the filter that one row holds on its way to the driver.
SEGMENT = 1 << 13
#: Values that a worker computes at once, and words of a task.
STRIP, TASK_WORDS = 1 << 15, 20_000

# Odd multipliers, from the fractional parts of square roots: the polynomial's base and the filter's spreads.
BASE, SPREAD, MIX = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B), np.uint64(0x3C6EF372FE94F82B)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def observed_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_n: int = 2, misprint: int | None = 31) -> DataFrame:
    """(word, n): runs of letters of all whole texts, with how often each is found.

    Runs are lower-cased in A-Z alone. A run whose CRC-32 of "<doc_id>:<run>" is divisible by ``misprint`` loses the
    code point at that value modulo its length; None leaves runs as they are, as does a null doc_id. Words have at
    least ``least_length`` code points and ``least_n`` occurrences. Null and empty texts have none; repeated rows
    count again; other columns are ignored; an empty table gives no row.
    """
    own = own_columns(docs, _id=F.col(f"`{doc_id}`").cast("string"), _text=ascii_lower(F.col(f"`{text}`")))
    runs = own.select("_id", F.explode(F.split("_text", NOT_LETTERS)).alias("word")).where(F.length("word") >= least_length)
    if misprint is not None:
        h = F.crc32(F.concat("_id", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % misprint == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_n) & (F.length("word") >= least_length))


def _codes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, code points plus one by row) for the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, STRIP // int(size + 1))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            points = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield some, points.reshape(len(some), int(size)).astype(np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def word_values(words: list[str]) -> np.ndarray:
    """The polynomial value of each word: the sum of (code point + 1) x base ^ place, modulo 2^64."""
    out = np.zeros(len(words), np.uint64)
    for at, codes in _codes(words):
        out[at] = (codes * _powers(codes.shape[1] - 1)[: codes.shape[1]]).sum(axis=1, dtype=np.uint64) if codes.shape[1] else 0
    return out


class WordFilter:
    """A Bloom filter of values: four bits of one 64-bit cell each. It may take others for words, never a word for none."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.depth = cells, len(cells).bit_length() - 1

    @staticmethod
    def depth_for(words: int) -> int:
        return max(10, min(MOST_CELLS, max(1, words * CELLS_A_WORD)).bit_length())

    @staticmethod
    def places(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, its first bit) of each value."""
        spread = values * SPREAD
        return (spread >> np.uint64(64 - depth)).astype(np.int64), (spread >> np.uint64(58 - depth)) & np.uint64(63)

    @staticmethod
    def more_bits(values: np.ndarray) -> np.ndarray:
        mixed = (values ^ (values >> np.uint64(31))) * MIX
        one = np.uint64(1)
        return (one << (mixed >> np.uint64(58))) | (one << ((mixed >> np.uint64(52)) & np.uint64(63))) | (one << ((mixed >> np.uint64(46)) & np.uint64(63)))

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Indexes of those of ``values`` (flat) that may be words."""
        cell, bit = self.places(values, self.depth)
        some = np.flatnonzero((self.cells[cell] >> bit) & np.uint64(1))
        bits = self.more_bits(values[some])
        return some[(self.cells[cell[some]] & bits) == bits]


def neighbours(words: list[str], letters: str, known: WordFilter | None = None) -> Iterator[tuple[int, str]]:
    """(place in ``words``, neighbour): every distinct string one deletion, replacement or insertion away.

    letters: what may be put in. known: leaves out neighbours that it doesn't hold.
    """
    alphabet = [(x, np.uint64(ord(x) + 1)) for x in letters]
    for at, codes in _codes(words):
        m, size = codes.shape
        power = _powers(size + 1)
        terms = codes * power[:size]
        before = np.zeros((m, size + 1), np.uint64)
        np.cumsum(terms, axis=1, out=before[:, 1:])
        whole = before[:, -1:]

        def kept(values: np.ndarray, valid: np.ndarray) -> Iterator[tuple[int, int]]:
            found = np.flatnonzero(valid.ravel()) if known is None else known.holds(values.ravel())
            row, place = np.divmod(found, values.shape[1])
            good = valid[row, place]
            yield from zip(at[row[good]].tolist(), place[good].tolist(), strict=True)

        if size:  # of a run of equal letters, the first goes
            first = np.ones((m, size), bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            for k, i in kept(before[:, :-1] + (whole - before[:, 1:]) * BASE_INVERSE, first):
                yield k, words[k][:i] + words[k][i + 1 :]
        others, moved = whole - terms, before + (whole - before) * BASE
        differs = np.ones((m, size + 1), bool)  # a letter put before its equal is the same as one put after it
        for letter, code in alphabet:
            differs[:, :size] = codes != code
            for k, i in kept(others + code * power[:size], differs[:, :size]) if size else ():
                yield k, words[k][:i] + letter + words[k][i + 1 :]
            for k, i in kept(moved + code * power[: size + 1], differs):
                yield k, words[k][:i] + letter + words[k][i:]


def filter_of(df: DataFrame, column: str, values: Callable[[pa.Array], np.ndarray], n: int) -> WordFilter:
    """The filter of some ``n`` rows; values: a 64-bit value of each item of ``column``.

    Bits are joined by cell, then by segment, before the driver reads them: 64 MB at most.
    """
    depth = WordFilter.depth_for(n)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = values(b.column(0))
            cell, bit = WordFilter.places(found, depth)
            mask = (np.uint64(1) << bit) | WordFilter.more_bits(found)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], names=["cell", "bits"])

    def joined(part: pa.Table) -> pa.Table:
        cells = np.zeros(SEGMENT, np.uint64)
        cell = part.column("cell").to_numpy()
        cells[cell % SEGMENT] = part.column("bits").to_numpy().view(np.uint64)
        return pa.table({"segment": pa.array([int(cell[0]) // SEGMENT]), "cells": pa.array([cells.tobytes()], pa.binary())})

    one = df.select(column).mapInArrow(bits, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    parts = one.groupBy(F.expr(f"cell div {SEGMENT}")).applyInArrow(joined, "segment bigint, cells binary").collect()
    cells = np.zeros(1 << depth, np.uint64)
    for r in parts:
        piece = np.frombuffer(bytes(r["cells"]), np.uint64)
        cells[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = piece[: len(cells)]
    return WordFilter(cells)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, both ways.

    vocabulary: (word, n), distinct words without nulls. A word has at most a neighbourhood's size of near words, so no
    key of the join holds more than that.
    """
    spark = vocabulary.sparkSession
    ship(spark)
    n = vocabulary.count()
    letters = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect()))  # an alphabet
    sent = spark.sparkContext.broadcast(filter_of(vocabulary, "word", lambda words: word_values(words.to_pylist()), n).cells)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFilter(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TASK_WORDS):
                words = batch.column(0).slice(k, TASK_WORDS).to_pylist()
                found = list(neighbours(words, letters, known))
                own = pa.array([words[i] for i, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([own, pa.array([x for _, x in found], pa.string())], names=["word", "near"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_WORDS))
    candidates = vocabulary.select("word").repartition(tasks).mapInArrow(emit, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each step follows twice as many forms as the one before."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        stepped = materialize(now.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        now = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return now


def spelling_variants(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word.

    form: the near word of largest n, ties to the smaller in code-point order, if it is found ``times`` as often as the
    word, else null; root: where forms lead, the word itself without one; n_near: near words, 0 if none; form_n: the
    form's n or null. Each form is more frequent than its word, so forms never turn in a circle.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    often = -F.col("best.less") >= times * F.col("n")
    found = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
