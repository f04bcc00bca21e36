"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line without ASCII blanks at its ends and with A-Z in lower case; long keys are told apart by a
128-bit hash. Spark counts the documents of each hash, and the hashes found often enough are dealt to shards by their
first bits. A shard is one small file in the shared folder: a minimal perfect hash of its hashes (bit levels with ranks, a
few bits a line) and three arrays in its order, of 64-bit fingerprints, counts and the greatest document id. Documents
probe the arrays: no line is joined to anything.

While all shards together are small, each worker holds them and probes as it reads the texts. Beyond that bound the
documents' hashes are sorted by shard, in ranges of bounded size, so that a worker holds one shard at a time whatever a
shard's share of all lines; positions found to go are then put back to their document.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.llm.arrow import give_back, map_arrow
from vexilar.llm.text import own_columns, with_row_key
from vexilar.session import materialize, scratch_path, ship
from vexilar.sources.store import store, write_file

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
#: Indexed lines of a shard; bytes of shards that every worker may hold.
SHARD_LINES, HELD_BYTES = 200_000, 64_000_000
#: Bits of a level for each hash still without a place; bytes of an indexed line in its shard, to tell sizes beforehand.
GAMMA, LINE_BYTES = 2, 21

#: Stands for a null id: below every other.
NO_ID = -(1 << 63)


# ---- minimal perfect hash ----


def _spread(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit value of each hash for each level (the finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit hashes to 0 .. n - 1, each to its own: a hash's place is the rank of its bit among all levels.

    A level has GAMMA bits for each hash that the levels before have left; a bit is set where just one falls, and the
    others go on. Other hashes get some place, or -1, so a fingerprint must tell them from members.
    """

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    @staticmethod
    def build(hashes: np.ndarray) -> PerfectHash:
        left, sizes, bits = hashes, [], []
        while len(left):
            size = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = (_spread(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("equal hashes can't have places of their own")
        return PerfectHash(sizes, np.concatenate(bits) if bits else np.zeros(0, np.uint64))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_spread(hashes[left], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[there]] = (self.before[at >> 6] + below)[there]
            left, start = left[~there], start + size
        return out


class Shard:
    """A perfect hash with, by place, the fingerprint, the count of documents and the greatest id of each line."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.index, self.prints, self.counts, self.last = index, prints, counts, last

    @staticmethod
    def build(hashes: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        index = PerfectHash.build(hashes)
        order = np.argsort(index.places(hashes))
        return Shard(index, prints[order], np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), last[order])

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<qq{len(self.index.sizes)}q", self.index.n, len(self.index.sizes), *self.index.sizes)
        return head + self.index.words.tobytes() + self.prints.tobytes() + self.last.tobytes() + self.counts.tobytes()

    @staticmethod
    def all_of(data: bytes) -> list[Shard]:
        out, at = [], 0
        while at < len(data):
            found, at = Shard._next(data, at)
            out.append(found)
        return out

    @staticmethod
    def _next(data: bytes, at: int) -> tuple[Shard, int]:
        n, levels = struct.unpack_from("<qq", data, at)
        sizes, at = list(struct.unpack_from(f"<{levels}q", data, at + 16)), at + 16 + 8 * levels
        arrays = []
        for kind, size in ((np.uint64, sum(sizes) // 64), (np.uint64, n), (np.int64, n), (np.uint32, n)):
            arrays.append(np.frombuffer(data, kind, size, at))
            at += arrays[-1].nbytes
        words, prints, last, counts = arrays
        return Shard(PerfectHash(sizes, words), prints, counts, last), at

    def probe(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, greatest id) of each line; 0 documents for a line that isn't indexed."""
        at = self.index.places(hashes)
        member = (at >= 0) & (self.prints[at] == prints)
        return np.where(member, self.counts[at].astype(np.int64), 0), np.where(member, self.last[at], 0)


# ---- lines ----


def line_keys(text: bytes | None, least_length: int = LEAST_LENGTH) -> tuple[list[bytes], list[int], list[bytes]]:
    """(lines, places of those whose key is long enough, the 128-bit hash of each of these keys) of a text."""
    from xxhash import xxh3_128_digest

    lines = (text or b"").split(b"\n")
    at, digests = [], []
    for k, line in enumerate(lines):
        if len(line) >= least_length:
            key = line.strip().lower()  # bytes: the six ASCII blanks, and A-Z only
            size = len(key)
            if size >= least_length and (size >= 4 * least_length or len(key.decode("utf-8", "surrogatepass")) >= least_length):
                at.append(k)
                digests.append(xxh3_128_digest(key))
    return lines, at, digests


def _numbers(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(h, f, documents, last): hash and fingerprint of each long line found in enough documents (rows), and their greatest id."""
    own = own_columns(docs, _id=F.col(f"`{doc_id}`").cast("bigint"), _text=F.col(f"`{text}`").cast("string"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, sizes = [], []
            for t in batch.column("_text").cast(pa.binary()).to_pylist():
                found = list(dict.fromkeys(line_keys(t, least_length)[2]))
                digests += found
                sizes.append(len(found))
            h, f = _numbers(digests)
            last = np.repeat(_ids(batch), sizes)
            order = np.lexsort((f, h))  # equal lines of a batch are one row
            h, f, last = h[order], f[order], last[order]
            start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(h)))
            most = np.maximum.reduceat(last, start) if len(h) else last
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[start].view(np.int64), f[start].view(np.int64), n.astype(np.int64), most.astype(np.int64))], names=["h", "f", "n", "last"])

        return step

    seen = map_arrow(own, make, "h bigint, f bigint, n bigint, last bigint", "_text")
    return seen.groupBy("h", "f").agg(F.sum("n").alias("documents"), F.max("last").alias("last")).where(F.col("documents") >= least_documents)


class LineIndex:
    """Shard files in the shared folder: ``shards`` of them, of some ``bytes`` in all."""

    def __init__(self, folder: str, shards: int, lines: int) -> None:
        self.folder, self.shards, self.lines, self.bytes = folder, shards, lines, lines * LINE_BYTES

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def path(self, shard: int) -> str:
        return f"{self.folder}/shard-{shard:06d}"


def build_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> LineIndex:
    """Writes the shards of (h, f, documents, last). Hashes spread evenly, so shards are of nearly equal size.

    Lines whose first 64 bits agree can't have places in the same perfect hash: a second one follows in the file.
    """
    spark = lines.sparkSession
    ship(spark)
    lines = materialize(lines, "shared_lines")
    n = lines.count()
    index = LineIndex(scratch_path(spark, "line_index"), max(1, -(-n // shard_lines)), n)

    def write(part: pa.Table) -> pa.Table:
        h, f, last = (part.column(c).to_numpy().view(kind) for c, kind in (("h", np.uint64), ("f", np.uint64), ("last", np.int64)))
        documents, left, data = part.column("documents").to_numpy(), np.arange(len(h)), b""
        while len(left):
            some = left[np.unique(h[left], return_index=True)[1]]
            data += Shard.build(h[some], f[some], documents[some], last[some]).to_bytes()
            left = np.setdiff1d(left, some)
        shard = int(index.shard_of(h[:1])[0])
        return pa.table({"shard": pa.array([shard]), "size": pa.array([write_file(index.path(shard), data)])})

    dealt = lines.groupBy(F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 32) * {index.shards}, 32)"))
    dealt.applyInArrow(write, "shard bigint, size bigint").agg(F.sum("size")).first()
    return index


_held: OrderedDict[str, list[Shard]] = OrderedDict()


def _shard(index: LineIndex, shard: int, most: int) -> list[Shard]:
    """A shard by number, none if no line fell to it; a worker keeps the last ``most``."""
    path = index.path(shard)
    if path in _held:
        _held.move_to_end(path)
        return _held[path]
    files, at = store(path)
    found = []
    if files.get_file_info(at).is_file:
        with files.open_input_stream(at) as f:
            found = Shard.all_of(f.read())
    _held[path] = found
    while len(_held) > max(1, most):
        _held.popitem(last=False)
    return found


def probe(index: LineIndex, h: np.ndarray, f: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Whether each line goes from the document of that id: it is indexed, and a greater id holds it."""
    goes = np.zeros(len(h), bool)
    shard = index.shard_of(h)
    order = np.argsort(shard, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
        for layer in _shard(index, int(shard[some[0]]), most):
            documents, last = layer.probe(h[some], f[some])
            goes[some] |= (documents > 0) & (ids[some] != last)
    return goes


SCHEMA = "n_lines bigint, n_dropped bigint"


def _left(text: bytes | None, drop: set[int]) -> bytes:
    return b"\n".join(line for k, line in enumerate((text or b"").split(b"\n")) if k not in drop) if drop else text or b""


def _results(batch: pa.RecordBatch, texts: list[bytes | None], drops: list[set[int]], digest: bool) -> pa.RecordBatch:
    kept = [_left(t, d) for t, d in zip(texts, drops, strict=True)]
    out = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
    n = pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("_id"), n, pa.array(list(map(len, drops)), pa.int64()), out], names=["_id", "n_lines", "n_dropped", "kept"])


def _probe_as_read(own: DataFrame, index: LineIndex, least_length: int, digest: bool) -> DataFrame:
    """Texts probe the shards as they are read: nothing is shuffled."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            places, digests, sizes = [], [], []
            for t in texts:
                _, at, found = line_keys(t, least_length)
                places += at
                digests += found
                sizes.append(len(at))
            h, f = _numbers(digests)
            goes = probe(index, h, f, np.repeat(_ids(batch), sizes), index.shards)
            drops, k = [], 0
            for n in sizes:
                drops.append({places[i] for i in range(k, k + n) if goes[i]})
                k += n
            return _results(batch, texts, drops, digest)

        return step

    return map_arrow(own, make, f"_id bigint, {SCHEMA}, kept string", "_text")


def _probe_by_shard(own: DataFrame, index: LineIndex, least_length: int, digest: bool) -> DataFrame:
    """Hashes go to ranges of shards, and a document gets back the places of the lines to drop."""
    own = materialize(with_row_key(own), "line_texts")
    shards = index.shards

    def hashes() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            places, digests, sizes = [], [], []
            for t in batch.column("_text").cast(pa.binary()).to_pylist():
                _, at, found = line_keys(t, least_length)
                places += at
                digests += found
                sizes.append(len(at))
            h, f = _numbers(digests)
            row = np.repeat(batch.column("_row").to_numpy(), sizes)
            columns = (index.shard_of(h), h.view(np.int64), f.view(np.int64), row, np.array(places, np.int64), np.repeat(_ids(batch), sizes))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "h", "f", "_row", "place", "_id"])

        return step

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, f, ids = (batch.column(c).to_numpy().view(kind) for c, kind in (("h", np.uint64), ("f", np.uint64), ("_id", np.int64)))
            goes = pa.array(probe(index, h, f, ids, 1))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(goes) for c in ("_row", "place")], names=["_row", "place"])
        give_back()

    lines = map_arrow(own, hashes, "shard bigint, h bigint, f bigint, _row bigint, place bigint, _id bigint", "_text")
    n = max(shards, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_lines = materialize(lines, "line_hashes").repartitionByRange(n, "shard", "_row").sortWithinPartitions("shard")
    goes = sorted_lines.mapInArrow(answer, "_row bigint, place bigint").groupBy("_row").agg(F.collect_list("place").alias("places"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            drops = [set(x or ()) for x in batch.column("places").to_pylist()]
            return _results(batch, batch.column("_text").cast(pa.binary()).to_pylist(), drops, digest)

        return step

    joined = own.join(goes, "_row", "left").select("_id", "_text", "places")
    return map_arrow(joined, make, f"_id bigint, {SCHEMA}, kept string", "_text")


def drop_shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, digest: bool = False,
    held_bytes: int = HELD_BYTES, shard_lines: int = SHARD_LINES,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), one row a row of ``docs``; with ``digest``, kept_sha256 in place of text.

    A line whose key has ``least_length`` code points and is found in ``least_documents`` rows is dropped from all rows
    but those of the greatest doc_id that holds it, where all its copies stay. A text's own repeats count as one row;
    rows of one id are separate rows. Null and empty texts are one empty line; a null doc_id is below every other. Ids
    are whole numbers. Other columns are ignored; an empty table gives no row.
    """
    index = build_index(shared_lines(docs, doc_id, text, least_length, least_documents), shard_lines)
    own = own_columns(docs, _id=F.col(f"`{doc_id}`").cast("bigint"), _text=F.col(f"`{text}`").cast("string"))
    done = (_probe_as_read if index.bytes <= held_bytes else _probe_by_shard)(own, index, least_length, digest)
    return done.select(F.col("_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("kept_sha256" if digest else "text"))
