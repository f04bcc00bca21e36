"""WARC archives with a two-level capture index.

Tasks write archives of gzip members, one record each, into shared storage; a file has its final name only once it is
complete, so a lost task leaves nothing that an index names. The index holds a line a record, sorted by the URL key
with the host reversed. Its lines are gathered in compressed blocks, and a sparse directory holds each block's first
key: a look-up searches the directory, reads one block's range, searches that, and reads the records' ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexilar.llm.spelling import WordFilter, filter_of
from vexilar.llm.text import own_columns
from vexilar.session import materialize, scratch_path, ship

#: Bytes after which a task starts another archive, lines in a block of the index, and gzip's level.
ARCHIVE_BYTES, BLOCK_LINES, LEVEL = 256_000_000, 500, 4
#: Repeated payloads that are broadcast at most: at about 130 bytes each in a hash table, 65 MB.
BROADCAST_ROWS = 500_000
#: Bytes of archives that a task reads, and that it reads at once where records follow each other.
TASK_BYTES, READ_BYTES = 64_000_000, 8_000_000
# Fixed values of the format.
VERSION, BREAK = b"WARC/1.1\r\n", b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "urlkey string, page_id bigint, url string, digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def url_key(url: Column) -> Column:
    """host reversed by labels, then ')' and path with query, lower-case: neighbours on a site sort together.

    Blanks and line breaks are escaped, so that keys sort as they stand in the index. A null address has the key ')'.
    """
    low = F.replace(F.replace(F.lower(F.coalesce(url, F.lit(""))), F.lit(" "), F.lit("%20")), F.lit("\n"), F.lit("%0a"))
    rest = F.regexp_replace(F.regexp_extract(low, r"(?s)\A(?:[^/?#]*://)?([^#]*)", 1), r"(?s)\A[^/?#]*@", "")
    host = F.regexp_extract(rest, r"(?s)\A([^/?:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"(?s)\A[^/?]*", ""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def encode_record(own_id: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One record as its own gzip member, an HTTP response. A revisit lacks the payload, but has its digest and size.

    A revisit refers to the record that is named after the digest.
    """
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=True)[1:-1]}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    body = HTTP.format(size).encode() + (b"" if revisit else payload or b"")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(f'payload:{digest}')}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress(VERSION + "\r\n".join(lines).encode() + BREAK + body + BREAK, LEVEL, mtime=0)


def decode_record(member: bytes) -> Record:
    """The record in one gzip member, with what follows the HTTP header; raises ValueError where it is not one whole record."""
    raw = gzip.decompress(member)
    head, found, rest = raw.partition(BREAK)
    if not raw.startswith(VERSION) or not found:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != BREAK:
        raise ValueError("a WARC record has another length than it states")
    return Record(headers, rest[:size].partition(BREAK)[2])


_SCHEMA = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (f.split(" ") for f in LINE.split(", "))])


class _Archive:
    """One archive being written; it gets its final name when it is closed."""

    def __init__(self, root: str, run: str) -> None:
        self.files, base = store(root)
        self.name = f"{run}-{uuid.uuid4().hex}.warc.gz"
        self.temp, self.path = f"{base}/.{self.name}.open", f"{base}/{self.name}"
        self.files.create_dir(base, recursive=True)
        self.out, self.at, self.lines = self.files.open_output_stream(self.temp), 0, []

    def add(self, row: dict, date: str) -> None:
        digest, revisit = base64.b32encode(row["digest"]).decode(), row["revisit"]
        own = record_id(f"payload:{digest}" if row["shared"] and not revisit else f"{self.name}:{self.at}")
        member = encode_record(own, row["page_id"], row["url"], row["payload"], row["size"], digest, revisit, row["refers_to"], date)
        self.out.write(member)
        self.lines.append({"urlkey": row["urlkey"], "page_id": row["page_id"], "url": row["url"], "digest": digest, "record_type": "revisit" if revisit else "response", "refers_to": row["refers_to"], "file": self.name, "offset": self.at, "length": len(member)})
        self.at += len(member)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.files.move(self.temp, self.path)
        return pa.RecordBatch.from_pylist(self.lines, schema=_SCHEMA)


def _make_writer(root: str, run: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: long pages aren't copied as a whole batch
                archive = archive or _Archive(root, run)
                archive.add({n: batch.column(n)[k].as_py() for n in batch.schema.names}, date)
                if archive.at >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return write


def _one_of_ties(tied: DataFrame) -> DataFrame:
    """Rows that share the least id and the payload: one of those with the least address responds, the others revisit it."""
    key = ["digest", "page_id"]
    groups = tied.groupBy(*key, "url").agg(F.count("*").alias("_c"), F.first("urlkey").alias("urlkey"), F.first("size").alias("size"))
    chosen = tied.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(F.struct(F.col("url").isNull().alias("none"), "url"))["url"].alias("_url"))
    rows = groups.join(chosen, "digest").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    rows = rows.withColumn("revisit", ~((F.col("_k") == 1) & F.col("url").eqNullSafe(F.col("_url"))))
    return rows.withColumn("payload", F.when(~F.col("revisit"), F.col("payload"))).withColumn("refers_to", F.when(F.col("revisit"), F.col("page_id"))).withColumn("shared", F.lit(True))


PLAN = ("page_id", "url", "payload", "size", "urlkey", "digest", "shared", "revisit", "refers_to")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """PLAN's columns: which record holds a payload (shared: for others too), and which revisit it.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id responds, and the others
    revisit it; null ids come last, and of rows that share the smallest id one responds. A null html is an empty
    payload. Only (digest, page_id) is shuffled, counted first; the repeated digests go back by broadcast while there
    are at most ``broadcast_rows``. Beyond that filters of digests part the pages, and one payload of each repeated one is shuffled.
    """
    own = own_columns(pages, page_id=F.col(f"`{page_id}`").cast("bigint"), url=F.col(f"`{url}`").cast("string"), payload=F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8"))
    own = own.select("*", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    ids = own.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("_c"))
    firsts = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_c")).alias("_f"), F.sum("_c").alias("_n")).where("_n > 1")
    firsts = materialize(firsts.select(F.col("digest").alias("_d"), F.col("_f.page_id").alias("_first"), (F.col("_f._c") > 1).alias("_ties")), "repeated_payloads")
    repeated = firsts.count()
    if repeated > broadcast_rows:
        return _planned_by_filters(own, firsts, repeated, least)
    joined = own.join(F.broadcast(firsts), (F.col("digest") == F.col("_d")) & (F.col("size") >= least), "left")
    joined = joined.withColumn("shared", F.col("_d").isNotNull()).withColumn("urlkey", url_key(F.col("url")))
    first = F.col("page_id").eqNullSafe(F.col("_first"))
    rows = joined.withColumn("revisit", F.col("shared") & ~first).withColumn("refers_to", F.when(F.col("revisit"), F.col("_first")))
    rows = rows.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    if not repeated or firsts.where("_ties").isEmpty():
        return rows.select(*PLAN)
    tied = F.col("shared") & F.coalesce(F.col("_ties"), F.lit(False)) & first
    return rows.where(~tied).select(*PLAN).union(_one_of_ties(joined.where(tied)).select(*PLAN))


def _digest_values(digests: pa.Array) -> np.ndarray:
    """The first 64 bits of each digest."""
    held = pa.array(digests).cast(pa.binary(20))
    return np.frombuffer(held.buffers()[1], np.uint8).reshape(-1, 20)[held.offset : held.offset + len(held), :8].copy().view(np.uint64).ravel()


def _may_hold(df: DataFrame, column: str, n: int) -> Callable[[Column], Column]:
    """A test of digests: false only for those that ``df`` doesn't have. It reads the digest alone."""
    sent = df.sparkSession.sparkContext.broadcast(filter_of(df, column, _digest_values, n).cells)

    @F.pandas_udf("boolean")
    def held(digest: pd.Series) -> pd.Series:
        out = np.zeros(len(digest), bool)
        out[WordFilter(sent.value).holds(_digest_values(pa.array(digest, pa.binary())))] = True
        return pd.Series(out)

    return held


def _planned_by_filters(own: DataFrame, firsts: DataFrame, repeated: int, least: int) -> DataFrame:
    """PLAN's columns where repeated payloads are too many to broadcast: of each, one payload is shuffled.

    A filter of repeated digests lets through the pages that may share a payload; the others are done. Those that pass are
    joined to the repeated digests without their payloads, which settles revisits. Of the rest, a filter of their (digest,
    page_id) finds the pages whose payload is written, and only these are joined with it.
    """
    ship(own.sparkSession)
    may = _may_hold(firsts, "_d", repeated)
    passed = (F.col("size") >= least) & may("digest")
    own = own.withColumn("urlkey", url_key(F.col("url")))
    alone = own.where(~passed).select(*[c for c in own.columns], F.lit(False).alias("shared"), F.lit(False).alias("revisit"), F.lit(None).cast("bigint").alias("refers_to"))
    narrow = own.where(passed).drop("payload").join(firsts, F.col("digest") == F.col("_d"), "left")
    narrow = narrow.withColumn("shared", F.col("_d").isNotNull()).withColumn("revisit", F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("_first")))
    narrow = materialize(narrow, "page_decisions")
    revisits = narrow.where("revisit").withColumn("payload", F.lit(None).cast("binary")).withColumn("refers_to", F.col("_first"))
    wanted = materialize(narrow.where("not revisit").groupBy("digest", "page_id").agg(F.first("shared").alias("shared"), F.coalesce(F.first("_ties"), F.lit(False)).alias("_ties")), "payload_pages")
    key = lambda: F.unhex(F.sha1(F.concat("digest", F.coalesce(F.encode(F.col("page_id").cast("string"), "UTF-8"), F.lit(b"")))))
    among = _may_hold(wanted.select(key().alias("_k")), "_k", wanted.count())
    named = wanted.withColumnsRenamed({"digest": "_w", "page_id": "_p"})
    written = own.where(passed).where(among(key())).join(named, (F.col("digest") == F.col("_w")) & F.col("page_id").eqNullSafe(F.col("_p")))
    written = written.withColumn("revisit", F.lit(False)).withColumn("refers_to", F.lit(None).cast("bigint"))
    done = alone.select(*PLAN).union(revisits.select(*PLAN)).union(written.where("not _ties").select(*PLAN))
    return done.union(_one_of_ties(written.where("_ties")).select(*PLAN))


def write_archives(pages: DataFrame, root: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None, run: str | None = None, **columns: str) -> DataFrame:
    """Writes a record for every page below ``root`` and returns the index lines (see LINE), themselves stored.

    Repeated rows each get a record. Every task writes its own archives; one that is lost is written again under
    another name, and the lines name only archives that were completed by the task that counts. Names begin with that of
    the run (a new one by default); what its lost tasks left below ``root`` is removed. An empty table gives no line.
    """
    run = run or uuid.uuid4().hex[:12]
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = materialize(plan_records(pages, least=least, **columns).mapInArrow(_make_writer(root, run, date, archive_bytes), LINE), "warc_lines")
    _sweep(root, run, lines)
    return lines


def _sweep(root: str, run: str, lines: DataFrame) -> None:
    """Removes the run's archives that no line names. An archive holds a few hundred MB, so names are few."""
    files, base = store(root)
    named = {r[0] for r in lines.select("file").distinct().toLocalIterator()}
    for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.removeprefix(".").startswith(f"{run}-") and f.base_name not in named:
            files.delete_file(f.path)


DIRECTORY = "first_key string, file string, offset bigint, length bigint, lines bigint, record_bytes bigint"


def _make_blocks(root: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        name, out, at, lines, held, found = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], 0, []

        def flush() -> None:
            nonlocal out, at, lines, held
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/.{name}.open")
            block = gzip.compress("\n".join(lines).encode(), LEVEL, mtime=0)
            out.write(block)
            found.append({"first_key": lines[0].split(" ", 1)[0], "file": name, "offset": at, "length": len(block), "lines": len(lines), "record_bytes": held})
            at, lines, held = at + len(block), [], 0

        for batch in batches:
            for row in batch.to_pylist():
                key, held = row.pop("urlkey"), held + row["length"]
                lines.append(f"{key} {json.dumps(row, separators=(',', ':'))}")
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            files.move(f"{base}/.{name}.open", f"{base}/{name}")
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split(" ") for f in DIRECTORY.split(", "))]))

    return write


def build_index(lines: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts the lines by URL key into compressed blocks below ``root``; returns the stored directory of blocks.

    The range partitioning has the page's id after the key, so that captures of one URL can fill several partitions.
    """
    ordered = lines.repartitionByRange("urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    return materialize(ordered.mapInArrow(_make_blocks(root, block_lines), DIRECTORY), "warc_directory")


def read_range(root: str, name: str, offset: int, length: int) -> bytes:
    files, base = store(root)
    with files.open_input_file(f"{base}/{name}") as f:
        return f.read_at(length, offset)


def block_lines_of(root: str, block: dict) -> list[tuple[str, dict]]:
    """The lines of one block, as (key, fields), in order."""
    raw = gzip.decompress(read_range(root, block["file"], block["offset"], block["length"])).decode()
    return [(key, json.loads(rest)) for key, rest in (line.split(" ", 1) for line in raw.split("\n"))]


class CaptureIndex:
    """Look-ups by URL key: a directory row a block in memory, one range read a block, one a record."""

    def __init__(self, root: str, directory: list[dict]) -> None:
        self.root, self.blocks = root, sorted(directory, key=lambda b: (b["first_key"], b["file"], b["offset"]))
        self.keys = [b["first_key"] for b in self.blocks]

    @classmethod
    def load(cls, root: str, directory: DataFrame) -> CaptureIndex:
        """The directory is one row for BLOCK_LINES captures; larger ones than 10 million rows are refused."""
        if directory.count() > 10_000_000:
            raise ValueError("the block directory is too large for one process; build the index with larger blocks")
        return cls(root, [r.asDict() for r in directory.toLocalIterator()])

    def find(self, key: str) -> list[dict]:
        """All captures with this key, none for an unknown key or an empty directory; repeated rows are each a capture."""
        found, k = [], max(0, bisect_right(self.keys, key) - 1)
        while k > 0 and self.keys[k] == key:  # captures of one key may begin in an earlier block
            k -= 1
        while k < len(self.blocks) and self.keys[k] <= key:
            lines = block_lines_of(self.root, self.blocks[k])
            at = bisect_right(lines, key, key=lambda x: x[0])
            while at > 0 and lines[at - 1][0] == key:
                at -= 1
            while at < len(lines) and lines[at][0] == key:
                found.append(lines[at][1])
                at += 1
            k += 1
        return found

    def fetch(self, capture: dict) -> Record:
        return decode_record(read_range(self.root, capture["file"], capture["offset"], capture["length"]))


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


_LINE = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string())])


def _make_lister(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([fields for _, fields in block_lines_of(root, block)], schema=_LINE)

    return read


def _make_reader(root: str, with_payload: bool):
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split(" ") for f in READ.split(", "))])

    def row_of(line: dict, member: bytes) -> tuple:
        record = decode_record(member)
        h = record.headers
        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
        if kind == "response" and (digest_of(record.payload) != digest or len(record.payload) != int(h["X-Payload-Length"])):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} has another digest than its record states")
        number = lambda name: int(h[name]) if h.get(name) else None
        return number("X-Page-ID"), line["url"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page"), record.payload if with_payload and kind == "response" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        name, open_file, piece, start, rows, held = None, None, b"", 0, [], 0
        for batch in batches:
            lines = batch.to_pylist()
            ends = [x["offset"] + x["length"] for x in lines]
            for k, line in enumerate(lines):
                if line["file"] != name:
                    name, open_file, piece = line["file"], files.open_input_file(f"{base}/{line['file']}"), b""
                if not start <= line["offset"] <= ends[k] <= start + len(piece):  # what follows without a gap comes along
                    last = k
                    while last + 1 < len(lines) and lines[last + 1]["file"] == name and lines[last + 1]["offset"] == ends[last] and ends[last + 1] - line["offset"] <= READ_BYTES:
                        last += 1
                    start = line["offset"]
                    piece = open_file.read_at(ends[last] - start, start)
                rows.append(row_of(line, piece[line["offset"] - start : ends[k] - start]))
                held += len(rows[-1][-1] or b"") + 200
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return read


def read_archives(root: str, directory: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record that the index names, read back by ranges and checked against its digest (see READ).

    The blocks of the index are read first. Their lines are then dealt by archive and stretch of it, some TASK_BYTES a
    task, and sorted, so that a task opens few archives and reads them forward. payload is that of response records;
    payload_bytes and payload_digest are those of the full payload for revisits too. An empty directory gives no row.
    """
    blocks, size = directory.agg(F.count("*"), F.coalesce(F.sum("record_bytes"), F.lit(0))).first()
    listed = directory.repartition(max(1, blocks // 16)).mapInArrow(_make_lister(root), "file string, offset bigint, length bigint, url string")
    tasks = max(size // TASK_BYTES, min(blocks, directory.sparkSession.sparkContext.defaultParallelism * 4), 1)
    stretch = F.floor(F.col("offset") / (TASK_BYTES // 16))  # a hash deals these evenly enough
    dealt = listed.repartition(int(tasks), "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_make_reader(root, with_payload), READ)


def archive_and_read(spark: SparkSession, pages: DataFrame, root: str | None = None, least: int = 0, block_lines: int = BLOCK_LINES, with_payload: bool = False) -> DataFrame:
    """Writes the archives and the index of ``pages`` below ``root`` (scratch space if None) and reads them back."""
    root = root or scratch_path(spark, "warc")
    return read_archives(root, build_index(write_archives(pages, root, least), root, block_lines), with_payload)
