"""Token counts of byte-level BPE by prefix dynamic programming.

A vocabulary's merge order leaves exactly one possible last token for every prefix of a piece of text: the token
that ends there and is stable beside the last token of the prefix before it. So counts[i] = counts[i - len(last)] + 1
holds the exact count of every prefix, and truncation or budget questions are look-ups. Texts are first cut into the
pieces that merges never cross; a piece's table is kept while it is in use, since few pieces make up most text.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.llm.arrow import map_arrow
from vexilar.llm.text import own_columns

# Fixed value: the pattern by which byte-level BPE cuts text before merging.
CONTRACTIONS = ("'re", "'ve", "'ll")  # those with a beginning that is cut otherwise
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tables a worker keeps at most; then it starts afresh.
KEPT_PIECES = 600_000
#: Bytes of a piece up to which every beginning of a last token is tried.
SHORT = 24
#: Longer pieces are counted without being kept.
LONGEST_KEPT = 64


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixCounter:
    """Exact prefix counts for one vocabulary file (tokenizers .json, byte-level BPE without a normalizer)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in _byte_letters().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.ranks:
            self.made.setdefault(a + b, (a, b))
        self.ids = {t: i for t, i in self.ids.items() if len(t) == 1 or t in self.made and self._apart(*self.made[t], self.ranks[self.made[t]])}
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[-2:], {1}).add(len(t))
        self.ending = {two: tuple(sorted(found, reverse=True)) for two, found in lengths.items()}  # longest first
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces, self.blanks = regex.compile(PIECES), regex.compile(r"\s+")
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.kept: dict[str, list[int]] = {}  # bounded by a fifth of KEPT_PIECES, as tables are larger than counts
        self.sizes: dict[str, int] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a piece by applying merges in order: the definition, quadratic, for tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _apart(self, left: bytes, right: bytes, limit: int) -> bool:
        """Whether no merge of an earlier rank than ``limit`` joins two tokens across their boundary.

        Merges are undone from the latest to the earliest on both sides; each state of the boundary lasts until the
        merge that was just undone. Of equal ranks the one further left comes first.
        """
        while True:
            if self.ranks.get((left, right), limit) < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if b is not None and (a is None or self.ranks[b] >= self.ranks[a]):
                limit, right = self.ranks[b] + 1, b[0]
            elif a is not None:
                limit, left = self.ranks[a], a[1]
            else:
                return True

    def _beside(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) > 300_000:
                self.stable.clear()
            found = self.stable[(left, right)] = not left or self._apart(left, right, 1 << 60)
        return found

    def _table(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i]."""
        if len(data) > SHORT:
            return self._long_table(data)
        n, ids, beside = len(data), self.ids, self._beside
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            token = data[:i]
            if token in ids:  # nothing stands before it
                counts[i], last[i] = 1, token
                continue
            for start in range(1, i):
                token = data[start:i]
                if token in ids and beside(last[start], token):
                    counts[i], last[i] = counts[start] + 1, token
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of a piece; the vocabulary lacks single bytes")
        return counts

    def _long_table(self, data: bytes) -> list[int]:
        """``_table`` with those lengths of a last token only that tokens with the same last two bytes have."""
        n, ids, beside, ending = len(data), self.ids, self._beside, self.ending
        counts, last, first = [0] * (n + 1), [b""] * (n + 1), (1,)
        for i in range(1, n + 1):
            for size in ending.get(data[i - 2 : i], first) if i > 1 else first:
                start = i - size
                if start < 0:
                    continue
                token = data[start:i]
                if token in ids and beside(last[start], token):
                    counts[i], last[i] = counts[start] + 1, token
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of a piece; the vocabulary lacks single bytes")
        return counts

    def table(self, piece: str) -> list[int]:
        """Token counts of every prefix of a piece, by bytes."""
        found = self.kept.get(piece)
        if found is None:
            found = self._table(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= LONGEST_KEPT:
                if len(self.kept) >= KEPT_PIECES // 5:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def _size(self, piece: str) -> int:
        n = self._table(piece.encode("utf-8", "surrogatepass"))[-1]
        if len(piece) <= LONGEST_KEPT:
            if len(self.sizes) >= KEPT_PIECES:
                self.sizes.clear()
            self.sizes[piece] = n
        return n

    def _plain(self, text: str):
        """(part, is_special) in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; special strings inside it are one token each. None: 0."""
        total, get = 0, self.sizes.get
        for part, special in self._plain(text or ""):
            if special:
                total += 1
                continue
            pieces = self.pieces.findall(part)
            sizes = list(map(get, pieces))
            if None in sizes:
                sizes = [self._size(p) if n is None else n for p, n in zip(pieces, sizes)]
            total += sum(sizes)
        return total

    def _by_char(self, piece: str) -> list[int]:
        """Token counts of every prefix of a piece, by code points."""
        counts = self.table(piece)
        if len(counts) == len(piece) + 1:
            return counts
        ends, at = [0], 0
        for c in piece:
            at += len(c.encode("utf-8", "surrogatepass"))
            ends.append(at)
        return [counts[e] for e in ends]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """counts[n]: tokens of text[:n] for every n, exactly as if that prefix were encoded alone.

        A prefix has the pieces of the whole text up to the one that it ends in, whose own prefix counts say the rest.
        Three ends are cut otherwise: blanks at the end are one piece, however the text goes on after them; the
        beginning of a contraction is a mark and a letter; and that of a special string is plain text.
        """
        text = text or ""
        out = [0] * (len(text) + 1)
        base, at, tail = 0, 0, (0, 0)  # tail: from where what follows may change the pieces, and the tokens up to there
        for part, special in self._plain(text):
            if special:
                for n in range(at + 1, at + len(part)):
                    out[n] = tail[1] + self.count(text[tail[0] : n])
                base, at = base + 1, at + len(part)
                out[at], tail = base, (at, base)
                continue
            blank_to = 0
            for m in self.pieces.finditer(part):
                piece, a = m[0], m.start()
                blank = self.blanks.match(part, a)
                if a >= blank_to:  # a run of blanks may go on over several pieces and into the next word
                    tail = (at + a, base)
                    if blank:
                        blank_to = blank.end()
                        out[at + a + 1 : at + blank_to + 1] = [base + c for c in self._by_char(blank[0])[1:]]
                if not blank or blank.end() < m.end():
                    counts, skip = self._by_char(piece), 1 + bool(blank)
                    out[at + a + skip : at + m.end() + 1] = [base + c for c in counts[skip:]]
                    if piece in CONTRACTIONS:
                        out[at + a + 2] = base + self.table("'")[-1] + self.table(piece[1])[-1]
                    base += counts[-1]
                else:
                    base += self.table(piece)[-1]
            at += len(part)
        return np.array(out, np.int32)

    def tokens_in_prefix(self, text: str, length: int, counts: np.ndarray | None = None) -> int:
        """Tokens of text[:length], looked up."""
        counts = self.prefix_counts(text) if counts is None else counts
        return int(counts[max(0, min(length, len(counts) - 1))])

    def truncate(self, text: str | None, budget: int, counts: np.ndarray | None = None) -> str:
        """The longest prefix with at most ``budget`` tokens, looked up; '' for a negative budget."""
        counts = self.prefix_counts(text) if counts is None else counts
        fits = np.flatnonzero(counts <= budget)
        return (text or "")[: fits[-1]] if len(fits) else ""


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one a process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _make_counts(name: str):
    def make():
        import pyarrow as pa

        c = counter(vocabulary(name))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("_text").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(map(c.count, texts), pa.int64())], names=["_id", "n_bytes", "n_tokens"])

        return step

    return make


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the vocabulary's library, over whole texts. A null or empty text has no bytes and no tokens;
    repeated rows each get a row, ids may be null, other columns are ignored, an empty table gives no row.
    """
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string"))
    own = own.withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("bigint"))
    found = map_arrow(own, _make_counts(name), f"_id {dict(docs.dtypes)[doc_id]}, n_bytes bigint, n_tokens bigint", "_text")
    return found.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _make_tables(name: str):
    def make():
        import pyarrow as pa

        c = counter(vocabulary(name))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [c.prefix_counts(t) for t in batch.column("_text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(at, np.concatenate(found))], names=["_id", "counts"])

        return step

    return make


def prefix_tables(docs: DataFrame, name: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): counts[n] holds the tokens of each text's first n code points, for every n from 0.

    ``tokens_within`` and ``chars_within`` answer from it without the tokenizer. A null or empty text has the table
    [0]; other edge cases are as in ``count_tokens``.
    """
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string"))
    return map_arrow(own, _make_tables(name), f"_id {dict(docs.dtypes)[doc_id]}, counts array<int>", "_text", 2_000_000).withColumnRenamed("_id", "doc_id")


def tokens_within(tables: DataFrame, length: int) -> DataFrame:
    """(doc_id, chars, tokens): the tokens of each text's first ``length`` code points, or of all of it if it is shorter."""
    n = F.greatest(F.lit(0), F.least(F.lit(length), F.size("counts") - 1))
    return tables.select("doc_id", n.alias("chars"), F.get("counts", n).alias("tokens"))


def chars_within(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, tokens): the code points of the longest prefix with at most ``budget`` tokens; nulls if it is negative."""
    back = F.array_position(F.transform(F.reverse("counts"), lambda x: x <= budget), True)  # counts may fall as a text goes on
    n = F.when(back > 0, F.size("counts") - back).cast("int")
    return tables.select("doc_id", n.alias("chars"), F.get("counts", n).alias("tokens"))
