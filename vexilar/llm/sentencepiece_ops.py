"""SentencePiece encoding and decoding, and sampled segmentations without replacement.

Encoding and decoding are those of the model. A text's segmentations are the paths of a lattice whose arcs are the
pieces; a piece of rank r weighs 1 / (r + 2), the shape that frequencies by rank have. Sampling k paths without
replacement is a best-first search over perturbed log-probabilities (Gumbel top-k): the set of all paths gets one
Gumbel maximum, a set that is taken off the queue passes its maximum to the path drawn from it, and what is left of
it returns with a maximum drawn below that. The paths come out in the order of their perturbed values, never twice,
and the first value beyond them gives each path's probability of inclusion.

No piece crosses from one stretch of text (blanks with the word after them, or a run that no merge enters) to the
next, so stretches are encoded once while they are in use.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.arrow import map_arrow, map_large_blocks
from vexilar.llm.text import own_columns

BLANK = "▁"
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|()[]{}*#$%&<>=+/\\\"'-_~^`@"
#: Stretches a worker keeps, beyond which it starts afresh with the next texts.
KEPT = 700_000
#: Bytes of text that are sampled at once: a lattice has some 20 arcs a stretch.
SLICE = 700_000
#: Log-probability below which the rest of a text can't matter to a draw in double precision.
NEGLIGIBLE = -45.0
#: Of the rolling hash that finds pieces in text; checked to be free of collisions among the model's own pieces.
MULTIPLIER, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: The lower half of an arc is its piece (see ids_of), the upper half the running probability at its node in 2^-32.
HALF = 32
BUCKET_BITS, SPREAD = 17, 0xD6E8FEB86659FD93
# The step and the multipliers of splitmix64, a public generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Sample:
    """One sampled segmentation: its rank, pieces, log-probability, perturbed value and inclusion probability."""

    rank: int
    ids: np.ndarray
    logp: float
    perturbed: float
    inclusion: float


class Codec:
    """Encoder, decoder and lattice of one SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        kind = ["byte" if self.sp.is_byte(i) else "other" if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) else "text" for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if kind[i] == "byte"}
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int64)
        self.text_id = {self.pieces[i]: i for i in range(n) if kind[i] == "text"}
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(BLANK, " ").encode() if k == "text" else b"" for p, k in zip(self.pieces, kind)]
        self.raw_lengths = np.array([len(r) for r in self.raw])
        self.raw_starts = np.concatenate([[0], np.cumsum(self.raw_lengths)[:-1]])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.longest = max(map(len, self.text_id))
        order = sorted(self.text_id.values(), key=lambda i: (-self.sp.get_score(i), i))
        weight = {i: -math.log(r + 2) for r, i in enumerate(order)}
        self.text_weight = {p: weight[i] for p, i in self.text_id.items()}
        self.byte_weight = -math.log(len(order) + 2)
        # by piece; the last is that of a code point of several bytes, which is one arc
        self.size = np.array([len(p) if k == "text" else 1 for p, k in zip(self.pieces, kind)] + [1])
        self.weight = np.array([weight.get(i, self.byte_weight) for i in range(n)] + [0.0])
        self.starts = {p[:k] for p in self.text_id for k in range(1, len(p) + 1)}
        if any(BLANK in p.lstrip(BLANK) for p in self.text_id):
            raise ValueError("this model has pieces across words; stretches can't be encoded apart")
        self.cut = self._cutter()
        self.clear()

    def _cutter(self) -> re.Pattern[str]:
        """Cuts where no piece can cross: before blanks, around a line break, and between letters and marks.

        A character is a mark if no piece has it right after one of LETTERS.
        """
        after_letter = {b for p in self.text_id for a, b in zip(p, p[1:]) if re.match(f"[{LETTERS}]", a)}
        m = "".join(re.escape(c) for c in MARKS if c not in after_letter)
        line = "" if any("\n" in p for p in self.text_id if len(p) > 1) else "\n"
        word = f"{BLANK}*[{LETTERS}]++(?:(?=[{m}])|[^{BLANK}{line}]*)|" if m else ""  # a word that no mark follows is one with what does
        return re.compile(f"{word}{BLANK}*[^{BLANK}{line}]+|{BLANK}+" + (f"|{line}" if line else ""))

    # -- encoding and decoding --

    def stretches(self, text: str) -> list[str]:
        """The text with blanks marked and the model's leading blank, cut where no piece crosses."""
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str | None) -> np.ndarray:
        """The model's pieces of a whole text."""
        return self.encode_numbers(self.numbers(self.stretches(text or "")))

    def encode_numbers(self, numbers: np.ndarray) -> np.ndarray:
        """The pieces of stretches given by their numbers."""
        size = self.best_start[numbers + 1] - self.best_start[numbers]
        at = np.repeat(self.best_start[numbers] - (np.cumsum(size) - size), size)
        return self.best_ids[at + np.arange(len(at))]

    def encode_many(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that have so many stretches each, given by the numbers of all of them."""
        size = self.best_start[numbers + 1] - self.best_start[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.best_ids[np.repeat(self.best_start[numbers] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of pieces that lie end to end, with one pass over the pieces."""
        raw = self._bytes(ids).tobytes()
        at = np.concatenate([[0], np.cumsum(self.raw_lengths[ids])])[offsets].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def _encode_new(self, new: list[str]) -> list[list[int]]:
        """Encodes stretches in one call of the model.

        The model puts a blank before what it is given: a stretch loses its first blank, or gets a line break, which
        is a piece of its own, before it.
        """
        blank = [p[0] == BLANK for p in new]
        out = self.sp.encode([p[1:].replace(BLANK, " ") if b else "\n" + p for p, b in zip(new, blank)], num_threads=1)
        return [(o if len(p) > 1 else [self.text_id[BLANK]]) if b else o[2:] for p, b, o in zip(new, blank, out)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of pieces, without the leading blank that encoding puts before it."""
        raw = self._bytes(np.asarray(ids)).tobytes().decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(0, np.uint8)
        n = self.raw_lengths[ids]
        at = np.repeat(self.raw_starts[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.raw_bytes[at + np.arange(n.sum())]

    # -- the lattice --

    def clear(self) -> None:
        """Forgets all stretches: nodes and arcs are numbered anew."""
        self._room: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}  # of each stretch that is kept
        self.root, self.span = np.zeros(0, np.int64), np.zeros(0, np.int64)  # its first node, and characters up to its last
        self.best_start, self.best_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # its encoding
        self.first_arc = np.zeros(1, np.int32)  # of each node, and the number of arcs
        self.after = np.zeros(0)  # of each node: log-weight of all paths from there to the stretch's last node
        self.arcs = np.zeros(0, np.uint64)

    def _append(self, name: str, more: np.ndarray) -> None:
        """Lengthens an array in place, with room to spare, so that growing costs no copy each time."""
        now, room = getattr(self, name), self._room.get(name)
        size = len(now) + len(more)
        if room is None or size > len(room):
            room = self._room[name] = np.empty(size + size // 2 + 1024, now.dtype)
            room[: len(now)] = now
        room[len(now) : size] = more
        setattr(self, name, room[:size])

    def _hashes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted hashes of all beginnings of pieces, the piece that each is (-1: none), its weight, and buckets of them."""
        if not hasattr(self, "_known"):
            rows = {}
            for p in self.starts:
                h = 0
                for c in p:
                    h = (h * MULTIPLIER + ord(c) + 1) & MASK
                if h in rows:
                    raise ValueError("two beginnings of pieces have the same hash; use another multiplier")
                rows[h] = (self.text_id.get(p, -1), self.text_weight.get(p, 0.0))
            rows = {h * SPREAD & MASK: v for h, v in rows.items()}  # a short beginning's hash has no leading bits of its own
            order = sorted(rows)
            keys = np.array([*order, 0], np.uint64)  # the last matches nothing: a hash is found by its own value only
            ids, weights = np.array([*(rows[h][0] for h in order), -1], np.int32), np.array([*(rows[h][1] for h in order), 0.0])
            first = np.searchsorted(keys[:-1] >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
            self._known = keys, ids, weights, first.astype(np.int32), int(np.diff(first).max())
            del self.starts
        return self._known

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the vocabulary of the hashes that are in it, which these are), by the hashes' leading bits."""
        keys, _, _, first, most = self._vocabulary()
        h = h * np.uint64(SPREAD)
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, end = first[bucket], first[bucket + 1]
        found = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(most):
            if not len(live):
                break
            same = keys[at[live]] == h[live]
            found[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        on = np.flatnonzero(found >= 0)
        return found[on], on

    def add(self, parts: list[str]) -> None:
        """Encodes new stretches and builds their lattices, all at once.

        From each node arcs leave for the pieces that begin there, or, where no piece is the character alone, for the
        character's bytes as one arc. Arc probabilities are those of the weights of whole paths.
        """
        parts = [p for p in dict.fromkeys(parts) if p not in self.number]
        if not parts:
            return
        encoded = self._encode_new(parts)
        self._append("best_start", self.best_start[-1] + np.cumsum(list(map(len, encoded))))
        self._append("best_ids", np.fromiter(chain.from_iterable(encoded), np.int32))
        _, ids, weights, *_ = self._vocabulary()
        text = "".join(parts)
        chars = self._hashes(text)
        sizes = np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes), sizes)  # of each character's stretch
        n = len(chars)
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        starts, stops, pieces, logs = [], [], [], []
        for size in range(1, self.longest + 1):
            inside = alive + size <= ends[alive]
            alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = h * np.uint64(MULTIPLIER) + chars[alive + size - 1] + np.uint64(1)
            at, on = self._find(h)
            alive, h = alive[on], h[on]
            piece = ids[at] >= 0
            starts.append(alive[piece])
            stops.append(alive[piece] + size)
            pieces.append(ids[at[piece]])
            logs.append(weights[at[piece]])
            if size == 1:
                single = np.zeros(n, bool)
                single[alive[piece]] = True
        bare = np.flatnonzero(~single)  # a code point as bytes: the byte's piece, or -1 - code point for several bytes
        codes = chars[bare].astype(np.int64)
        as_bytes = np.where(codes < 0x80, self.byte_ids[np.minimum(codes, 0x7F)], -1 - codes).astype(np.int32)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        start, stop = np.concatenate([*starts, bare]), np.concatenate([*stops, bare + 1])
        piece, weight = np.concatenate([*pieces, as_bytes]), np.concatenate([*logs, self.byte_weight * width])
        # weights of all paths from each node to its end, nodes nearest to their ends first
        depth = ends[start] - start
        # one integer key sorts much faster than several; it is unique, so that sums don't depend on the batch
        order = np.argsort((depth * n + start) * 32 + np.minimum(stop - start, 31))
        start, stop, piece, weight, depth = (x[order] for x in (start, stop, piece, weight, depth))
        after = np.zeros(n + 1)
        after_of = np.empty(len(start))
        begin = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        for lo, hi in zip(begin, begin[1:]):
            s, e = start[lo:hi], stop[lo:hi]
            term = weight[lo:hi] + np.where(e == ends[s], 0.0, after[np.minimum(e, n)])
            node = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
            top = np.maximum.reduceat(term, node)
            count = np.diff(np.append(node, len(s)))
            total = top + np.log(np.add.reduceat(np.exp(term - np.repeat(top, count)), node))
            after[s[node]] = total
            after_of[lo:hi] = term - np.repeat(total, count)
        less = np.minimum(-after_of * 1024, (1 << 19) - 1).astype(np.int64)  # by node, likelier arcs first
        order = np.argsort((start << 24) + (less << 5) + np.minimum(stop - start, 31))
        start, piece, p = start[order], piece[order], np.exp(after_of[order])
        first = np.searchsorted(start, np.arange(n + 1))
        run = np.cumsum((p * (1 << HALF)).astype(np.int64))  # whole numbers: a node's sums don't depend on those before it
        run -= np.repeat(np.concatenate([[0], run])[first[:-1]], np.diff(first))
        run[first[1:] - 1] = (1 << HALF) - 1  # the last arc of a node takes what rounding leaves
        arc0, node0 = len(self.arcs), len(self.after)
        last = np.cumsum(sizes)  # where each stretch's last node, which has no arcs, comes in
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        self._append("root", node0 + last - sizes + np.arange(len(parts)))
        self._append("span", sizes)
        self._append("first_arc", (arc0 + np.insert(first[1:], last, first[last])).astype(np.int32))
        self._append("after", np.insert(after[:-1], last, 0.0))
        self._append("arcs", (np.minimum(run, (1 << HALF) - 1).astype(np.uint64) << np.uint64(HALF)) | piece.view(np.uint32))

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of stretches; new ones are added."""
        found = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = [parts[i] for i in new]
            self.add(missing)
            found[new] = [self.number[p] for p in missing]
        return found

    def tidy(self, kept: int = KEPT) -> None:
        """Starts afresh when more than so many stretches are kept; between texts only."""
        if len(self.number) > kept:
            self.clear()

    # -- sampling --

    def walk(self, nodes: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draws a path from each node to the last one of its stretch: (pieces, their log-probabilities, steps).

        Paths follow each other as the nodes do. state: of each path's own generator.
        """
        steps, live, now = [], np.flatnonzero(nodes < ends), nodes
        if len(live) < len(nodes):
            now, ends, state = now[live], ends[live], state[live]
        length = np.zeros(len(nodes), np.int64)
        before = self.after[now]
        while len(live):
            state = state + np.uint64(STEP)
            u = _mix(state.copy()) >> np.uint64(HALF)
            at = self.first_arc[now].astype(np.int64)
            arc = self.arcs[at]
            late = np.flatnonzero(u > arc >> np.uint64(HALF))
            while len(late):
                at[late] += 1
                arc[late] = more = self.arcs[at[late]]
                late = late[u[late] > more >> np.uint64(HALF)]
            piece = arc.view(np.int32)[::2]
            known = np.maximum(piece, -1)
            now = now + self.size[known]
            after = self.after[now]
            steps.append((live, piece, self._weights(piece, known) + after - before))
            on = now < ends
            length[live[~on]] = len(steps)
            live, now, ends, state, before = live[on], now[on], ends[on], state[on], after[on]
        pieces, logp = np.empty(length.sum(), np.int32), np.empty(length.sum())
        begin = np.cumsum(length) - length
        for k, (live, piece, lp) in enumerate(steps):  # steps of a stretch follow each other as they were drawn
            at = begin[live] + k
            pieces[at], logp[at] = piece, lp
        return pieces, logp, length

    def _weights(self, piece: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The log-weights of steps; known: the pieces, -1 for bytes."""
        w = self.weight[known]
        at = np.flatnonzero(piece < 0)
        if len(at):
            code = -1 - piece[at]
            w[at] = self.byte_weight * (2 + (code > 0x7FF) + (code > 0xFFFF))
        return w

    def leaving(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that leave a node, likelier ones first, and their log-probabilities."""
        piece = self.arcs[self.first_arc[node] : self.first_arc[node + 1]].view(np.int32)[::2]
        known = np.maximum(piece, -1)
        return piece, self._weights(piece, known) + self.after[node + self.size[known]] - self.after[node]

    def ids_of(self, path: np.ndarray) -> np.ndarray:
        """The model's pieces of a path, whose step -1 - c stands for the bytes of code point c."""
        if not len(path) or path.min() >= 0:
            return path
        at = np.flatnonzero(path < 0)
        out, last = [], 0
        for k in at:
            code = chr(-1 - int(path[k]))
            out += [path[last:k], self.byte_ids[list(code.encode("utf-8", "replace"))].astype(np.int32)]
            last = k + 1
        return np.concatenate([*out, path[last:]])

    def sample(self, text: str | None, k: int, seed: int) -> list[Sample]:
        """k distinct segmentations of a text, or all of them if there are fewer, by falling perturbed value."""
        return search(self, [self.numbers(self.stretches(text or ""))], k, [seed])[0]


def _mix(z: np.ndarray) -> np.ndarray:
    """The output of splitmix64 for states, which are overwritten."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(FIRST)
    z ^= z >> np.uint64(27)
    z *= np.uint64(SECOND)
    z ^= z >> np.uint64(31)
    return z


class Draws:
    """The random numbers of one row: splitmix64 from its seed."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def bits(self) -> int:
        self.state = (self.state + STEP) & MASK
        z = self.state
        z = (z ^ (z >> 30)) * FIRST & MASK
        z = (z ^ (z >> 27)) * SECOND & MASK
        return z ^ (z >> 31)

    def uniform(self) -> float:
        return (self.bits() >> 11) * 2.0**-53

    def exponential(self) -> float:
        return max(-math.log1p(-self.uniform()), 1e-300)


def _below(loc: float, bound: float, draws: Draws) -> float:
    """A Gumbel of the location, given that it is below the bound."""
    if loc == -math.inf:
        return -math.inf
    # exp(-g) = exp(-bound) + e * exp(-loc), in logarithms
    a, b = -bound, math.log(draws.exponential()) - loc
    top = max(a, b)
    return -(top + math.log(math.exp(a - top) + math.exp(b - top)))


class _Rest:
    """The paths that leave a drawn path after ``start`` steps of it and were not drawn themselves.

    leave[t] is the probability of following the path for t steps and then leaving it by an arc not taken yet. Only
    the steps whose prefix is likelier than NEGLIGIBLE are looked at.
    """

    def __init__(self, path: np.ndarray, logp: np.ndarray, start: int, position: int, before: float) -> None:
        self.path, self.logp, self.start, self.position = path, logp, start, position
        n = 96
        while True:
            own = logp[start : start + n]
            self.at = before + np.cumsum(own) - own  # log-probability of each prefix from start
            if start + n >= len(logp) or self.at[-1] - before < NEGLIGIBLE:
                break
            n *= 4
        window = max(1, int(np.searchsorted(before - self.at, -NEGLIGIBLE)))
        self.leave = np.exp(self.at[:window]) * -np.expm1(np.minimum(own[:window], 0.0))
        self.taken: dict[int, set[int]] = {}

    def mass(self) -> float:
        total = float(self.leave.sum())
        return math.log(total) if total > 0 else -math.inf

    def draw(self, text: _Text) -> tuple[int, int, float, int] | None:
        """(steps before leaving, piece to leave by, its log-probability, position), which is then taken; None: none."""
        c, draws = text.codec, text.draws
        while True:
            edge = np.cumsum(self.leave)
            if not len(edge) or edge[-1] <= 0:
                return None
            t = min(int(np.searchsorted(edge, draws.uniform() * edge[-1], side="right")), len(edge) - 1)
            while self.leave[t] <= 0:
                t -= 1
            position = self.position + int(c.size[np.maximum(self.path[self.start : self.start + t], -1)].sum())
            pieces, logp = c.leaving(position + int(text.shift[text.stretch(position)]))
            taken = self.taken.setdefault(t, {int(self.path[self.start + t])})
            free = [i for i, p in enumerate(pieces.tolist()) if p not in taken]
            if free:
                break
            self.leave[t] = 0.0  # a share of rounding: there is nothing to leave by
        p = np.exp(logp[free])
        k = min(int(np.searchsorted(np.cumsum(p), draws.uniform() * p.sum(), side="right")), len(free) - 1)
        piece = int(pieces[free[k]])
        taken.add(piece)
        self.leave[t] = math.exp(self.at[t]) * float(p.sum() - p[k]) if len(free) > 1 else 0.0
        return t, piece, float(logp[free[k]]), position


class _Text:
    """One text's lattice and its search: found paths, and a queue of what is left by falling perturbed value."""

    def __init__(self, codec: Codec, numbers: np.ndarray, seed: int) -> None:
        self.codec, self.draws = codec, Draws(seed)
        self.root, span = codec.root[numbers], codec.span[numbers]
        self.last = self.root + span
        self.stop = np.cumsum(span)  # of each stretch, in the text's characters
        self.shift = self.last - self.stop  # from a position in the text to a node
        self.found: list[tuple[float, float, np.ndarray]] = []
        self.queue: list[tuple[float, int, _Rest]] = []
        self.tie = 0

    def stretch(self, position: int) -> int:
        return int(np.searchsorted(self.stop, position, side="right"))

    def streams(self, first: int) -> np.ndarray:
        """The states of the generators of the stretches from ``first`` on, for the path drawn now."""
        base = np.uint64(self.draws.bits())
        return _mix(np.arange(first + 1, len(self.root) + 1, dtype=np.uint64) * np.uint64(FIRST) ^ base)

    def push(self, rest: _Rest, bound: float) -> None:
        heapq.heappush(self.queue, (-_below(rest.mass(), bound, self.draws), self.tie, rest))
        self.tie += 1

    def begin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What to walk for the first path."""
        return self.root, self.last, self.streams(0)

    def take_first(self, path: np.ndarray, logp: np.ndarray) -> None:
        value = -math.log(self.draws.exponential())  # the maximum over all paths: a standard Gumbel
        self.found.append((float(logp.sum()), value, path))
        self.push(_Rest(path, logp, 0, 0, 0.0), value)

    def next(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """What to walk for the next path, which leaves an earlier one; None: k paths are found, or all."""
        while len(self.found) < k and self.queue and self.queue[0][0] < math.inf:
            minus, _, rest = heapq.heappop(self.queue)
            way = rest.draw(self)
            if way is None:
                continue
            here = self.stretch(way[3])
            self.open = minus, rest, *way
            after = way[3] + int(self.codec.size[max(way[1], -1)])
            return np.concatenate([[after + self.shift[here]], self.root[here + 1 :]]), self.last[here:], self.streams(here)
        return None

    def take(self, path: np.ndarray, logp: np.ndarray) -> None:
        """The path that ``next`` opened, with the steps that were walked for it."""
        minus, rest, t, piece, own, position = self.open
        step = rest.start + t
        path = np.concatenate([rest.path[:step], np.array([piece], np.int32), path])
        logp = np.concatenate([rest.logp[:step], [own], logp])
        self.found.append((float(logp.sum()), -minus, path))
        self.push(rest, -minus)
        self.push(_Rest(path, logp, step + 1, position + int(self.codec.size[max(piece, -1)]), float(rest.at[t]) + own), -minus)

    def samples(self) -> list[Sample]:
        bound = -self.queue[0][0] if self.queue else -math.inf
        out = []
        for r, (logp, perturbed, path) in enumerate(self.found):
            inclusion = 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(logp - bound, 700.0)))
            out.append(Sample(r, self.codec.ids_of(path), logp, perturbed, inclusion))
        return out


def search(codec: Codec, texts: list[np.ndarray], k: int, seeds: list[int]) -> list[list[Sample]]:
    """Best-first searches for the k greatest perturbed paths of texts, given by the numbers of their stretches.

    The texts' searches go in step, so that the paths which they open are drawn together; each draws from generators
    of its own, so that what it finds doesn't depend on the others.
    """
    states = [_Text(codec, n, s) for n, s in zip(texts, seeds)]
    live, wanted, first = states, [t.begin() for t in states], True
    while live:
        pieces, logp, steps = codec.walk(*(np.concatenate(x) for x in zip(*wanted)))
        paths = np.concatenate([[0], np.cumsum([len(w[0]) for w in wanted])])
        at = np.concatenate([[0], np.cumsum(steps)])[paths].tolist()
        for t, a, b in zip(live, at, at[1:]):
            (t.take_first if first else t.take)(pieces[a:b], logp[a:b])
        more = [(t, w) for t in live if (w := t.next(k)) is not None]
        live, wanted, first = [t for t, _ in more], [w for _, w in more], False
    return [t.samples() for t in states]


# ---- Spark ----

_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The codec of a public model file, one a process."""
    if name not in _codecs:
        import public_tokenizers

        _codecs[name] = Codec(public_tokenizers.path(name))
    return _codecs[name]


def _encoded(c: Codec, texts: list[str | None], numbers: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """(ids, round_trip) of texts by the numbers of their stretches."""
    ids, offsets = c.encode_many(np.concatenate(numbers), np.array([len(n) for n in numbers]))
    good = pa.array([d == (t or "") for d, t in zip(c.decode_many(ids, offsets), texts)], pa.bool_())
    return pa.ListArray.from_arrays(offsets.astype(np.int32), ids), good


def _make_encoder(name: str):
    def make():
        c = codec(name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("_text").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("_id"), *_encoded(c, texts, _numbered(c, texts))], names=["_id", "ids", "round_trip"])

        return step

    return make


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))


def encode_documents(docs: DataFrame, name: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, round_trip): the model's pieces of every whole text, and whether they decode to it.

    A null or empty text has no pieces and round-trips as ''. Repeated rows each get a row, ids may be null, other
    columns are ignored, an empty table gives no row.
    """
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string"))
    return map_arrow(own, _make_encoder(name), f"_id {dict(docs.dtypes)[doc_id]}, ids array<int>, round_trip boolean", "_text").withColumnRenamed("_id", "doc_id")


def _make_decoder(name: str):
    def make():
        c = codec(name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("_ids")
            ids, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [t if ok else None for t, ok in zip(c.decode_many(ids[offsets[0] : offsets[-1]], offsets - offsets[0]), lists.is_valid().to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

        return step

    return make


def decode_documents(encoded: DataFrame, name: str = "piece_bpe_32k.model", doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of pieces; null arrays give null texts."""
    own = own_columns(encoded, _id=doc_id, _ids=ids).withColumn("_size", F.coalesce(F.size("_ids"), F.lit(0)).cast("bigint") * 8)
    return map_arrow(own, _make_decoder(name), f"_id {dict(encoded.dtypes)[doc_id]}, text string", "_size").withColumnRenamed("_id", "doc_id")


SAMPLES = "array<struct<rank:int,ids:array<int>,logp:double,perturbed:double,inclusion:double>>"


def _make_sampler(name: str, k: int):
    def make():
        c = codec(name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, seeds = batch.column("_text").to_pylist(), batch.column("_seed").to_pylist()
            numbers = _numbered(c, texts)
            return pa.RecordBatch.from_arrays([batch.column("_id"), samples_array(search(c, numbers, k, seeds))], names=["_id", "samples"])

        return step

    return make


def _numbered(c: Codec, texts: list[str | None], kept: int = KEPT) -> list[np.ndarray]:
    """The numbers of the stretches of each text; the new ones of all texts are added at once."""
    c.tidy(kept)
    rows = [c.stretches(t or "") for t in texts]
    found = c.numbers(list(chain.from_iterable(rows)))
    return np.split(found, np.cumsum([len(r) for r in rows])[:-1]) if rows else []


def samples_array(found: list[list[Sample]]) -> pa.Array:
    """Lists of samples as one Arrow array of SAMPLES."""
    flat = [s for f in found for s in f]
    at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    fields = [pa.array([s.rank for s in flat], pa.int32()), _lists([s.ids for s in flat]), *[pa.array([getattr(s, n) for s in flat], pa.float64()) for n in ("logp", "perturbed", "inclusion")]]
    kind = [("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, fields=[pa.field(*k) for k in kind]))


def row_seed(key: Column, seed: int) -> Column:
    """The seed of a row's draws, from its key."""
    return F.xxhash64(key, F.lit(seed))


def sample_documents(docs: DataFrame, k: int = 2, seed: int = 17, name: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, samples): k distinct sampled segmentations of every whole text, by falling perturbed value.

    Draws depend on the row's id, the seed and the text alone, so a task that is run again, or rows with the same id
    and text, give the same samples. A text with fewer than k segmentations gives all of them, each with inclusion 1;
    a null or empty text has one, without pieces. ids may be null, other columns are ignored.
    """
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string")).withColumn("_seed", row_seed(F.col("_id"), seed))
    return map_arrow(own, _make_sampler(name, k), f"_id {dict(docs.dtypes)[doc_id]}, samples {SAMPLES}", "_text", SLICE).withColumnRenamed("_id", "doc_id")


def _make_both(name: str, k: int, kept: int):
    def make():
        if kept < KEPT:
            map_large_blocks()
        c = codec(name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, seeds = batch.column("_text").to_pylist(), batch.column("_seed").to_pylist()
            numbers = _numbered(c, texts, kept)
            return pa.RecordBatch.from_arrays([batch.column("_id"), *_encoded(c, texts, numbers), samples_array(search(c, numbers, k, seeds))], names=["_id", "ids", "round_trip", "samples"])

        return step

    return make


def encode_and_sample(docs: DataFrame, k: int = 2, seed: int = 17, name: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """(doc_id, ids, round_trip, samples): ``encode_documents`` and ``sample_documents`` in one pass over the texts.

    kept: stretches that a worker keeps, at about 0.5 kB each; it changes the speed only. A worker that keeps fewer
    than KEPT also gives memory back sooner.
    """
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string")).withColumn("_seed", row_seed(F.col("_id"), seed))
    return map_arrow(own, _make_both(name, k, kept), f"_id {dict(docs.dtypes)[doc_id]}, ids array<int>, round_trip boolean, samples {SAMPLES}", "_text", SLICE).withColumnRenamed("_id", "doc_id")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of what ``encode_and_sample`` returns, in place of its arrays of pieces."""
    each = lambda f: F.transform("samples", f)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "round_trip", F.xxhash64("ids").alias("pieces_hash"), F.size("samples").cast("bigint").alias("n_samples"),
        each(lambda s: F.size(s["ids"])).alias("sample_pieces"), each(lambda s: F.xxhash64(s["ids"])).alias("sample_hashes"),
        each(lambda s: s["logp"]).alias("sample_logp"), each(lambda s: s["perturbed"]).alias("sample_perturbed"), each(lambda s: s["inclusion"]).alias("sample_inclusion"),
    )
