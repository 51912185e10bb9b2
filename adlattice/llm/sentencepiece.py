"""SentencePiece encoding as a max-plus parallel scan.

A text's segmentations are paths through a lattice of pieces. For unigram models a
path's weight is the sum of its pieces' scores. For BPE models, two neighbours weigh 0
if merging would leave them as they are and minus infinity if not: the merges' result
is the one path on which all neighbours are so (a merge across a border of pieces
depends on the two pieces at the border alone). Both are maxima of sums, so a text can
be cut anywhere: for each state at its left border, a piece that reaches over it, a
chunk gives the weight of the best path to each state at its right border. These
transfer matrices combine associatively; the combined weights fix the state at every
border, and each chunk is then backtraced by itself.

Most borders are trivial: no piece reaches over the start of a word, and the matrix
there is of one state. So a text's path is the paths of its words; distinct words are
found once a task, a batch of them side by side in numpy, a place of all of them at a
time. Giant documents are cut into chunks anywhere; their matrices are combined in a
tree of products over tasks, and the states at the borders are handed down that tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = 16_384  # characters
GIANT = 4 * CHUNK
FAN = 32  # matrices of a product in the tree
SIDE = 256  # characters of a run that is laid side by side with others; longer ones go alone
NEVER = 1 << 30  # the rank of a pair that makes no piece
MOST_CACHED = 400_000  # words, and pairs of pieces, that a process remembers
START, NOWHERE = -1, -2  # in place of a piece: before the text; no path


def load(path: str = MODEL) -> dict:
    """What encoding needs of a model file, as plain values."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        raw = file.read()
    proto.ParseFromString(raw)
    normal = proto.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models without text normalisation are supported")
    return {
        "name": hashlib.md5(raw).hexdigest(),
        "bpe": proto.trainer_spec.model_type == 2,
        "prefix": normal.add_dummy_prefix,
        "pieces": [(p.piece, p.score, p.type) for p in proto.pieces],
    }


class Table:
    """A map from non-negative 64-bit numbers to numbers, for arrays of them: open
    addressing in two numpy arrays."""

    def __init__(self, room: int):
        self.bits = max(4, (2 * room).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        self.room, self.held = room, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, none: int) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], none)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        self.held += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)


class Segmenter:
    """Best paths through the piece lattice of one model."""

    def __init__(self, model: dict):
        self.bpe, self.prefix = model["bpe"], model["prefix"]
        pieces = model["pieces"]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.scores = {p: s for p, s, kind in pieces if kind in (1, 4)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        apart = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids)
        #: Runs that no piece reaches out of; one run if the pieces cross words.
        self.run = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if apart else r"(?s:.+)")
        self.out = [b"" if kind == 3 else bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(BLANK, " ").encode() for p, _, kind in pieces]
        self.out_size = np.array([len(x) for x in self.out], dtype=np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(self.out), dtype=np.uint8)
        self.stable = lru_cache(1 << 17)(self._stable)
        self.whole = lru_cache(1 << 17)(lambda p: self._merged(p) == [p])
        self.cache: dict[str, bytes] = {}
        self.apart = Table(MOST_CACHED)
        self._table()
        self._trie()

    def _table(self) -> None:
        """For merges of many runs at once: a number for each character and piece, and
        for each pair of them that makes a piece its rank and the piece, sorted by pair."""
        names = {p: i for i, p in enumerate(self.ids)}
        self.names = list(self.ids)
        self.of_char = np.arange(0x110000, dtype=np.int64) + len(names)  # no piece
        for p, i in names.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = {}
        for p, i in names.items():
            for k in range(1, len(p)):
                a, b = names.get(p[:k]), names.get(p[k:])
                a = self.of_char[ord(p[:k])] if a is None and k == 1 else a
                b = self.of_char[ord(p[k:])] if b is None and k == len(p) - 1 else b
                if a is not None and b is not None:
                    pairs[int(a) << 32 | int(b)] = (order[self.scores[p]], i)
        self.merges = Table(len(pairs))
        self.merges.add(np.array(list(pairs), dtype=np.int64), np.array([r << 32 | i for r, i in pairs.values()], dtype=np.int64))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; the rank is NEVER if it makes none."""
        made = self.merges.find(a << 32 | b, NEVER << 32)
        return made >> 32, made & 0xFFFFFFFF

    def merge_many(self, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols the merges leave of each run, and the merges in their order: (run,
        rank, the run's first and last symbol afterwards). In each round, every run makes its
        best merge, the leftmost among equals."""
        sizes = np.array([len(r) for r in runs])
        symbols, run = np.concatenate(runs), np.repeat(np.arange(len(runs)), sizes)
        rank, make = np.full(len(symbols), NEVER), np.zeros(len(symbols), dtype=np.int64)
        if len(symbols) > 1:
            rank[:-1], make[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1][run[1:] != run[:-1]] = NEVER
        left, steps = np.zeros(len(runs), dtype=np.int64), []
        while len(symbols):
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            best = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
            done = best >= NEVER << 32
            n = np.diff(np.append(first, len(symbols)))
            left[run[first[done]]] = n[done]
            go = np.repeat(~done, n)
            at = (np.cumsum(go) - 1)[(best & 0xFFFFFFFF)[~done]]
            symbols, run, rank, make = symbols[go], run[go], rank[go], make[go]
            if not len(symbols):
                break
            symbols[at] = make[at]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            symbols, run, rank, make = symbols[stay], run[stay], rank[stay], make[stay]
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            steps.append(np.stack([run[first], (best >> 32)[~done], symbols[first], symbols[np.append(first[1:], len(symbols)) - 1]]))
            for i in (at - 1, at):  # the pairs on either side of a merge are new
                i = i[(i >= 0) & (i + 1 < len(symbols))]
                rank[i], make[i] = self._pairs(symbols[i], symbols[i + 1])
                rank[i[run[i] != run[i + 1]]] = NEVER
            rank[at[at + 1 == len(symbols)]] = NEVER
        return left, np.concatenate(steps, axis=1) if steps else np.empty((4, 0), dtype=np.int64)

    def _trie(self) -> None:
        """The pieces' prefixes as nodes, with the steps from node to node and the piece that
        ends at a node; for BPE, only pieces that merging gives as a whole. And how each
        piece is merged: by step, the rank, and the first and last symbol before it."""
        n = len(self.names)
        spelled = [self.of_char[[ord(c) for c in p]] for p in self.names]
        whole = np.ones(n, dtype=bool)
        if self.bpe and n:
            left, (run, rank, head, tail) = self.merge_many(spelled)
            whole = left == 1
            order = np.argsort(run, kind="stable")
            run, rank, head, tail = run[order], rank[order], head[order], tail[order]
            first = np.searchsorted(run, np.arange(n))
            step = np.arange(len(run)) - first[run]
            self.rank_at = np.full((n + 1, self.longest), NEVER)
            self.head_at, self.tail_at = np.zeros((2, n, self.longest), dtype=np.int64)
            self.rank_at[run, step] = rank
            self.head_at[:, 0], self.tail_at[:, 0] = [x[0] for x in spelled], [x[-1] for x in spelled]
            self.head_at[run, step + 1], self.tail_at[run, step + 1] = head, tail
        nodes, keys, leads = {"": 0}, [], []
        for p in self.starts:
            nodes[p] = len(nodes)
        for p, i in nodes.items():
            if p:
                keys.append(nodes[p[:-1]] << 21 | ord(p[-1]))
                leads.append(i)
        self.steps = Table(len(keys))
        self.steps.add(np.array(keys, dtype=np.int64), np.array(leads, dtype=np.int64))
        self.ends = np.full(len(nodes), NOWHERE, dtype=np.int64)
        at = np.array([nodes[p] for p in self.names], dtype=np.int64)
        self.ends[at[whole]] = np.flatnonzero(whole)
        self.gain = np.array([0.0 if self.bpe else self.scores[p] for p in self.names])
        self.number = np.array([self.ids[p] for p in self.names], dtype="<i4")

    def candidates(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in runs laid end to end; stop: where the run of
        each place ends. A character that is no piece stands for itself."""
        at, node = np.arange(len(text)), np.zeros(len(text), dtype=np.int64)
        found, n = [], len(self.names)
        for size in range(1, self.longest + 1):
            step = self.steps.find(node << 21 | text[at + size - 1], NOWHERE)
            hit = step >= 0
            if size == 1:
                single = np.where(hit, self.ends[step], NOWHERE)
                found.append((at, at + 1, np.where(single >= 0, single, text + n)))
            at, node = at[hit], step[hit]
            if size > 1:
                piece = self.ends[node]
                some = piece >= 0
                found.append((at[some], at[some] + size, piece[some]))
            more = at + size < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves two pieces beside each other as they are; what is known of
        a pair is remembered."""
        keys = left << 32 | right
        known = self.apart.find(keys, -1)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.apart.held + len(new) > self.apart.room:
                self.apart = Table(max(MOST_CACHED, len(new)))
            found = self._apart(new >> 32, new & 0xFFFFFFFF)
            self.apart.add(new, found.astype(np.int64))
            open_ = known < 0
            known[open_] = found[np.searchsorted(new, keys[open_])]
        return known == 1

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges both pieces side by side, each as if alone, the lower rank first and the left
        one among equals, until a merge across their border would come first."""
        n = len(self.names)
        x, y = np.minimum(left, n), np.minimum(right, n)  # n: a character that is no piece
        i, j = np.zeros((2, len(left)), dtype=np.int64)
        live, out = np.arange(len(left)), np.zeros(len(left), dtype=bool)
        while len(live):
            a, b = x[live], y[live]
            tail = np.where(a < n, self.tail_at[np.minimum(a, n - 1), i[live]], left[live])
            head = np.where(b < n, self.head_at[np.minimum(b, n - 1), j[live]], right[live])
            across = self._pairs(tail, head)[0]
            own, other = self.rank_at[a, i[live]], self.rank_at[b, j[live]]
            joined = (across < own) & (across <= other) & (across < NEVER)
            done = (own == NEVER) & (other == NEVER)
            out[live[done & ~joined]] = True
            go = ~joined & ~done
            first = own[go] <= other[go]
            live = live[go]
            i[live[first]] += 1
            j[live[~first]] += 1
        return out

    def paths(self, runs: list[str]) -> list[bytes]:
        """The ids on the best path through each run: a max-plus scan from left to right, all
        runs side by side, one place of each at a time."""
        sizes = np.array([len(r) for r in runs])
        text = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        run = np.repeat(np.arange(len(runs)), sizes)
        first = np.cumsum(sizes) - sizes
        start, end, piece = self.candidates(text, (first + sizes)[run])
        owner = run[start]
        start, end = start - first[owner], end - first[owner]
        most, n = int(sizes.max()), len(self.names)
        # by end; the longer ones last, so that among equals they stay
        order = np.argsort(end * (most + 1) + most - start, kind="stable")
        start, end, piece, owner = start[order], end[order], piece[order], owner[order]
        weight = np.full((most + 1, len(runs)), -np.inf)
        last = np.full((most + 1, len(runs)), NOWHERE, dtype=np.int64)
        came = np.zeros((most + 1, len(runs)), dtype=np.int64)
        weight[0], last[0] = 0.0, START
        bounds = np.searchsorted(end, np.arange(1, most + 2))
        for place in range(1, most + 1):
            here = slice(bounds[place - 1], bounds[place])
            own, at, p = owner[here], start[here], piece[here]
            w = weight[at, own]
            if self.bpe:  # neighbours weigh 0, or minus infinity if merging changes them
                before = last[at, own]
                free = before == START
                pair = np.flatnonzero(before >= 0)
                free[pair] = self.stay_apart(before[pair], p[pair])
                own, at, p, w = own[free], at[free], p[free], w[free]
            else:
                w = w + np.where(p < n, self.gain[np.minimum(p, n - 1)], self.penalty)
                up = np.argsort(w, kind="stable")  # the heaviest is written last
                own, at, p, w = own[up], at[up], p[up], w[up]
            weight[place, own], last[place, own], came[place, own] = w, p, at
        rows, at, back = np.arange(len(runs)), sizes.copy(), []
        while len(rows):
            back.append((rows, last[at, rows]))
            at = came[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        owner, piece = (np.concatenate(x[::-1]) for x in zip(*back, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, piece = owner[order], piece[order]
        raw = self.number[np.minimum(piece, n - 1)].tobytes()
        stop = np.cumsum(np.bincount(owner, minlength=len(runs))) * 4
        out = [raw[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        for i in set(owner[piece >= n].tolist()):  # characters that are no piece become bytes
            out[i] = b"".join([self.number[x].tobytes() if x < n else self.numbers([chr(x - n)]) for x in piece[owner == i].tolist()])
        return out

    def learn(self, runs: set[str]) -> None:
        """Remembers the ids of new runs."""
        runs = runs.difference(self.cache)
        if len(self.cache) + len(runs) > MOST_CACHED:
            self.cache.clear()
        runs = sorted((r for r in runs if len(r) <= SIDE), key=len)
        at = 0
        while at < len(runs):
            many = max(1, min(8192, 65_536 // len(runs[at])))
            part = runs[at : at + many]
            self.cache.update(zip(part, self.paths(part), strict=True))
            at += many

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        parts = [self.run.findall(self.normal(t)) for t in texts]
        every = set().union(*parts)
        if len(self.cache) + len(every) > MOST_CACHED:
            self.cache.clear()
        self.learn(every)
        find = self.cache.__getitem__
        if any(len(r) > SIDE for r in every):
            find = self.of_run
        made = [b"".join(map(find, rs)) for rs in parts]
        ends = np.cumsum([0, *map(len, made)], dtype=np.int64) // 4
        return np.frombuffer(b"".join(made), dtype="<i4"), ends

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, ends = self.flat(texts)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _merged(self, text: str) -> list[str]:
        """The merges of BPE, best score first, leftmost first among equals."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        while len(parts) > 1:
            gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
            best = max(gains)
            if best == none:
                break
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, x: str, y: str) -> bool:
        return self._merged(x + y) == [x, y]

    def forward(self, text: str, start: int, first: str | None, end: int) -> list[dict]:
        """states[e][piece] = (weight, start of the piece, piece before) of the best path
        from `start`, after the piece `first`, whose last piece ends at e. Pieces begin
        before `end` and may reach beyond. Unigram paths meet in one state a place."""
        states: list[dict] = [{} for _ in range(len(text) + 1)]
        states[start][first] = (0.0, start, None)
        for at in range(start, end):
            here = states[at]
            if not here:
                continue
            if not self.bpe and len(here) > 1:  # only the best can be part of a best path
                top = max(here, key=lambda p: here[p][0])
                here = {top: here[top]}
            for stop in range(at + 1, min(at + self.longest, len(text)) + 1):
                piece = text[at:stop]
                known = piece in self.ids
                if not known and stop > at + 1:
                    if piece not in self.starts:
                        break
                    continue
                if self.bpe and known and not self.whole(piece):
                    continue
                gain = 0.0 if self.bpe else self.scores.get(piece, self.penalty)
                for last, (weight, _, _) in here.items():
                    if not self.bpe or last is None or self.stable(last, piece):
                        held = states[stop].get(piece)
                        if held is None or weight + gain > held[0]:
                            states[stop][piece] = (weight + gain, at, last)
        return states

    @staticmethod
    def back(states: list[dict], end: int, piece: str | None, start: int) -> list[str]:
        """The pieces of the path to (end, piece), without the one before `start`."""
        path = []
        while end > start:
            path.append(piece)
            _, end, piece = states[end][piece]
        return path[::-1]

    def _best(self, ends: dict) -> str | None:
        return max(ends, key=lambda p: ends[p][0])

    def segment(self, run: str) -> list[str]:
        """The best path through one run."""
        states = self.forward(run, 0, None, len(run))
        return self.back(states, len(run), self._best(states[len(run)]), 0)

    def numbers(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            if (known := self.ids.get(p)) is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<i4").tobytes()

    def of_run(self, run: str) -> bytes:
        return self.cache[run] if run in self.cache else self.numbers(self.segment(run))

    def normal(self, text: str | None) -> str:
        """Blanks as a mark, and one before the text."""
        text = (text or "").replace(" ", BLANK)
        return BLANK + text if text and self.prefix else text

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of texts whose ids stand one after another, and their borders."""
        sizes = self.out_size[ids]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        data = self.out_bytes[np.arange(stop[-1]) + np.repeat(self.out_start[ids] - stop[:-1], sizes)]
        ends = stop[ends]
        if self.prefix:  # the blank before a text
            first = ends[:-1][ends[:-1] < ends[1:]]
            first = first[data[first] == 32]
            data = np.delete(data, first)
            ends = ends - np.searchsorted(first, ends)
        return data, ends

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts; bytes that aren't UTF-8 become replacement characters."""
        data, ends = self.decode_flat(ids, ends)
        raw = data.tobytes()
        try:
            raw.decode()
            return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
        except UnicodeDecodeError:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_many(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0].as_py()

    # -- chunks: window is the text around a chunk, which is window[a:b] --

    def across(self, window: str, border: int) -> list[tuple[int, str]]:
        """(end, piece) of the pieces over the character before the border."""
        if border <= 0:
            return [(0, "")]
        found = []
        for start in range(max(0, border - self.longest), border):
            for end in range(border, min(start + self.longest, len(window)) + 1):
                piece = window[start:end]
                if piece in self.ids and (not self.bpe or self.whole(piece)) or len(piece) == 1:
                    found.append((end, piece))
        return found

    def inner(self, window: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and last border of runs within the chunk."""
        at = [m.start() for m in self.run.finditer(window)]
        at = [x for x in at if x > a and x < b and x > self.longest * (a > 0)]
        return (at[0], at[-1]) if at else None

    def _from(self, window: str, end: int, piece: str, stop: int):
        """forward() from an entering state; stop: where pieces no longer begin."""
        return self.forward(window, end, piece or None, stop)

    def matrix(self, window: str, a: int, b: int) -> dict[tuple[int, str], dict[tuple[int, str], float]]:
        """{entering state: {leaving state: weight}}; a state is (end beyond its border, piece)."""
        out_states = self.across(window, b)
        leave = lambda states: {(e - b, p): states[e][p][0] for e, p in out_states if p in states[e]}
        borders = self.inner(window, a, b)
        if borders:
            c, d = borders
            middle = 0.0
            if not self.bpe:
                for m in self.run.finditer(window, c, d):
                    states = self.forward(m[0], 0, None, len(m[0]))
                    middle += max(s[0] for s in states[-1].values())
            tail = leave(self.forward(window, d, None, b))
        out = {}
        for e, p in self.across(window, a):
            if e > b:  # the same piece reaches over the whole chunk
                out[e - a, p] = {(e - b, p): 0.0}
            elif borders:
                ends = self._from(window[:c], e, p, c)[c] if e <= c else {}
                if ends:
                    head = max(s[0] for s in ends.values())
                    out[e - a, p] = {k: head + middle + w for k, w in tail.items()}
            else:
                out[e - a, p] = leave(self._from(window, e, p, b)) | ({(0, p): 0.0} if e == b and a > 0 else {})
        return {k: v for k, v in out.items() if v}

    def trace(self, window: str, a: int, b: int, enter: tuple[int, str], leave: tuple[int, str]) -> bytes:
        """Ids of the chunk's pieces: those after the entering one, to the leaving one."""
        (x, p), (y, q) = enter, leave
        e, f = a + x, b + y
        if e >= f or e > b:
            return b""
        borders = self.inner(window, a, b)
        if not borders:
            return self.numbers(self.back(self._from(window, e, p, b), f, q, e))
        c, d = borders
        states = self._from(window[:c], e, p, c)
        head = self.back(states, c, self._best(states[c]), e) if c > e else []
        words = self.run.findall(window, c, d)
        self.learn(set(words))
        middle = b"".join([self.of_run(r) for r in words])
        return self.numbers(head) + middle + self.numbers(self.back(self.forward(window, d, None, b), f, q, d))


def compose(left: dict, right: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    out: dict = {}
    for i, row in left.items():
        best: dict = {}
        for k, w in row.items():
            for j, v in right.get(k, {}).items():
                if j not in best or w + v > best[j]:
                    best[j] = w + v
        if best:
            out[i] = best
    return out


def product(matrices: list[dict]) -> dict:
    """The matrix of several chunks in a row."""
    out = matrices[0]
    for m in matrices[1:]:
        out = compose(out, m)
    return out


def borders(matrices: list[dict], enter: tuple[int, str] | None = None, leave: tuple[int, str] | None = None) -> list[tuple[int, str]]:
    """The states at all borders of the best path from `enter` to `leave`; without them,
    of the whole text."""
    start = next(iter(matrices[0])) if enter is None else enter
    ahead = [{start: matrices[0][start]}]
    for m in matrices[1:]:
        ahead.append(compose(ahead[-1], m))
    if leave is None:
        last = {k: w for k, w in ahead[-1][start].items() if k[0] == 0}
        leave = max(last, key=last.get)
    states = [leave]
    for i in range(len(matrices) - 1, 0, -1):
        into = matrices[i]
        options = {k: w + into[k][states[-1]] for k, w in ahead[i - 1][start].items() if k in into and states[-1] in into[k]}
        states.append(max(options, key=options.get))
    return [start, *reversed(states)]


def _pack(matrix: dict) -> str:
    import json

    return json.dumps([[list(i), [[list(j), w] for j, w in row.items()]] for i, row in matrix.items()])


def _unpack(text: str) -> dict:
    import json

    return {tuple(i): {tuple(j): w for j, w in row} for i, row in json.loads(text)}


_OWN: list[tuple[str, Segmenter]] = []


def segmenter(model: dict) -> Segmenter:
    """The process's segmenter of a loaded model; one is kept, its memory is bounded."""
    name = model.get("name")
    if name is None:
        return Segmenter(model)
    if not _OWN or _OWN[0][0] != name:
        _OWN[:] = [(name, Segmenter(model))]
    return _OWN[0][1]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, keep: list[str], model: dict, chunk: int = CHUNK, giant: int = GIANT, check: bool = False) -> DataFrame:
    """docs' columns `keep` and ids, the pieces' numbers, for every row; with check also
    round_trip, whether decoding the ids gives the text again.

    Null and empty texts have no pieces; decoded, they are empty. Texts over `giant`
    characters are cut into chunks, which are spread over tasks; equal ones once.
    Repeated rows are encoded each, an empty table gives none. Columns of docs that are
    not in keep are not read, so their names can't clash; a kept column named ids or
    round_trip is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("ids", *["round_trip"] * check)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pc.fill_null(part.column("text"), "")
                ids, ends = own.flat(text.to_pylist())
                same = [pc.equal(own.decode_many(ids, ends), text)] if check else []
                yield pa.RecordBatch.from_arrays([part.column("doc"), _lists(ids, ends), *same], names=["doc", "ids", "round_trip"][: 2 + check])

    def windows(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = segmenter(shared.value)
        for part in parts:
            for key, text in zip(part["key"], part["text"], strict=True):
                text = own.normal(text)
                for no, at in enumerate(range(0, len(text), chunk)):
                    low, end = max(0, at - own.longest), min(at + chunk, len(text))
                    yield {"key": [key], "no": [no], "a": [at - low], "b": [end - low], "w": [text[low : end + own.longest]]}

    def matrices(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = segmenter(shared.value)
        for part in parts:
            yield {"key": part["key"], "no": part["no"], "m": [_pack(own.matrix(w, a, b)) for w, a, b in zip(part["w"], part["a"], part["b"], strict=True)]}

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        return pd.DataFrame({"key": rows["key"].iloc[:1], "no": rows["up"].iloc[:1], "m": [_pack(product([_unpack(m) for m in rows["m"]]))]})

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        x, p, y, q = rows[["x", "p", "y", "q"]].iloc[0]
        ends = ((int(x), p), (int(y), q)) if p is not None else (None, None)
        states = borders([_unpack(m) for m in rows["m"]], *ends)
        made = {"x": [s[0] for s in states[:-1]], "p": [s[1] for s in states[:-1]], "y": [s[0] for s in states[1:]], "q": [s[1] for s in states[1:]]}
        return pd.DataFrame({"key": rows["key"].to_numpy(), "no": rows["no"].to_numpy(), **made})

    def traced(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = segmenter(shared.value)
        for part in parts:
            rows = zip(*(part[c] for c in ("w", "a", "b", "x", "p", "y", "q")), strict=True)
            yield {"key": part["key"], "no": part["no"], "own": [np.frombuffer(own.trace(w, a, b, (x, p), (y, q)), "<i4") for w, a, b, x, p, y, q in rows]}

    long = F.coalesce(F.length("text") > giant, F.lit(False))
    struct = F.struct(*keep).alias("doc")
    kind = docs.select(struct).schema["doc"].dataType.simpleString()
    made = "ids array<int>" + ", round_trip boolean" * check
    short = docs.where(~long).select(struct, "text").mapInArrow(whole, f"doc {kind}, {made}")
    big = docs.where(long).select(struct, F.md5(F.col("text").cast("binary")).alias("key"), "text")
    cutup = map_rows(big.select("key", "text"), windows, "key string, no int, a int, b int, w string", step=8)
    cutup = cut(cutup.groupBy("key", "no").agg(*(F.first(c).alias(c) for c in "abw")))
    levels = [cut(map_rows(cutup, matrices, "key string, no int, m string", step=16))]
    most = levels[0].agg(F.max("no")).first()[0]
    if most is None:
        return short.select("doc.*", *short.columns[1:])
    parent = F.expr(f"no div {FAN}").cast("int")
    while most:
        levels.append(cut(levels[-1].withColumn("up", parent).groupBy("key", "up").applyInPandas(up, "key string, no int, m string")))
        most //= FAN
    none = [F.lit(None).cast(t).alias(c) for c, t in zip("xpyq", ("int", "string") * 2, strict=True)]
    states = levels[-1].withColumn("up", F.lit(0)).select("*", *none).groupBy("key", "up").applyInPandas(down, "key string, no int, x int, p string, y int, q string")
    for level in reversed(levels[:-1]):
        over = states.withColumnRenamed("no", "up")
        states = level.withColumn("up", parent).join(over, ["key", "up"]).groupBy("key", "up").applyInPandas(down, "key string, no int, x int, p string, y int, q string")
    parts = map_rows(cutup.join(states, ["key", "no"]), traced, "key string, no int, own array<int>", step=16)
    texts = parts.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "own"))), lambda x: x["own"])).alias("ids"))
    if check:
        texts = decode(texts, model).select("key", "ids", (F.md5(F.col("decoded").cast("binary")) == F.col("key")).alias("round_trip"))
    rows = short.union(big.select("doc", "key").join(texts, "key").select("doc", *texts.columns[1:]))
    return rows.select("doc.*", *rows.columns[1:])


def decode(rows: DataFrame, model: dict) -> DataFrame:
    """rows with `decoded`, the text of their ids; null ids give an empty text. A column of
    rows named decoded is replaced; repeated rows are decoded each."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column("ids")
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                text = own.decode_many(ids.flatten().to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rest)
    return rows.select(*rest, "ids").mapInArrow(run, f"{kinds}ids array<int>, decoded string")
