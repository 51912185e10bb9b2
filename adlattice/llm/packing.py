"""Cost-balanced packing of token sequences.

A piece of l tokens costs 6 * hidden * l, its share of the linear layers, plus l * l for
attention within it. Pieces go, longest first, to the sequence of the lowest cost so far
that has room for them. Where none has, the piece is cut at the room of the emptiest one
and its rest goes on.

Sequences are planned to be filled exactly: as many as hold `size` tokens, and for what is
left sequences of powers of two, which need no padding either. Documents over `size` tokens
are first cut at its multiples.

Pieces are dealt to buckets by a hash, about BUCKET tokens each; the number of buckets
follows the bytes of the texts. A bucket is packed on its own, so the whole set is never
sorted or held by one task, and a task holds at most MOST tokens, four bytes or less each.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("word_bpe_49k.json")
END = 2
SIZE, HIDDEN = 4096, 1024
BUCKET, MOST = 1 << 23, 1 << 25
TOGETHER = 1 << 22  # bytes of texts that are encoded together
PIECE = 1 << 20  # characters of a text that are encoded at a time
CACHE, LONG = 500_000, 64  # pieces that are kept with their ids, and their longest

#: Characters that normalization only lower-cases, and the pre-tokenizer's patterns for them.
PLAIN = re.compile(r"[\n\t\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u2013\u2014\u2018\u2019\u201C\u201D\u2026]*\Z")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\n\t\x20a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")

_OWN: list = []  # the process's encoder


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Encoder:
    """The ids of texts as bytes.

    The pre-tokenizer drops white space, and none of its patterns reaches over it, so chunks
    between blanks can be encoded one by one. Text of plain Latin characters, which
    normalization only lower-cases, is cut by the same patterns here; distinct chunks are
    looked up, and the tokenizer's model sees only new words. All other chunks, and those
    with special tokens, go through the whole tokenizer.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = model
        self.own = Tokenizer.from_str(model)
        self.words = self.own.model
        small = self.own.get_vocab_size() <= 1 << 16
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.known: dict[str, bytes] = {}

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONG:
            self.known[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return self._keep(word, array(self.code, [t.id for t in self.words.tokenize(letters)]).tobytes())

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk without blanks; a plain one is in lower case."""
        if (ids := self.known.get(chunk)) is not None:
            return ids
        if not PLAIN.match(chunk) or "<|" in chunk:
            return self._keep(chunk, array(self.code, self.own.encode(chunk, add_special_tokens=False).ids).tobytes())
        parts = PIECES.findall(chunk)
        if len(parts) == 1:
            return self._word(chunk)
        known = self.known
        return self._keep(chunk, b"".join([known[p] if p in known else self._word(p) for p in parts]))

    def _ids(self, part: str) -> bytes:
        if PLAIN.match(part) and "<|" not in part:
            return b"".join(map(self._chunk, part.lower().split()))
        return b"".join([self._chunk(c.lower() if PLAIN.match(c) and "<|" not in c else c) for c in part.split(" ")])

    def ids(self, text: str) -> bytes:
        out = []
        at = 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end
            out.append(self._ids(text[at:end].replace("\n", " ").replace("\t", " ")))
            at = end
        return b"".join(out)

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; the distinct chunks of plain ones are looked up once."""
        if len(self.known) > CACHE:
            self.known.clear()
        plain = [i for i, x in enumerate(texts) if len(x) <= PIECE and PLAIN.match(x) and "<|" not in x]
        made = {}
        if plain:
            chunks = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
            coded = chunks.flatten().dictionary_encode()
            known = self.known
            own = [known.get(c) or self._chunk(c) for c in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
            pool, begin = np.frombuffer(b"".join(own), self.kind), np.cumsum(sizes) - sizes
            at = coded.indices.to_numpy()
            n = sizes[at]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pool[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])]
            bounds = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
            made = {i: ids[a:b].tobytes() for i, a, b in zip(plain, bounds, bounds[1:], strict=False)}
        return [made[i] if i in made else self.ids(x) for i, x in enumerate(texts)]


def encoder(model: str) -> Encoder:
    if not _OWN or _OWN[0].model != model:
        _OWN[:] = [Encoder(model)]
    return _OWN[0]


def cost(length: int, hidden: int = HIDDEN) -> int:
    return 6 * hidden * length + length * length


class Sequences:
    """Open sequences by their room: a heap by cost for each room, and a tree of the least
    of these heaps."""

    def __init__(self, capacities: list[int]):
        self.capacities = capacities
        self.room = list(capacities)
        self.width = 1 << max(1, max(capacities, default=1).bit_length())
        self.heaps: dict[int, list[tuple[int, int]]] = {}
        self.tree: list = [None] * (2 * self.width)
        for i, c in enumerate(capacities):
            self.heaps.setdefault(c, []).append((0, i))
        for c, heap in self.heaps.items():
            heapq.heapify(heap)
            self._least(c)

    def _least(self, room: int) -> None:
        heap = self.heaps.get(room)
        tree, node = self.tree, self.width + room
        tree[node] = heap[0] if heap else None
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if b is None or (a is not None and a <= b) else b

    def cheapest(self, length: int) -> int | None:
        """The sequence of the least cost with room for length."""
        tree, node = self.tree, self.width + length
        if node >= 2 * self.width:
            return None
        best = tree[node]
        while node > 1:
            if not node & 1 and (other := tree[node + 1]) is not None and (best is None or other < best):
                best = other
            node >>= 1
        return None if best is None else best[1]

    def emptiest(self) -> int:
        """The cheapest of the sequences with the most room."""
        node = 1
        while node < self.width:
            node = 2 * node + (self.tree[2 * node + 1] is not None)
        return self.tree[node][1]

    def put(self, sequence: int, length: int, price: int) -> int:
        """Fill length tokens of the sequence, which is its room's cheapest; the offset."""
        room = self.room[sequence]
        spent, _ = heapq.heappop(self.heaps[room])
        self._least(room)
        left = self.room[sequence] = room - length
        if left:
            heapq.heappush(self.heaps.setdefault(left, []), (spent + price, sequence))
            self._least(left)
        return self.capacities[sequence] - room


def capacities(total: int, size: int) -> list[int]:
    """Lengths of sequences that hold total tokens without padding."""
    full, rest = divmod(total, size)
    return [size] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def packed(lengths: list[int], size: int = SIZE, hidden: int = HIDDEN) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (index, start, length, sequence, offset) of lengths in descending order, none over
    size; and the number of sequences."""
    room = Sequences(capacities(sum(lengths), size))
    out = []
    for i, length in enumerate(lengths):
        start = 0
        while start < length:
            take = length - start
            to = room.cheapest(take)
            if to is None:
                to = room.emptiest()
                take = room.room[to]
            out.append((i, start, take, to, room.put(to, take, cost(take, hidden))))
            start += take
    return out, len(room.capacities)


def pack(docs: DataFrame, path: str = MODEL, size: int = SIZE, hidden: int = HIDDEN, end: int = END, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, cost) of each piece.

    ids are the piece's, 32 bits each, little-endian; start counts its document's ids before
    it, offset the sequence's. Sequences are full or filled to a power of two. sequence_id
    holds the bucket in its upper 32 bits and counts within it. Null and empty texts are
    their end alone. Repeated rows are packed each; which of them a piece is of can't be
    told and doesn't matter. Very long texts are encoded in pieces and cut before they are
    dealt. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(1, ((total or 0) // 3 + rows) // bucket)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        last = np.array([end], own.kind).tobytes()
        wide = own.kind.itemsize
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            groups = np.flatnonzero(np.diff(sizes // TOGETHER, prepend=-1))  # rows that start a group
            for at, stop in zip(groups, [*groups[1:], batch.num_rows], strict=True):
                part = batch.slice(at, stop - at)
                row, start, ids, tokens = [], [], [], []
                for i, made in enumerate(own.many([x or "" for x in part.column(1).to_pylist()])):
                    made += last
                    for cut in range(0, len(made), size * wide):
                        row.append(i)
                        start.append(cut // wide)
                        ids.append(made[cut : cut + size * wide])
                        tokens.append(len(made) // wide)
                same = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [same.column(0), same.column(2), pa.array(start, pa.int64()), pa.array([len(x) // wide for x in ids], pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "key", "start", "length", "doc_tokens", "ids"],
                )

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.dtype(encoder(model.value).kind)
        held: list[list] = [[] for _ in range(5)]
        here, tokens, first = None, 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal first
            ids_of, starts, totals = held[0], held[1], held[3]
            pieces, n = packed(held[2], size, hidden)
            for at in range(0, len(pieces), 1024):
                index, begin, length, sequence, offset = zip(*pieces[at : at + 1024], strict=True)
                wide = own.itemsize
                ids = [np.frombuffer(held[4][i][a * wide : (a + m) * wide], own).astype("<u4").tobytes() for i, a, m in zip(index, begin, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids_of[i] for i in index], batch.schema.field(1).type), pa.array([starts[i] + a for i, a in zip(index, begin, strict=True)]), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([totals[i] for i in index]),
                        pa.array([(here << 32) + first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()), pa.array([cost(m, hidden) for m in length], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"],
                )
            first += n
            for column in held:
                column.clear()

        batch = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for b, *row in zip(*columns, strict=True):
                if b != here or tokens >= MOST:
                    if tokens:
                        yield from done()
                    first = first if b == here else 0
                    here, tokens = b, 0
                tokens += row[2]
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if tokens:
            yield from done()

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    made = keyed.mapInArrow(encode, f"doc_id {kind}, key long, start long, length long, doc_tokens long, ids binary")
    made = made.withColumn("bucket", F.pmod(F.xxhash64("key", "start"), F.lit(buckets)))
    dealt = made.repartition("bucket").sortWithinPartitions("bucket", F.desc("length"), "key", "start")
    dealt = dealt.select("bucket", "doc_id", "start", "length", "doc_tokens", "ids")
    return dealt.mapInArrow(arrange, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost long")
