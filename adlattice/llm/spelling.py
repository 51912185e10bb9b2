"""Spelling variants of words by blocked Gram matrices.

A word is a vector of letter counts. Two words that differ by one inserted or deleted
letter have squared distance 1, by one replaced letter 2, so pairs at most two apart are
candidates; their edits are then verified. Squared distances come from products of
blocks of these vectors, of words of one length and the next.

Words that are one edit apart agree in the first half of the shorter length or in the
rest of it, so a block holds the words of two adjacent lengths that agree in one of
these; words that share neither never meet. Blocks over `tile` words are dealt to tiles,
a product each, so no task holds a whole large block. A pair that agrees in both halves
is taken from the block of first halves only.

Words are held as Latin-1 bytes: one for each letter, in code-point order.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows, word_lists

LEAST_CHARS, LEAST_COUNT = 7, 2
FACTOR = 10  # a form is at least so many times as frequent
DELETES = 31
TILE = 2048
HELD = 400_000  # words that a task counts before it hands them on

_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Letters stay, A-Z in lower case; anything else separates words.
_TABLE = bytes(b if b in set(_LETTERS) else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))


def variant(doc: bytes, run: bytes) -> bytes:
    """The run as it counts in a document: without one letter where the checksum says so."""
    h = zlib.crc32(doc + b":" + (run if run.isascii() else run.decode("latin-1").encode()))
    if h % DELETES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) for the words of all texts, as Latin-1 bytes."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: Counter = Counter()
        for part in parts:
            for doc, text in zip(part["doc"], part["text"], strict=True):
                raw, doc = (text or "").encode("latin-1", "replace"), doc.encode()
                for words in word_lists(raw, _TABLE):
                    for word, n in Counter(w for w in words if len(w) >= LEAST_CHARS).items():
                        held[variant(doc, word)] += n
                if len(held) > HELD:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        yield {"word": list(held), "n": list(held.values())}

    rows = map_rows(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text"), run, "word binary, n long")
    rows = rows.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= LEAST_COUNT)


def _vectors(words: list[bytes], exact: type) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    rows = np.repeat(np.arange(len(words)) * len(_LETTERS), lengths)
    return np.bincount(rows + letters, minlength=len(words) * len(_LETTERS)).reshape(len(words), -1).astype(exact)


def _letters(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words[at]), np.uint8).reshape(len(at), width)


def one_edit(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether words[a], of `size` letters, and words[b], of as many or one more, are one edit
    apart."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), step := max(1, (1 << 22) // (size + 1))):
        x, y = _letters(words, a[at : at + step], size + 1), _letters(words, b[at : at + step], size + 1)
        longer = y[:, size] != 0
        same = x[:, :size] == y[:, :size]
        head = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((x[:, :size] == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        out[at : at + step] = np.where(longer, head + tail >= size, same.sum(axis=1) == size - 1)
    return out


def near_in_block(words: np.ndarray, parts: np.ndarray, size: int, first: bool, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs in a block that are one edit apart, once each; with across only
    those of different parts, without first only those that differ in the first half."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    low = np.flatnonzero(lengths == size)
    if not len(low) or len(words) < 2:
        return low[:0], low[:0]
    # sums of squares of counts are whole numbers, exact in float32 up to 2 ** 24
    vectors = _vectors(list(words), np.float32 if size < 2000 else np.float64)
    squares = (vectors * vectors).sum(axis=1)
    halves: dict[bytes, int] = {}
    half = np.fromiter((halves.setdefault(w[: size // 2], len(halves)) for w in words), np.int64, len(words))
    found = []
    for at in range(0, len(low), 512):
        rows = low[at : at + 512]
        apart = squares[rows, None] + squares[None, :] - 2 * (vectors[rows] @ vectors.T)
        i, b = np.nonzero(apart <= 2)
        a = rows[i]
        keep = (lengths[b] > size) | (a < b)
        if across:
            keep &= parts[a] != parts[b]
        if not first:
            keep &= half[a] != half[b]
        a, b = a[keep], b[keep]
        good = one_edit(words, a, b, size)
        found.append((a[good], b[good]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_words(counts: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) for all words one edit apart, both ways."""
    size = F.length("word")
    half = F.expr("length(word) div 2")
    less = F.expr("(length(word) - 1) div 2")
    part = lambda low, first, piece: F.struct(low.alias("low"), F.lit(first).alias("first"), piece.alias("piece"))
    pieces = [
        part(size, True, F.substring("word", F.lit(1), half)),
        part(size, False, F.substring("word", half + 1, size)),
        part(size - 1, True, F.substring("word", F.lit(1), less)),
        part(size - 1, False, F.substring("word", less + 2, size)),
    ]
    keys = ["low", "first", "piece"]
    dealt = counts.select("word", "n", F.inline(F.array(*pieces)))
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("size"))
    large = bounded(cut(sizes.where(F.col("size") > tile).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).drop("size")))
    dealt = dealt.join(large, keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    block = [*keys, "x", "y"]
    dealt = dealt.select("word", "n", *keys, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part")
    dealt = dealt.repartition(*block).sortWithinPartitions(*block, "word")

    def pairs(block: tuple, rows: tuple[list, list, list]) -> pa.RecordBatch | None:
        words, n, parts = np.array([*rows[0], None], dtype=object)[:-1], np.array(rows[1]), np.array(rows[2])
        a, b = near_in_block(words, parts, block[0], block[1], block[3] != block[4])
        if not len(a):
            return None
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays([pa.array(words[a], pa.binary()), pa.array(words[b], pa.binary()), pa.array(n[b])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, ([], [], [])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            now = list(zip(*columns[3:], strict=True))
            starts = [0, *(i for i in range(1, len(now)) if now[i] != now[i - 1]), len(now)]
            for at, end in zip(starts, starts[1:], strict=False):
                if now[at] != open_:
                    if len(rows[0]) > 1 and (made := pairs(open_, rows)):
                        yield made
                    open_, rows = now[at], ([], [], [])
                for mine, column in zip(rows, columns, strict=False):
                    mine += column[at:end]
        if len(rows[0]) > 1 and (made := pairs(open_, rows)):
            yield made

    return dealt.select("word", "n", "part", *block).mapInArrow(run, "word binary, near binary, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): where following the forms ends. Each form is FACTOR times as frequent,
    so at most log(most) links follow each other; each round doubles what a link spans."""
    to = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, math.log(max(1, most), FACTOR) + 1)))):
        ahead = to.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        to = cut(to.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")))
    return to


def group(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least LEAST_CHARS letters that
    occurs LEAST_COUNT times.

    form is the most frequent word one edit apart, of those the smallest, where it is
    FACTOR times as frequent; root is where forms lead to. A null text has no words, a null
    doc_id is an empty string in the checksum. Repeated rows count each; an empty table
    gives no rows; words and texts may be of any length. Columns other than doc_id and text
    are not read.
    """
    counts = cut(word_counts(docs))
    best = near_words(counts, tile).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = counts.join(best, "word", "left")
    good = -F.col("best.less") >= F.col("n") * FACTOR
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    most = rows.agg(F.max("n")).first()[0] or 0
    ends = roots(rows.where("form IS NOT NULL"), most)
    text = lambda c: F.decode(c, "ISO-8859-1")
    rows = rows.join(ends, "word", "left")
    return rows.select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
