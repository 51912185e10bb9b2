"""Removing lines that many documents share.

Two Bloom filters hold the hashes of lines seen in one and in two documents. Only
lines that the second filter may hold, the suspects, are shuffled, by a 128-bit
digest of the whole key, which gives the exact number of documents and the one that
keeps the line.

The filters' size follows the number of lines, up to what can be broadcast (MOST_BITS
each). Beyond that they fill up: more lines are suspects and are shuffled, at 24 bytes
each, and the result stays the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

LEAST_CHARS = 40
LEAST_DOCS = 5
SEGMENT = 1 << 16
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
BITS_PER_LINE = 16
FLUSH = 1 << 20  # cells that a task holds besides its filters
#: Confirmed lines up to this number are broadcast (24 bytes each); beyond, they are joined.
MOST_BROADCAST = 200_000
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _digest(line: str) -> bytes | None:
    """Of the line's key, if that is long enough."""
    key = line.strip(_STRIP)
    if len(key) < LEAST_CHARS:
        return None
    return blake2b(key.encode("utf-8", "surrogatepass").translate(_LOWER), digest_size=16).digest()


def _digests(text: str | None) -> set[bytes]:
    """Of the keys in one document."""
    return {d for line in (text or "").split("\n") if len(line) >= LEAST_CHARS and (d := _digest(line))}


def _bits(digests: list[bytes], n_bits: int) -> np.ndarray:
    """Two places in the filter for each digest."""
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return (halves & np.uint64(n_bits - 1)).astype(np.int64)


def _seen(n_bits: int):
    """The cells that a task's documents set once and twice, by segment. A task holds sorted
    cells only, no digests; a cell that two lines share counts as seen twice."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        ones, twos, new = np.empty(0, np.int64), np.empty(0, np.int64), []

        def flush() -> None:
            nonlocal ones, twos, new
            cells, n = np.unique(np.concatenate([ones, *new]), return_counts=True)
            ones, twos, new = cells, np.union1d(twos, cells[n > 1]), []

        for part in parts:
            for text in part["text"]:
                if own := _digests(text):
                    new.append(np.unique(_bits(list(own), n_bits)))
            if sum(map(len, new)) > FLUSH:
                flush()
        if new:
            flush()
        segments = np.unique(ones // SEGMENT)
        cells = lambda a, s: zlib.compress((a[np.searchsorted(a, s * SEGMENT) : np.searchsorted(a, (s + 1) * SEGMENT)] % SEGMENT).astype("<u2").tobytes(), 1)
        for at in range(0, len(segments), 256):
            some = segments[at : at + 256]
            yield {"segment": some.tolist(), "once": [cells(ones, s) for s in some], "twice": [cells(twos, s) for s in some]}

    return run


def _merged(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """For each segment, the cells seen twice in a task or by two tasks."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in parts:
        for segment, once, twice in zip(part["segment"], part["once"], part["twice"], strict=True):
            one, two = state.setdefault(segment, (np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)))
            cells = np.frombuffer(zlib.decompress(once), "<u2")
            two[cells[one[cells]]] = True
            one[cells] = True
            two[np.frombuffer(zlib.decompress(twice), "<u2")] = True
    for segment, (_, two) in state.items():
        yield {"segment": [segment], "bits": [np.packbits(two).tobytes()]}


def twice_filter(docs: DataFrame, n_bits: int) -> np.ndarray:
    """The bits of the filter of lines seen in two documents; n_bits / 8 bytes at most."""
    seen = map_rows(docs.select("text"), _seen(n_bits), "segment long, once binary, twice binary")
    merged = map_rows(seen.repartition("segment"), _merged, "segment long, bits binary")
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def filter_bits(n_lines: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n_lines * BITS_PER_LINE) - 1).bit_length()))


def n_lines(docs: DataFrame) -> int:
    """Lines of all texts that may be long enough to count."""
    return docs.agg(F.sum(F.least(F.length("text") / LEAST_CHARS, 1 + F.length("text") - F.length(F.translate("text", "\n", ""))))).first()[0] or 0


def suspects(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, key) for each document's distinct keys that the filter may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    n_bits = len(bits) * 8

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held = shared.value
        for part in parts:
            ids, keys = [], []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                own = _digests(text)
                ids += [doc_id] * len(own)
                keys += own
            if keys:
                at = _bits(keys, n_bits)
                hit = ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                found = np.flatnonzero(hit)
                yield {"doc_id": [ids[i] for i in found], "key": [keys[i] for i in found]}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary")


def _rewritten(text: str | None, drop: set[bytes]) -> tuple[int, list[str]]:
    lines = (text or "").split("\n")
    if not drop:
        return len(lines), lines
    return len(lines), [x for x in lines if len(x) < LEAST_CHARS or _digest(x) not in drop]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(docs' other columns as struct `doc`, n_lines, n_dropped, kept_text) for every row.

    A line whose key is found in at least LEAST_DOCS rows stays only in rows with the
    largest doc_id that holds it; null is smaller than any doc_id. Null and empty
    texts are one empty line; whole texts are read, of any length. Equal rows count each,
    and stay or lose lines alike. An empty table gives none. Names of docs' columns can't clash.
    """
    spark = docs.sparkSession
    bits = twice_filter(docs, filter_bits(int(n_lines(docs))))
    found = suspects(docs, bits)
    shared = cut(
        found.groupBy("key").agg(F.count("*").alias("_n"), F.max("doc_id").alias("keeper")).where(F.col("_n") >= LEAST_DOCS)
    ).drop("_n")
    if shared.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        keepers = spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in shared.collect()})
        drops = None
    else:
        keepers = None
        drops = (
            found.join(shared, "key")
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("_d"))
            .agg(F.collect_set("key").alias("drop"))
        )
    return _apply(docs, keepers, drops)


def _apply(docs: DataFrame, keepers, drops: DataFrame | None) -> DataFrame:
    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        known = keepers.value if keepers else {}
        for part in parts:
            out: dict[str, list] = {"doc": part["doc"], "n_lines": [], "n_dropped": [], "kept_text": []}
            for i, text in enumerate(part["text"]):
                if keepers:
                    own = part["doc_id"][i]
                    drop = {k for k in _digests(text) if k in known and known[k] != own} if known else set()
                else:
                    drop = set(part["drop"][i] or ())
                n, kept = _rewritten(text, drop)
                out["n_lines"].append(n)
                out["n_dropped"].append(n - len(kept))
                out["kept_text"].append("\n".join(kept))
            yield out

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc"), "doc_id", "text")
    if drops is not None:
        rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    kind = rows.schema["doc"].dataType.simpleString()
    return map_rows(rows, run, f"doc {kind}, n_lines long, n_dropped long, kept_text string")


def documents(docs: DataFrame) -> DataFrame:
    """docs with the kept text; n_chars, if there, follows it. A null text becomes empty;
    repeated rows stay repeated; other columns pass, whatever their names."""
    out = dedup_lines(docs)

    def column(name: str):
        if name == "text":
            return F.col("kept_text").alias("text")
        if name == "n_chars":
            return F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("doc")[name].alias(name)

    return out.select(*(column(c) for c in docs.columns))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
x AS (SELECT k.*, s.key IS NOT NULL AND s.keeper IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
