"""Sharding by a permutation of global row numbers.

Rows get gapless numbers in an order that only their contents fix; a keyed Feistel
network with cycle walking permutes the numbers; shard and slot are remainder and
quotient of the permuted number. Both directions can be computed without a look-up:
`locate` names the row number at a shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand_copies, running_offsets

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**62, ROUNDS)]


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _forward(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & low
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & low)
    return (left << shift) | right


def _backward(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & low
    for key in reversed(keys):
        left, right = right ^ (_mixed(left, key) & low), left
    return (left << shift) | right


def _walked(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """step, again and again for the numbers that leave 0 to n - 1."""
    half, keys = _half(n), _keys(seed)
    y = step(x.astype(np.uint64), half, keys)
    while (out := y >= np.uint64(n)).any():
        y[out] = step(y[out], half, keys)
    return y.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of row number x in the shuffled order of n rows."""
    return _walked(_forward, x, n, seed)


def locate(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that stands at this shard and slot."""
    return int(_walked(_backward, np.array([slot * shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, order: list[str], buckets: int = 4096, seed: int = 11) -> DataFrame:
    """df's columns `order` with row_number from 0 and n_rows, for every row.

    Rows that agree in all of `order` take neighbouring numbers, so the set of
    numbers a value gets is the same in each run.
    """
    copies = df.groupBy(*order).agg(F.count("*").alias("_copies"))
    placed = running_offsets(copies, [], order, "_copies", buckets, seed)
    return (
        expand_copies(placed, "_copies", "_copy")
        .withColumn("row_number", F.col("before") + F.col("_copy"))
        .withColumnRenamed("total", "n_rows")
        .drop("before", "_copy", "_copies")
    )


def shard(df: DataFrame, order: list[str], shards: int = 8, seed: int = 7) -> DataFrame:
    """df's columns `order` with shard and slot: the law `rows`, shard sizes at most
    one apart and slots gapless from 0. Nulls are values like others, repeated rows
    take a slot each, an empty table gives none."""

    @F.pandas_udf("long")
    def place(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), int(n.iloc[0]), seed) if len(x) else [], dtype="int64")

    return (
        number_rows(df, order)
        .withColumn("_place", place("row_number", "n_rows"))
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place", "n_rows")
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """Documents with their shard and slot; null text: no bytes, checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
