"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder; keep one that is set. Without one, a
    folder in the warehouse will do on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Number of runs of other than white space; null: none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


#: Bytes of a text whose words are in memory at a time.
PIECE = 1 << 20

#: Rows that a broadcast may hold; these are keys and numbers.
MOST_BROADCAST = 200_000


def word_lists(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces, where table turns bytes between words into spaces."""
    raw = raw.translate(table)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def bounded(df: DataFrame) -> DataFrame:
    """df, a cut table of narrow rows, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, step: int = 256
) -> DataFrame:
    """mapInArrow over dicts of columns, step rows at a time, so that long texts
    are never Python objects in large numbers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in rows(pieces(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def running_offsets(df: DataFrame, group: list[str], order: list[str], weight: str, buckets: int, seed: int) -> DataFrame:
    """df with `before`, the sum of weight over the rows of its group that stand
    before the row in a pseudo-random but reproducible order, and `total`, the
    group's sum.

    A group is dealt to `buckets` hash buckets, so no task holds a whole group; the
    sums before each bucket come from one row a group and bucket. Rows that agree in
    `order` should be summed up beforehand.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_hash", F.xxhash64(*order, F.lit(seed))).withColumn(
        "_bucket", F.pmod(F.shiftright("_hash", 17), F.lit(buckets))
    )
    inside = Window.partitionBy(*keys).orderBy("_hash", *order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = (
        dealt.groupBy(*keys)
        .agg(F.sum(weight).alias("_sum"))
        .select(
            *(F.col(k).alias(f"_{k}") for k in keys),
            F.coalesce(
                F.sum("_sum").over(across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_start"),
            F.sum("_sum").over(across).alias("total"),
        )
    )
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        dealt.withColumn("_inside", F.sum(weight).over(inside) - F.col(weight))
        .join(sums, match)
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .drop("_hash", "_bucket", "_inside", "_start", *(f"_{k}" for k in keys))
    )


def expand_copies(df: DataFrame, copies: str, index: str, block: int = 10_000) -> DataFrame:
    """One row for each of `copies` copies, numbered from 0 in `index`; in two steps,
    so that no array is longer than the root of what a group holds."""
    top = F.expr(f"explode(sequence(0L, ({copies} - 1) div {block}))")
    low = F.expr(f"explode(sequence(_block * {block}L, least((_block + 1) * {block}L, {copies}) - 1))")
    return df.withColumn("_block", top).withColumn(index, low).drop("_block")
