"""Mixing sources to target weights along a curriculum.

Each source has a target number of words and a weight schedule over training time t
in 0..1: its rate is target * (1 + slope * (2t - 1)). The integral of the rate is the
source's cumulative demand; inverting it turns a document's offset within its
source's word stream into a training position, by which documents are range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, expand_copies, n_words, running_offsets

WEIGHTS = (5, 2, 1)
#: Slopes of the schedules by weight: heavy sources recede, light ones come late.
SLOPES = (-0.3, 0.3, 0.6)
MOST_EPOCHS = 3


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with `target`, `slope`: the water level at which the
    weighted shares, each stopped at `most` times its source, add up to all sizes.

    One row a source, sources ranked by code point with null last. With sources in
    order of cap / weight, the first k are stopped; the level over the rest follows
    from running sums, and k is the first for which no further source overflows.
    """
    everyone = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.col("_rank") % len(values) + 1).cast("int"))
    by_cap = everyone.orderBy("_ratio", "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("_rank", rank)
    return (
        ranked.withColumn("_w", pick(weights))
        .withColumn("slope", pick(slopes))
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        # the level holds from the first source, the tightest still open, that stays below its cap
        .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everyone)["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_water") * F.col("_w")), F.col("_cap")))
        .select("source", "source_size", "target", "slope")
    )


def demand_inverse(share: Column, slope: Column) -> Column:
    """t with t + slope * (t^2 - t) = share, for share in 0..1."""
    b = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, share).otherwise(F.lit(2.0) * share / (b + root))


def assign(docs: DataFrame, buckets: int = 1024, seed: int = 23) -> DataFrame:
    """Every document with size, source_size, target, taken and position.

    A source's documents stand in a hashed order and are read in passes until the
    target is met; the document at the end of the last pass is cut, so a source's
    taken words add up to its rounded target. position is the first copy's training
    time in 0..1, or 1 + its offset for documents that aren't taken. Null texts have
    no words; null sources are a source of their own; repeated rows count each; texts may be
    of any length. An empty table gives no rows. Other columns don't matter. Rows come range-sorted by position.
    """
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    same = narrow.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_copies"))
    same = same.withColumn("_weight", F.col("_copies") * F.col("size"))
    sizes = same.groupBy("source").agg(F.sum("_weight").alias("source_size"))
    aims = targets(sizes).withColumnRenamed("source", "_source")
    placed = running_offsets(same, ["source"], ["doc_id", "size"], "_weight", buckets, seed).drop("total")
    rows = expand_copies(placed, "_copies", "_copy").withColumn("start", F.col("before") + F.col("_copy") * F.col("size"))
    rows = rows.drop("before", "_copies", "_copy", "_weight")
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.round("target").cast("long")
    of_pass = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), whole - F.lit(e) * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("passes", F.array(*(of_pass(e) for e in range(MOST_EPOCHS))))
    rows = rows.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.withColumn("position", position(F.lit(0))).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def position(epoch: Column) -> Column:
    """The training time of a document's copy in pass `epoch`."""
    offset = F.col("start") + epoch * F.col("source_size")
    share = F.least(offset / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    rest = F.col("start") / F.greatest(F.col("source_size"), F.lit(1))
    return F.when(F.get(F.col("passes"), epoch) > 0, demand_inverse(share, F.col("slope"))).otherwise(F.lit(1.0) + rest)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, a row for each pass that takes the document,
    range-sorted by training position. The last copy of a source may be cut to its
    leading words, joined by blanks; n_chars, if there, follows the text.

    Documents without words are in no pass and go; a null source is one of its own; an
    empty table stays so. Rows that repeat doc_id, source and size take the plans of
    these one each, in the order of their hashes. Names of docs' columns can't clash.
    """
    keys = ["doc_id", "source", "size"]
    copies = assign(docs).select("*", F.posexplode("passes").alias("epoch", "words")).where("words > 0")
    copies = copies.select(*(F.col(k).alias(f"of_{k}") for k in keys), "epoch", "words", position(F.col("epoch")).alias("place"), "start")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():  # number the rows of a key on both sides
        copies = copies.withColumn("of_nth", F.row_number().over(Window.partitionBy(*(f"of_{k}" for k in keys), "epoch").orderBy("start")))
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.to_json("row")))))
        match &= F.col("nth") == F.col("of_nth")
    rows = rows.join(copies, match).select("row", "doc_id", "place", "words", "size")
    text = F.col("row.text")
    head = F.array_join(F.slice(F.array_remove(F.split(text, SPACE + "+"), ""), 1, F.greatest(F.col("words").cast("int"), F.lit(1))), " ")
    rows = rows.withColumn("cut_text", F.when(F.col("words") < F.col("size"), head).otherwise(text))
    rows = rows.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")

    def column(name: str) -> Column:
        if name == "text":
            return F.col("cut_text").alias("text")
        if name == "n_chars":
            return F.length("cut_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("row")[name].alias(name)

    return rows.select(*(column(c) for c in docs.columns))
