"""Structured Streaming forms of the sighting jobs, with the batch forms they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as O
from ..operators import store
from ..operators.shared import remove


def daily(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Sightings per day and network; with a watermark on a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sliding(stream: DataFrame, watermark: str, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sightings of a network in every `size` that starts at a multiple of `slide`. On a stream a
    window is given once, when the watermark has passed its end; rows behind it are late
    and dropped."""
    rows = stream.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("user_id", "event_type"), watermark: str | None = None) -> DataFrame:
    """Runs of a source's sightings with pauses under `gap`. Keys that tell sources apart keep
    tasks many. On a stream, with a watermark, a run is given once, when no row can join it
    any more."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    rows = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _manifest(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The version of each bucket after batch n: at most a row a bucket."""
    if n < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/n={n}").collect()}


def _buckets(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*(f"{path}/v={v}/bucket={b}" for b, v in sorted(versions.items())))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, latest: list[str], buckets: int = 64):
    """Folds each micro-batch into a snapshot that is laid out by hash of the key.

    Batch n rewrites only the buckets that its keys fall into, as version n of each, and
    then writes the manifest n, which names the version of every bucket; so what is written
    follows the batch, not the snapshot. A batch that is retried starts from the manifest
    before it and writes the same again. Versions that the manifest before the last one
    named and the last one doesn't are removed. Read the result with `snapshot`.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        names = [key, "impressions", "first_seen", "last_seen"]
        new = store.fold_sightings(batch, [key], "ts", latest).select(*names).persist()
        before = _manifest(spark, path, n - 1)
        touched = [r.bucket for r in new.select(bucket).distinct().collect()]
        old = {b: before[b] for b in touched if b in before}
        rows = store.merge_counts(_buckets(spark, path, old).select(*names), new, key) if old else new
        rows.select(*names, bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/v={n}")
        now = before | dict.fromkeys(touched, n)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n={n}")
        new.unpersist()
        if n > 1:
            for b, v in _manifest(spark, path, n - 2).items():
                if before.get(b) != v:
                    remove(spark, f"{path}/v={v}/bucket={b}")
            remove(spark, f"{path}/manifest/n={n - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest manifest under path."""
    last = spark.read.parquet(f"{path}/manifest").agg(F.max("n")).first()[0]
    return _buckets(spark, path, _manifest(spark, path, last)).drop("bucket", "v")


def dedupe_stream(stream: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """First sighting of a key within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def rules_at(rows: DataFrame, rules: DataFrame, on: str, key: str) -> DataFrame:
    """(key, entity): for each row the newest of the rules(on, entity, since) in force at its
    ts; rows without one are left out. Rules are broadcast after a count."""
    held = rows.select(key, "ts", on).join(O.bounded(rules.select(on, "entity", "since")), on).where(F.col("since") <= F.col("ts"))
    return held.groupBy(key).agg(F.max_by("entity", "since").alias("entity"))


def live_rules(stream: DataFrame, rules: str, on: str, key: str, out: str, checkpoint: str):
    """Matches each micro-batch with the rule table as it is then: the table at `rules` is
    listed anew for every batch, so rules that are added while the stream runs hold for
    the next one. Batch n is written to out/n=n, so a retried batch replaces itself."""

    def match(batch: DataFrame, n: int) -> None:
        found = rules_at(batch, batch.sparkSession.read.parquet(rules), on, key)
        found.write.mode("overwrite").parquet(f"{out}/n={n}")

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, delay: str, out: str, checkpoint: str):
    """Writes each micro-batch's rows with `late`: whether ts lies more than `delay` behind the
    newest ts of the batches before, which is the watermark. What late is false for goes
    on; the rest is the dead letter. Marks are kept beside the rows, one row a batch, so
    that a retried batch sees the same mark."""

    def split(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.parquet(f"{out}/marks").where(F.col("n") < n).agg(F.max("mark")).first()[0] if n else None
        mark = F.lit(marks).cast("timestamp")
        late = F.coalesce(F.col("ts") < mark - F.expr(f"interval {delay}"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{out}/rows/n={n}")
        batch.agg(F.max("ts").alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/n={n}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_stream(stream: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """A stream joined with a static rule table."""
    return stream.join(rules, on)


def _flips(events: DataFrame) -> DataFrame:
    """(user_id, event_type, on): whether a pair's toggles are odd. On a stream the counts are state
    that built-in aggregation keeps by key, without a call of Python for each pair."""
    return events.groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("on"))


def toggled(events: DataFrame) -> DataFrame:
    """(user_id, event_type) pairs with an odd number of toggles."""
    return _flips(events).where("on").drop("on")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def toggle_stream(stream: DataFrame, out: str, checkpoint: str):
    """Writes, for each micro-batch n, the pairs that it has toggled, and whether they are on then, to
    out/n=n, so that a retried batch replaces itself. State lies in the checkpoint and
    outlives the query. Read the result with `toggles_on`."""
    spark = stream.sparkSession
    rows = _flips(stream.select("user_id", "event_type"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n={n}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # state beside the heap; a query keeps what it starts with
    try:
        return rows.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def toggles_on(spark: SparkSession, out: str) -> DataFrame:
    """The pairs that are on after all batches so far."""
    last = spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.max_by("on", "n").alias("on"))
    return last.where("on").drop("on")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)
