"""The ad store: keyed snapshots, patches, upserts, repairs and change sets. A job
returns the new snapshot or the rows to write; parquet has no update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key, numbered in rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def patch(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with the non-null fields of new by key; other rows stay."""
    side = new.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    rows = old.join(side, F.col(key) == F.col("_k"), "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key."""
    return first_per(old.unionByName(new), keys, F.desc(version))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key old doesn't have."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def conform(df: DataFrame, schema: StructType) -> tuple[DataFrame, list[str]]:
    """df in the target schema, missing columns null, and the columns that were rejected."""
    known = {f.name for f in schema}
    made = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*made), [c for c in df.columns if c not in known]


def split_rejects(df: DataFrame, reason: Column, key: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the log rows of the others."""
    rows = df.withColumn("_reason", reason)
    log = rows.where("_reason is not null").select(F.col(key).alias("ad_id"), F.lit(stage).alias("stage"), F.lit("error").alias("level"), F.col("_reason").alias("message"))
    return rows.where("_reason is null").drop("_reason"), log


def fold_sightings(sightings: DataFrame, key: list[str], ts: str, latest: list[str]) -> DataFrame:
    """Sightings by key: impressions, first and last time, and the latest values."""
    newest = F.struct(ts, *latest)
    return sightings.groupBy(*key).agg(F.count("*").alias("impressions"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max(newest).alias("_l")).select(
        *key, "impressions", "first_seen", "last_seen", *(F.col(f"_l.{c}").alias(c) for c in latest)
    )


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two folds of the same key as one: counts add up, times widen."""
    both = old.select(key, "impressions", "first_seen", "last_seen").unionByName(new.select(key, "impressions", "first_seen", "last_seen"))
    return both.groupBy(key).agg(F.sum("impressions").alias("impressions"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


DEFAULTS = ["", "Direct / Unknown", "Direct / Private", "Unknown", "No Tracking", "No Tracker"]


def is_default(value: Column) -> Column:
    """Whether a stored value says that nothing was found."""
    return value.isNull() | value.isin(*DEFAULTS)


def fill(old: Column, new: Column, policy: str = "default") -> Column:
    """The value after a backfill: `null` fills nulls, `default` also labels for nothing
    found, `different` takes whatever is known."""
    open_ = {"null": old.isNull(), "default": is_default(old), "different": F.lit(True)}[policy]
    return F.when(open_ & new.isNotNull(), new).otherwise(old)


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every field that differs."""
    after = new.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"_{f}").cast("string").alias("new_value")) for f in fields))
    rows = old.join(after, F.col(key) == F.col("_k")).select(key, F.explode(pairs).alias("c")).select(key, "c.*")
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
