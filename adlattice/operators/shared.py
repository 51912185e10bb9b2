"""Tables and folders that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Without one, the warehouse will do on
    a single machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return top.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; none there is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_MADE: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a job writes; it is removed when the application ends, unless the
    session is stopped before."""
    if not _MADE:
        atexit.register(_clear)
    path = f"{top_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, for loops that go on from it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{top_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: str, name: str, ranges: int = 256) -> DataFrame:
    """df with `name`, the row's number from 0 in the order of the numeric column `by`, nulls last.
    Rows are numbered within ranges between approximate quantiles, so that no task holds all
    of them; the rows before each range are summed over one narrow row a range."""
    parts = [i / ranges for i in range(1, ranges)] or [0.5]
    ends = sorted(set(df.agg(F.percentile_approx(by, parts, 10 * ranges)).first()[0] or []))
    below = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col(by))) if ends else F.lit(0)
    dealt = df.withColumn("_range", F.when(F.col(by).isNull(), len(ends) + 1).otherwise(below))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(by)))
    return dealt.withColumn("_nth", nth - 1).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_nth")).drop("_range", "_start", "_nth")
