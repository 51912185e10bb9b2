"""Titles that are alike within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{FEFF}]+"
LEAD = 20  # leading characters that another title may contain
LONGER = 10  # titles must be longer than this to be linked by containment


def normal(title: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), SPACE, " "))


def parts(text: Column) -> Column:
    """The distinct substrings of a title that may be another's lead."""
    starts = F.sequence(F.lit(1), F.length(text) - LONGER)
    lengths = F.sequence(F.lit(LONGER + 1), F.lit(LEAD))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda k: i + k - 1 <= F.length(text)), lambda k: F.substr(text, i, k)))))


def alike(rows: DataFrame, key: str, group: str, title: str) -> DataFrame:
    """(key, others): for each row with any, the number of others of its group whose title
    is equal when normalised, or where one title contains the other's first LEAD characters
    and both are longer than LONGER.

    Works on distinct titles and counts; no pairs of titles are made. With lead(t) the key
    of t, the linked titles are those whose lead t contains, plus those that contain lead(t),
    less those in both, which are counted by (own lead, contained lead).
    """
    rows = rows.where(F.col(group).isNotNull()).select(key, F.col(group).alias("g"), normal(F.col(title)).alias("t"))
    distinct = rows.groupBy("g", "t").agg(F.count("*").alias("n"))
    long = distinct.where(F.length("t") > LONGER).withColumn("lead", F.substring("t", 1, LEAD))
    leads = long.groupBy("g", "lead").agg(F.sum("n").alias("led"))
    held_parts = long.select("g", "t", "n", "lead", F.explode(parts(F.col("t"))).alias("part"))
    held = held_parts.join(leads.select("g", F.col("lead").alias("part"), "led"), ["g", "part"])
    holders = held.groupBy("g", "part").agg(F.sum("n").alias("holding"))
    both = held.groupBy("g", "lead", "part").agg(F.sum("n").alias("both"))
    # titles led by `part` that contain this title's own lead
    mutual = both.select("g", F.col("lead").alias("part"), F.col("part").alias("lead"), "both")
    links = held.join(mutual, ["g", "part", "lead"], "left").groupBy("g", "t", "lead").agg((F.sum("led") - F.coalesce(F.sum("both"), F.lit(0))).alias("leads"))
    links = links.join(holders.withColumnRenamed("part", "lead"), ["g", "lead"]).select("g", "t", (F.col("leads") + F.col("holding")).alias("linked"))
    links = links.unionByName(distinct.where(F.length("t") <= LONGER).select("g", "t", F.col("n").alias("linked"))).where("linked > 1")
    return rows.join(links, ["g", "t"]).select(key, (F.col("linked") - 1).alias("others"))
