"""Registered domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import rules as O


def suffix_table(spark: SparkSession) -> DataFrame:
    """The bundled suffixes in the public list's notation: co.uk, *.ck, !www.ck."""
    rows = [(f"{'!' if n[0] == '!' else ''}{n.lstrip('!')}.{top}",) for top, names in R.SUFFIXES.items() for n in names]
    return spark.createDataFrame(rows, "suffix string")


def registered_domains(df: DataFrame, key: str, url: Column, suffixes: DataFrame) -> DataFrame:
    """(key, domain) for every row: one label under the longest suffix that the host ends with.

    Every parent domain of a host meets the suffixes by equality, so lists of any length
    are one join, broadcast after a check of their number. A wildcard takes one more label,
    an exception one less and comes before all others; without a rule the last label is
    the suffix. Hosts that are addresses, suffixes themselves or single labels stay.
    """
    wild, own = F.col("suffix").startswith("*."), F.col("suffix").startswith("!")
    bare = F.regexp_replace("suffix", r"^(\*\.|!)", "")
    labels = F.size(F.split(bare, r"\."))
    rules = suffixes.select(bare.alias("pattern"), F.struct(own.alias("own"), (labels + F.when(wild, 1).when(own, -1).otherwise(0)).alias("n")).alias("rule"))
    name = U.host(url)
    hosts = df.select(F.col(key).alias("_key"), name.alias("_host"))
    met = hosts.where(~name.rlike("^[0-9.]*$")).select("_key", F.explode(U.host_suffixes(F.col("_host"))).alias("pattern"))
    longest = met.join(O.bounded(rules), "pattern").groupBy("_key").agg(F.max("rule").alias("rule"))
    parts = F.split("_host", r"\.")
    take = F.coalesce(F.col("rule.n"), F.lit(1)) + 1
    domain = F.array_join(F.slice(parts, F.size(parts) - take + 1, take), ".")
    whole = F.col("_host").rlike("^[0-9.]*$") | (F.size(parts) < take)
    return hosts.join(longest, "_key", "left").select(F.col("_key").alias(key), F.when(whole, F.col("_host")).otherwise(domain).alias("domain"))
