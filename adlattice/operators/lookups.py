"""Looking up ads by keys of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules as O
from .rules import MOST_BROADCAST

#: (level, ads' column, whether it contains the key rather than equals it).
LEVELS = ((1, "offer_id", False), (2, "offer_domain", False), (3, "final_url", True), (4, "landing", True))


def correlate(seen: DataFrame, told: DataFrame, own: str) -> DataFrame:
    """seen(id, hash, href) with `landing`: the first landing in `seq` order that told(hash,
    landing, seq) has for the hash and that isn't of the network's own domain; else the
    href. Null and empty hashes match nothing. One row a hash is joined, however often a
    hash was told."""
    fine = told.where((F.col("hash") != "") & F.col("landing").isNotNull() & ~F.col("landing").contains(own))
    first = fine.groupBy("hash").agg(F.min_by("landing", "seq").alias("_landing"))
    return seen.join(first, "hash", "left").select("id", F.coalesce("_landing", "href").alias("landing"))


def lookup_cascade(keys: DataFrame, ads: DataFrame, latest: str, most: int = 50, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, level, id) of the `most` latest ads of each key, at the first level that finds
    any: offer_id or offer_domain equals the key, final_url or landing contains it
    (without regard to case).

    The ads' values are laid out once: two meet the keys by equality, two by substring, which
    is a broadcast of up to `most_broadcast` keys and else an equality join on runs of
    characters, so any number of keys is looked up exactly. Of each key only `most` rows
    leave a task. Null and empty keys find nothing; ties of `latest` go to the larger id.
    """
    keys = keys.select("key").where("key IS NOT NULL AND key <> ''").distinct()
    value = lambda part: F.array(*(F.struct(F.lit(n).alias("level"), F.col(c).alias("value")) for n, c, p in LEVELS if p == part))
    held = lambda part: ads.select("id", latest, F.inline(value(part))).where("value IS NOT NULL")
    equal = held(False).join(keys, F.col("value") == F.col("key")).select("key", "level", "id", latest)
    texts = held(True).withColumn("_text", F.lower("value")).drop("value")
    parts = O.substring_rows(texts, "_text", keys.withColumn("pattern", F.lower("key")), most_broadcast).select("key", "level", "id", latest)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("level", F.desc(latest), F.desc("id")))
    top = equal.unionByName(parts).withColumn("_n", nth).where(F.col("_n") <= most)
    first = F.min("level").over(Window.partitionBy("key"))
    return top.withColumn("_first", first).where("level = _first").select("key", "level", "id")
