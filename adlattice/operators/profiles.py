"""Profiles of advertisers and offers, and the faceted search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from . import rules as O
from . import titles as TT


def _set(name: str) -> Column:
    """The distinct values, sorted; nulls and empty ones aside. For columns of few values."""
    return F.array_sort(F.collect_set(F.nullif(F.col(name), F.lit(""))))


def _newest(name: str, default: Column | None = None) -> Column:
    """The value of the newest ad that has one; of a day the smallest id."""
    value = F.nullif(F.col(name), F.lit(""))
    found = F.min_by(name, F.when(value.isNotNull(), F.struct(-F.col("created_day"), F.col("id"))))
    return found if default is None else F.coalesce(found, default)


def _common(key: str) -> list[Column]:
    return [
        F.count("*").alias("ads"), _set("network").alias("networks"), _set("country_code").alias("geos"), _set("tracker_tool").alias("trackers"),
        _newest("affiliate_network", F.lit("Direct/In-house")).alias("affiliate_network"), F.sum(F.coalesce("impressions", F.lit(1))).alias("impressions"),
        F.min("created_day").alias("first_seen"), F.max("created_day").alias("last_seen"),
    ]


def advertisers(ads: DataFrame, key: str) -> DataFrame:
    """One row for each advertiser: its ads, networks, countries, verticals, trackers, number of
    offers, first known affiliate network, impressions (an ad without counts once) and
    first and last day. All ads count; partial aggregates leave each task, so a large
    advertiser doesn't meet in one. Rows without a key are left out."""
    rows = ads.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.groupBy(key).agg(*_common(key), _set("vertical").alias("verticals"), F.count_distinct("offer").alias("offers"))


def offers(ads: DataFrame, key: str) -> DataFrame:
    """One row for each offer, as for advertisers; with the number of affiliates, the newest
    known vertical (else General) and domain (else the key), and the newest URLs."""
    rows = ads.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.groupBy(key).agg(
        *_common(key), F.count_distinct("affiliate_id").alias("affiliates"), _newest("vertical", F.lit("General")).alias("vertical"),
        _newest("offer_domain", F.first(key)).alias("offer_domain"), _newest("final_url").alias("final_url"), _newest("landing").alias("landing"),
    )


def top_lists(rows: DataFrame, keys: list[str], order: list[Column], value: Column, k: int, name: str) -> DataFrame:
    """keys and `name`, an array of the values of each key's first k rows. Only k rows of a key
    leave a task, so a key of any size is one short list."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = rows.select(*keys, value.alias("_v"), nth.alias("_n")).where(F.col("_n") <= k)
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_v"))).alias("_l"))
    return lists.select(*keys, F.col("_l._v").alias(name))


def intelligence(ads: DataFrame, advertiser: str, matches: int = 10, latest: int = 5) -> DataFrame:
    """For each ad with an advertiser: the advertiser's totals, its `latest` ads, and the first
    `matches` other ads of the same title, those of equal normalised titles, of any
    advertiser, before those of the advertiser whose titles are alike (titles.alike), each by
    id; `match_networks` and `cross_network` tell of these.

    ads: id, title, network, impressions, created_day and the advertiser's column. No pairs
    of ads are made: lists of the first ids meet titles, leads and leads that a title holds.
    """
    rows = ads.where(F.col(advertiser).isNotNull() & (F.col(advertiser) != "")).withColumn("_t", TT.normal(F.col("title"))).withColumnRenamed(advertiser, "_g")
    about = rows.groupBy("_g").agg(F.count("*").alias("total"), _set("network").alias("networks"), F.count_distinct("title").alias("titles"), F.min("created_day").alias("first_day"), F.max("created_day").alias("last_day"))
    recent = top_lists(rows, ["_g"], [F.desc("created_day"), F.desc("id")], F.struct("id", "network", F.substring("title", 1, 60).alias("title"), "impressions"), latest, "recent")
    ad = F.struct("id", "network", "title", "impressions")
    k = matches + 1  # one may be the ad itself
    every = ads.withColumn("_t", TT.normal(F.col("title")))
    equal = top_lists(every, ["_t"], [F.col("id")], ad, k, "equal")
    long = rows.where(F.length("_t") > TT.LONGER).withColumn("_lead", F.substring("_t", 1, TT.LEAD))
    distinct = long.select("_g", "_t", "_lead").distinct()
    leads = distinct.select("_g", F.col("_lead").alias("_part")).distinct()
    held = distinct.select("_g", "_t", F.explode(TT.parts(F.col("_t"))).alias("_part")).join(leads, ["_g", "_part"])
    led = top_lists(long.withColumnRenamed("_lead", "_part"), ["_g", "_part"], [F.col("id")], ad, k, "list")
    holding = top_lists(held.join(long.select("_g", "_t", "id", "network", "title", "impressions"), ["_g", "_t"]), ["_g", "_part"], [F.col("id")], ad, k, "list")
    near = held.join(led, ["_g", "_part"]).select("_g", "_t", F.explode("list").alias("ad"))
    near = near.unionByName(distinct.withColumnRenamed("_lead", "_part").join(holding, ["_g", "_part"]).select("_g", "_t", F.explode("list").alias("ad"))).distinct()
    near = near.where(TT.normal(F.col("ad.title")) != F.col("_t"))
    near = top_lists(near, ["_g", "_t"], [F.col("ad.id")], F.col("ad"), matches, "near")
    found = rows.join(about, "_g").join(recent, "_g").join(equal, "_t").join(near, ["_g", "_t"], "left")
    none = F.filter("equal", lambda x: F.lit(False))
    found = found.withColumn("_all", F.filter(F.concat("equal", F.coalesce("near", none)), lambda x: x["id"] != F.col("id")))
    found = found.withColumn("matches", F.slice("_all", 1, matches))
    names = F.array_sort(F.array_distinct(F.filter(F.col("matches.network"), lambda x: x.isNotNull())))
    return found.select(
        "id", F.col("_g").alias(advertiser), "total", "networks", "titles", (F.col("last_day") - F.col("first_day")).alias("days"), "recent", "matches",
        names.alias("match_networks"), (F.size(names) > 1).alias("cross_network"),
    )


def sample_sites(sites: DataFrame, niches: DataFrame, n: int, seed: str) -> DataFrame:
    """(geo, niche, site, rank): n sites of each niche of each place, those with the smallest hashes
    of site and seed; reruns agree. sites: site, niche; niches: geo, niche, with the forced
    niches of every place. Each niche keeps its first n only, in tasks already; nothing is
    sorted as a whole. Repeated rows count once; null sites and niches take no part."""
    held = sites.where("site IS NOT NULL AND niche IS NOT NULL").select("site", "niche").distinct()
    order = Window.partitionBy("niche").orderBy(F.md5(F.concat("site", F.lit(seed))), "site")
    first = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return niches.where("niche IS NOT NULL").distinct().join(first, "niche").select("geo", "niche", "site", "rank")


def discover_targets(links: DataFrame, pages: DataFrame, known: DataFrame, blacklist: list[str], marks: list[str]) -> DataFrame:
    """(site): origins of the pages that others link to and that show one of the marks, without
    those known. links: link, absolute; pages: url, html; known: site. Links that hold a
    blacklisted word in any case, or don't start with http, are left out. Marks are looked
    for once in each page, and only (url) meets the distinct links."""
    marked = pages.where(O.contains_any(F.lower("html"), marks)).select("url").distinct()
    fine = links.where(F.col("link").startswith("http") & ~O.contains_any(F.lower("link"), blacklist)).select(F.col("link").alias("url")).distinct()
    found = fine.join(marked, "url", "left_semi").select(U.origin(F.col("url")).alias("site")).distinct()
    return found.join(known.select("site"), "site", "left_anti")


def faceted_search(ads: DataFrame, facets: dict[str, list[str]], text: str = "", least: int = 0, sort: str = "newest", page: int = 1, size: int = 30) -> DataFrame:
    """(id, total) of one page of the ads that match: the title contains `text` in any case,
    each facet's column has one of the values given for it (none given: any), and there
    are `least` impressions at least. sort: newest, oldest or impressions; ties by id.
    total counts all that match."""
    test = F.lit(True)
    for column, values in facets.items():
        if values:
            test &= F.col(column).isin(*values)
    if text:
        test &= F.contains(F.lower("title"), F.lit(text.lower()))
    if least > 0:
        test &= F.col("impressions") >= least
    rows = ads.where(test)
    order = {"newest": F.desc("created_day"), "oldest": F.asc("created_day"), "impressions": F.desc_nulls_last("impressions")}[sort]
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    found = rows.select("id", "created_day", "impressions").orderBy(order, "id").limit(page * size).offset((page - 1) * size)
    return found.crossJoin(total).select("id", "total")
