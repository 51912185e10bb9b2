"""The offer record of an ad: everything that its URLs, its page and the page's variables tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import chains as H
from . import params as P
from . import rules as O


def _told(pool: Column, f: Callable[[Column], Column]) -> Column:
    """What the pool's URLs give, in order, without nulls."""
    return F.filter(F.transform(pool, f), lambda x: x.isNotNull())


def traffic_source(landing: Column, decoded: Column | None = None) -> Column:
    """What a payload told, else by the landing URL's parameters and name."""
    has = lambda n: U.param(landing, n).isNotNull()
    named = (
        F.when(has("rc_uuid"), "Revcontent").when(has("tblci"), "Taboola").when(landing.contains("mgid"), "MGID").when(landing.contains("outbrain"), "Outbrain")
        .otherwise("Unknown")
    )
    return named if decoded is None else F.coalesce(decoded, named)


def offer_intelligence(ads: DataFrame, landing: str, final: str, captured: str, html: str, variables: str, real_domain: str, offer_domain: str) -> DataFrame:
    """ads with `offer_record`, a struct. captured is an array of URLs, variables a map; the
    pool of URLs is landing, captured and final, each once. One pass over each row: no join
    and no shuffle, however long the pools are.

    Ids are those of the last URL that has one, the final one last; within a URL generic names
    come over the networks' own forms. The click id and the
    tracker are filled from the page's variables where URLs tell none.
    """
    pool = F.array_distinct(F.array_compact(F.concat(F.array(landing), F.col(captured), F.array(final))))
    rows = ads.withColumn("_pool", F.coalesce(pool, F.array().cast("array<string>")))
    p, first, last = F.col("_pool"), F.col(landing), F.col(final)
    top = F.array_min(F.flatten(F.transform(p, H.tier_hits)))
    rows = rows.withColumn("_told", F.transform(p, lambda u: F.struct(u.alias("url"), U.pairs(u).alias("pairs"))))
    decoded = lambda x: P.decoded_ids(x["url"], lambda n: U.value_of(x["pairs"], n))
    rows = rows.withColumn("_ids", F.transform("_told", lambda x: F.struct(*(c.alias(k) for k, c in decoded(x).items()))))
    id_of = lambda k: F.get(F.reverse(F.filter(F.col("_ids")[k], lambda x: x.isNotNull())), F.lit(0))
    tracker = F.coalesce(F.get(_told(p, O.url_tracker), F.lit(0)), O.page_tracker(F.col(html), F.col(variables)))
    names = F.create_map(*(F.lit(x) for pair in R.KNOWN_OFFERS for x in pair))
    held = F.transform_keys(variables, lambda k, v: F.lower(k))
    click = F.coalesce(id_of("click_id"), *(F.try_element_at(held, F.lit(v)) for _, _, _, vs in R.POOL_TRACKERS for v in vs if "click" in v or "cid" in v))
    choice = H.offer_choice(last, H.clean_chain(p), F.col(real_domain), F.col(offer_domain), first)
    rows = rows.withColumn("_choice", choice).withColumn("_top", top)
    offer = F.col("_choice.offer")
    affiliate, offer_id = id_of("affiliate_id"), id_of("offer_id")
    known = F.try_element_at(names, U.registered_domain(last))
    record = F.struct(
        F.coalesce("_top.network", known, F.when(affiliate.isNotNull() | offer_id.isNotNull(), F.lit("Direct Affiliate"))).alias("network"),
        F.col("_top.confidence").alias("confidence"), tracker.alias("tracker"), affiliate.alias("affiliate_id"), offer_id.alias("offer_id"), id_of("sub_id1").alias("sub_id1"), id_of("sub_id2").alias("sub_id2"), id_of("offer_domain").alias("told_domain"), click.alias("click_id"),
        offer.alias("offer"), F.col("_choice.method").alias("method"), F.col("_choice.needs_review").alias("needs_review"), U.registered_domain(offer).alias("offer_domain"),
        F.coalesce(O.first_match(F.lower(last), R.VERTICALS), F.lit("Unknown")).alias("vertical"),
        F.coalesce(O.first_match(F.lower(last), [(n, [m]) for m, n in R.PAGE_TYPES]), F.lit("Landing Page")).alias("page_type"),
        traffic_source(first).alias("traffic_source"), P.widget_config(first)["widget_id"].alias("widget_id"), P.widget_config(first)["content_id"].alias("content_id"),
        P.widget_config(first)["publisher_site"].alias("publisher_site"), known.alias("known_program"), P.network_by_params(first).alias("parameter_network"),
        O.cloaking(first, last)["kind"].alias("cloaking"), F.size(p).alias("pool_size"), O.prelander(last).alias("prelander"),
    )
    return rows.select(*ads.columns, record.alias("offer_record"))
