"""Redirect chains and resolution over captured edges, hops and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import rules as O
from .shared import cut


def hops_of(chains: DataFrame, key: str, urls: str) -> DataFrame:
    """One row a hop of each chain's array of URLs."""
    return chains.select(key, F.posexplode(urls).alias("hop", "url"))


def clean_chain(urls: Column) -> Column:
    """Without nulls and static files; first occurrences in order."""
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & ~F.coalesce(u.rlike(O.FILE + "$"), F.lit(False))))


def last_meaningful(hops: DataFrame, key: str) -> DataFrame:
    """The last hop of each chain that may be a landing page."""
    return hops.where(O.meaningful(F.col("url"))).groupBy(key).agg(F.max_by("url", "hop").alias("url"))


def chain_entities(hops: DataFrame, key: str, networks: list[tuple[str, list[str]]], trackers: list[tuple[str, list[str]]], params: list[tuple[str, str]]) -> DataFrame:
    """(key, network, tracker) of every chain: of each kind the last rule that matches, in the
    order of hops and rules; where no rule names a tracker, the first parameter that does.
    What isn't known is direct."""
    text = F.lower("url")
    rows = hops.select(
        key, "hop", O.first_match(text, networks[::-1]).alias("_network"), O.first_match(text, trackers[::-1]).alias("_tracker"), O.first_regex(text, params).alias("_param")
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("hop")))
    first = F.min_by("_param", F.when(F.col("_param").isNotNull(), F.col("hop")))
    return rows.groupBy(key).agg(
        F.coalesce(last("_network"), F.lit("Direct / Private")).alias("network"), F.coalesce(last("_tracker"), first, F.lit("Direct / Unknown")).alias("tracker")
    )


def best_capture(tabs: Column, final: Column, responses: Column, landing: Column) -> Column:
    """struct(score, nth, url, source) of the best of what a browser captured: new tabs 15, the final
    page 10 unless it is the landing page, responses of other hosts that aren't ad tech 5,
    and more with an affiliate's marks. Only valid offers; the first in order wins."""
    marks = lambda u: F.when(O.contains_any(F.lower(u), R.CAPTURE_MARKS), 8).otherwise(0) + F.when(F.lower(u).contains("melodyeu"), 5).otherwise(0)
    other = F.filter(responses, lambda u: ~O.contains_any(U.host(u), R.AD_TECH_HOSTS) & (U.host(u) != U.host(landing)))
    row = lambda u, score, source: F.struct(u.alias("url"), score.alias("score"), F.lit(source).alias("source"))
    found = F.concat(
        F.transform(tabs, lambda u: row(u, F.lit(15), "new_tab")),
        F.transform(F.filter(F.array(final), lambda u: u != landing), lambda u: row(u, F.lit(10), "page_final")),
        F.transform(other, lambda u: row(u, F.lit(5) + marks(u), "network")),
    )
    fine = F.filter(found, lambda x: O.valid_in_list(x["url"]))
    return F.array_max(F.transform(fine, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("nth"), x["url"].alias("url"), x["source"].alias("source"))))


def tier_hits(url: Column, hop: Column) -> Column:
    """The network rules that a pool's URL meets, as structs whose least is the pool's network:
    certain ones first, by hop; of probable ones the last hop; then by rule."""
    text = F.lower(url)

    def on(words: list[str], params: list[str], confidence: str) -> Column:
        test = O.contains_any(text, words) if words else F.lit(True)
        for p in params:
            test &= U.param(url, p).isNotNull()
        if confidence == "medium":  # a short id, not on the network's own hosts
            test &= ~text.contains("clickbank") & (F.length(U.param(url, params[0])) <= 20)
        return F.coalesce(test, F.lit(False))

    def hit(i: int, name: str, confidence: str) -> Column:
        sure = confidence == "high"
        place = (hop if sure else -hop).cast("int")
        return F.struct(F.lit(not sure).alias("unsure"), place.alias("place"), F.lit(i).alias("prio"), F.lit(name).alias("network"), F.lit(confidence).alias("confidence"))

    # most URLs meet none: one pattern of all marks tells them apart
    marks = [m for _, _, ps, names in R.NETWORK_TIERS for m in ps or [f"{names[0].lower()}="]]
    hits = F.array_compact(F.array(*(F.when(on(ps, names, c), hit(i, n, c)) for i, (n, c, ps, names) in enumerate(R.NETWORK_TIERS))))
    none = F.array().cast("array<struct<unsure:boolean,place:int,prio:int,network:string,confidence:string>>")
    return F.when(O.contains_any(text, marks), hits).otherwise(none)


def network_of_pool(pool: DataFrame, key: str) -> DataFrame:
    """(key, network, confidence): the first certain match of a pool of URLs, else the
    last that is probable."""
    hits = pool.select(key, F.explode(tier_hits(F.col("url"), F.col("hop"))).alias("r"))
    return hits.groupBy(key).agg(F.min("r").alias("r")).select(key, "r.network", "r.confidence")


def last_values(pool: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """For each field the value of the last URL of the pool that has one."""
    rows = pool.select(key, "hop", *(c.alias(n) for n, c in values.items()))
    return rows.groupBy(key).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("hop"))).alias(n) for n in values))


REDIRECTS = [301, 302, 303, 307, 308]


def follow(edges: DataFrame, starts: DataFrame, most: int = 8, stop: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, final, hops, chain): each start followed along edges(from_url, to_url), at most
    `most` hops and not around a cycle; chain holds the URLs from the start to the final one.

    A from_url with several edges takes the smallest to_url. Where edges have a status, only
    those of redirects are followed; a URL for which `stop` holds isn't left. Paths are
    doubled: each round joins the end of a path with the path from there, so 15 hops are
    four joins of the distinct URLs, whatever the number of starts. Paths that have come to
    their end take no part in later rounds. Every distinct start is returned once.
    """
    ways = edges.where(F.col("status").isin(*REDIRECTS)) if "status" in edges.columns else edges
    ways = ways.where("from_url IS NOT NULL AND to_url IS NOT NULL")
    if stop is not None:
        ways = ways.where(~stop(F.col("from_url")))
    paths = cut(ways.groupBy("from_url").agg(F.array(F.min("to_url")).alias("path")).withColumn("done", F.lit(False)))
    reach = 1
    while reach < most:
        ahead = paths.select(F.col("from_url").alias("_at"), F.col("path").alias("_more"), F.col("done").alias("_done"))
        met = paths.where(~F.col("done")).join(ahead, F.element_at("path", -1) == F.col("_at"), "left")
        longer = met.select("from_url", F.slice(F.when(F.col("_at").isNotNull(), F.concat("path", "_more")).otherwise(F.col("path")), 1, most).alias("path"), F.coalesce("_done", F.lit(True)).alias("done"))
        paths = cut(longer.unionByName(paths.where("done")))
        reach *= 2
    rows = starts.select("url").where("url IS NOT NULL").distinct().join(paths, F.col("url") == F.col("from_url"), "left")
    # a path that comes back repeats itself, so its distinct URLs are those before that
    chain = F.array_distinct(F.concat(F.array("url"), F.coalesce(F.slice("path", 1, most), F.array().cast("array<string>"))))
    rows = rows.select("url", chain.alias("chain"))
    return rows.select("url", F.element_at("chain", -1).alias("final"), (F.size("chain") - 1).cast("long").alias("hops"), "chain")


def first_per_host(hops: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Each chain's first hop on each host, the first `most` hosts, tagged with the tools that
    the URL names; hosts of large companies aside."""
    rows = hops.withColumn("host", U.host(F.col("url"))).where(~O.contains_any(F.col("host"), R.BIG_TECH))
    rows = rows.groupBy(key, "host").agg(F.min("hop").alias("hop"), F.min_by("url", "hop").alias("url"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("hop"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth").withColumn("tools", O.html_trackers(F.col("url")))


def chain_json(text: Column) -> Column:
    """URLs of a chain stored as JSON: strings or objects with from or url; else none."""
    parsed = F.try_parse_json(text)
    strings = F.try_variant_get(parsed, "$", "array<string>")
    objects = F.from_json(text, "array<struct<`from`:string,url:string>>")
    urls = F.transform(objects, lambda o: F.coalesce(o["from"], o["url"]))
    return F.when(text.rlike(r"^\s*\[\s*\{"), F.coalesce(urls, F.array().cast("array<string>"))).otherwise(F.coalesce(strings, F.array().cast("array<string>")))


def offer_choice(final: Column, chain: Column, real_domain: Column, offer_domain: Column, landing: Column) -> Column:
    """struct(offer, method, needs_review) by priority: the final URL, if it isn't the landing
    page, no dead end and valid; the domain that a postback names; the chain's last valid
    URL of another domain; the offer's domain; else unresolved, for review."""
    valid = lambda u: O.reject_reason(u).isNull()
    dead = lambda u: u.isNull() | O.contains_any(F.lower(u), R.DEAD_ENDS)
    noise = lambda u: O.contains_any(F.lower(u), R.NOISE)
    named = F.when(real_domain.startswith("http"), real_domain).otherwise(F.concat(F.lit("https://"), real_domain))
    home = F.coalesce(U.registered_domain(landing), F.lit(""))
    fit = F.filter(chain, lambda u: ~dead(u) & ~noise(u) & O.valid_in_list(u) & (U.registered_domain(u) != home))

    def step(test: Column, url: Column, method: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(url.alias("offer"), F.lit(method).alias("method"), F.lit(False).alias("needs_review")))

    last = F.get(F.reverse(fit), F.lit(0))
    return F.coalesce(
        step(~F.coalesce(U.same_page(final, landing), F.lit(False)) & ~dead(final) & valid(final), final, "direct"),
        step(real_domain.isNotNull() & valid(named), named, "event_source_url"),
        step(last.isNotNull(), last, "chain_last_valid_filtered"),
        step(offer_domain.isNotNull(), F.concat(F.lit("https://"), offer_domain), "constructed_from_domain"),
        F.struct(F.lit(None).cast("string").alias("offer"), F.lit("unresolved").alias("method"), F.lit(True).alias("needs_review")),
    )
