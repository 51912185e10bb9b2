"""Offer links of stored pages by eight patterns, and the walk through pre-landers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import links as L
from ..rules import tables as R
from . import rules as O

TAG = r"<[a-zA-Z](?:[^>\x22']++|\x22[^\x22]*\x22|'[^']*'|[\x22'])*+>"
NOSCRIPT = r"(?is)<noscript\b[^>]*>(.*?)</noscript>"
WEB = r"https?://[^\s\x22'<>{}\[\]\\,;()|]+"
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script>"


def _attr(tag: Column, name: str) -> Column:
    """A quoted or bare attribute of a start tag, empty if it has none."""
    at = rf"(?i)[\s\x22']{name}\s*=\s*"
    value = F.concat(*(F.regexp_extract(tag, at + v, 1) for v in (r"\x22([^\x22]*)", "'([^']*)", r"([^\s\x22'>]+)")))
    return F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))


def _of(urls: Column, method: str, score: int) -> Column:
    web = F.filter(urls, lambda u: u.startswith("http"))
    return F.transform(web, lambda u: F.struct(u.alias("link"), F.lit(method).alias("method"), F.lit(score).alias("score")))


def valid(url: Column) -> Column:
    """Of a URL of a list."""
    return O.valid_in_list(url)


def best_links(pages: DataFrame, *keep: str, fits: Callable[[Column], Column] = valid) -> DataFrame:
    """keep, link, method, score, tracker: each page's link of the highest score that fits,
    the first in pattern order; the last tracker link of a page that has none."""
    href = lambda t: _attr(t, "href")
    classed = lambda c: rf"(?i)[\s\x22']class\s*=\s*(?:\x22[^\x22]*{c}|'[^']*{c}|[^\s\x22'>]*{c})"
    rows = pages.select(*keep, F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("_tags"), F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)).alias("_scripts"))
    anchors = F.filter(F.transform(F.filter("_tags", lambda t: t.rlike(r"(?i)^<a\s")), href), lambda u: u != "")
    metas = F.filter("_tags", lambda t: t.rlike(r"(?i)^<meta\s") & _attr(t, "http-equiv").rlike("(?i)refresh"))
    rows = rows.select("*", anchors.alias("_a"), metas.alias("_m"))
    a = F.col("_a")
    of_class = lambda c: F.filter("_tags", lambda t: t.rlike(classed(c)))
    by_class = F.transform(F.concat(*map(of_class, L.OFFER_CLASSES)), href)
    data = lambda n: lambda t: _attr(t, n)
    by_data = F.concat(*(F.transform("_tags", data(n)) for n in L.DATA_ATTRS))
    scripts = F.flatten(F.transform("_scripts", lambda s: F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in L.SCRIPT_LINKS))))
    carried = F.transform(F.filter(a, lambda u: u.contains("hop-apps.clickbank.net")), lambda u: U.unescape(U.param(u, "destinationUrl")))
    refresh = F.transform("_m", lambda m: F.regexp_replace(F.regexp_extract(_attr(m, "content"), "(?i)url=(.+)", 1), r"^[\x22'\s]+|[\x22'\s]+$", ""))
    found = F.concat(
        _of(by_class, "class", 10), _of(F.filter(a, lambda u: O.contains_any(u, L.NETWORK_LINKS)), "network", 10), _of(carried, "destination", 10), _of(by_data, "data", 9),
        _of(F.transform(scripts, lambda u: F.regexp_replace(u, r"[\x22',;]+$", "")), "script", 8), _of(F.filter(a, lambda u: O.contains_any(u, L.PARAM_LINKS)), "param", 7), _of(refresh, "refresh", 6),
    )
    rows = rows.select(*keep, "_a", found.alias("_found"))
    best = F.get(F.filter("_found", lambda f: fits(f["link"])), F.lit(0))
    tracker = F.get(F.reverse(F.filter(a, lambda u: O.contains_any(u, L.TRACKER_LINKS))), F.lit(0))
    return rows.select(*keep, best.alias("_b"), tracker.alias("_t")).select(*keep, "_b.*", F.when(F.col("_b").isNull(), F.col("_t")).alias("tracker"))


def prelander_walk(starts: DataFrame, key: str, pages: DataFrame, most: int = 3) -> DataFrame:
    """(key, final, hops, arrived) of each of starts(key, url): while the URL is a
    pre-lander, its page's best link is taken, at most `most` times; one to another
    pre-lander is followed too, even where its host is no offer's. arrived tells whether
    final is a valid offer and no pre-lander. Of several pages of a URL the one with the
    smallest page_id that has a link counts. One equality join on URLs a hop.
    """
    ways = best_links(pages.where(O.prelander(F.col("url"))), "page_id", "url", fits=lambda u: valid(u) | O.prelander(u)).where("link is not null")
    ways = ways.groupBy(F.col("url").alias("from")).agg(F.min_by("link", "page_id").alias("to"))
    rows = starts.select(key, F.col("url").alias("final"), F.lit(0).cast("long").alias("hops"))
    for _ in range(most):
        rows = rows.join(ways, F.col("final") == F.col("from"), "left")
        rows = rows.select(key, F.coalesce("to", "final").alias("final"), (F.col("hops") + F.col("to").isNotNull().cast("long")).alias("hops"))
    return rows.withColumn("arrived", O.reject_reason(F.col("final")).isNull() & ~O.prelander(F.col("final")))


def _scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))


def _trimmed(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.regexp_replace(u, r"[\x22',.;)]+$", ""))


def ordered_link(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, link, method: the link of the first element that a selector finds, in the order of
    selectors; else of the first script variable that holds one; else the first link to a
    known tracker. Links that don't start with http don't count; null html has none."""
    held = ("href", "data-offer", "data-href", "data-redirect-url")

    def of(tag: Column) -> Column:
        return F.coalesce(*(F.nullif(_attr(tag, a), F.lit("")) for a in held))

    rows = pages.select(*keep, "html", F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("_tags"))
    having = lambda p: F.filter("_tags", lambda t: t.rlike(p))
    chosen = (F.transform(having(p), of) for p in L.SELECTORS)
    web = lambda urls: F.get(F.filter(urls, lambda u: u.startswith("http")), F.lit(0))
    anchors = F.transform(F.filter("_tags", lambda t: t.rlike(r"(?i)^<a\s")), lambda t: _attr(t, "href"))
    steps = (
        ("selector", web(F.concat(*chosen))),
        ("script", web(_trimmed(F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in L.VARIABLES))))),
        ("tracker", web(F.filter(anchors, lambda u: O.contains_any(u, L.TRACKER_LINKS)))),
    )
    best = F.coalesce(*(F.when(link.isNotNull(), F.struct(link.alias("link"), F.lit(m).alias("method"))) for m, link in steps))
    return rows.select(*keep, best.alias("_b")).select(*keep, "_b.*")


def boosts(url: Column) -> Column:
    return O.weighted(F.lower(url), L.BOOSTS)


def deep_links(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, link, method, score: the best URL in scripts (5), their flat JSON objects (7), onclick
    handlers (6) and noscript anchors (7). URLs on the skip list or that aren't valid
    offers don't count, those of the page's own domain start from 1; marks of offers add
    to the score. The highest wins, then the order json, script, onclick, noscript."""
    html = F.col("html")
    rows = pages.select(*keep, U.registered_domain(F.col("url")).alias("_home"), _scripts(html).alias("_scripts"), F.regexp_extract_all(html, F.lit(TAG), F.lit(0)).alias("_tags"), F.regexp_extract_all(html, F.lit(NOSCRIPT), F.lit(1)).alias("_none"))
    find = lambda texts: F.flatten(F.transform(texts, lambda t: _trimmed(F.regexp_extract_all(t, F.lit(WEB), F.lit(0)))))
    blobs = F.filter(F.flatten(F.transform("_scripts", lambda t: F.regexp_extract_all(t, F.lit(r"\{[^{}]{20,500}\}"), F.lit(0)))), lambda b: F.try_parse_json(b).isNotNull())
    in_json = F.flatten(F.transform(blobs, lambda b: F.regexp_extract_all(b, F.lit(r'"(http[^"\\]*)"'), F.lit(1))))
    in_script = F.filter(find(F.col("_scripts")), lambda u: (F.length(u) > 15) & u.contains("."))
    handlers = F.filter(F.transform("_tags", lambda t: _attr(t, "onclick")), lambda x: x != "")
    hidden = F.filter(F.flatten(F.transform("_none", lambda t: F.regexp_extract_all(t, F.lit(r"(?i)<a\s[^>]*?href=[\x22']([^\x22']*)"), F.lit(1)))), lambda u: u.startswith("http"))

    def scored(urls: Column, method: str, base: int) -> Column:
        fine = F.filter(urls, lambda u: ~O.contains_any(F.lower(u), L.DEEP_SKIP) & valid(u))
        start = lambda u: F.when(U.registered_domain(u) == F.col("_home"), 1).otherwise(base)
        return F.transform(fine, lambda u: F.struct((start(u) + boosts(u)).alias("score"), u.alias("link"), F.lit(method).alias("method")))

    found = F.concat(scored(in_json, "json", 7), scored(in_script, "script", 5), scored(find(handlers), "onclick", 6), scored(hidden, "noscript", 7))
    rows = rows.select(*keep, F.transform(found, lambda f, i: F.struct(f["score"].alias("score"), (-i).alias("nth"), f["link"].alias("link"), f["method"].alias("method"))).alias("_found"))
    return rows.select(*keep, F.array_max("_found").alias("_b")).select(*keep, "_b.link", "_b.method", "_b.score")


def quick_candidates(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, href, score of each page's best candidate: links of the elements that a selector
    finds count 10 with an affiliate signature, else 5; only where there are none, all
    links with an offer's word count 3, and long ones with parameters 2. Links of ad-tech
    hosts don't count; the first in order wins. Pages without any give no row."""
    rows = pages.select(*keep, F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("_tags"))
    web = lambda urls: F.array_distinct(F.filter(urls, lambda u: u.startswith("http") & ~O.contains_any(U.host(u), R.AD_TECH_HOSTS)))
    having = lambda p: F.filter("_tags", lambda t: t.rlike(p))
    chosen = web(F.transform(F.concat(*map(having, L.QUICK_SELECTORS)), lambda t: _attr(t, "href")))
    every = web(F.transform(having(r"(?i)^<a\s"), lambda t: _attr(t, "href")))
    rows = rows.select(*keep, chosen.alias("_chosen"), every.alias("_every"))
    first = lambda u: F.when(O.contains_any(F.lower(u), R.SIGNATURES), 10).otherwise(5)
    second = lambda u: F.when(O.contains_any(F.lower(u), L.QUICK_WORDS), 3).when(u.contains("=") & (F.length(u) > 25), 2).otherwise(0)
    scored = lambda urls, score: F.transform(urls, lambda u, i: F.struct(score(u).alias("score"), (-i).alias("nth"), u.alias("href")))
    best = F.array_max(F.when(F.size("_chosen") > 0, scored(F.col("_chosen"), first)).otherwise(scored(F.col("_every"), second)))
    return rows.select(*keep, best.alias("_b")).where("_b.score > 0").select(*keep, "_b.href", "_b.score")
