"""Weighted scores and verdicts of ads and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import rules as O


#: The signals of an ad's score with their names and weights.
SCORED = [
    ("final_url_has_aff_params", 3), ("final_url_has_aff_path", 3), ("domain_change_to_health", 3), ("url_is_known_tracker", 2), ("content_has_buy_intent", 2),
    ("final_domain_in_arbitrage_whitelist", -2),
]


def ad_score(url: Column, final: Column, content: Column) -> Column:
    """struct(score, signals): affiliate signals count up, publisher domains down."""
    first, last, body = F.lower(url), F.lower(F.coalesce(final, url)), F.lower(content)
    host = U.host(last)
    tests = [
        O.contains_any(last, R.AFFILIATE_PARAMS), O.contains_any(last, R.AFFILIATE_PATHS), F.coalesce(host != U.host(url), F.lit(False)) & O.contains_any(host, R.HEALTH_WORDS),
        O.contains_any(first, R.TRACKER_MARKS) | O.contains_any(last, R.TRACKER_MARKS), O.contains_any(body, R.BUY_WORDS), O.contains_any(host, R.PUBLISHERS),
    ]
    met = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"))) for t, (name, n) in zip(tests, SCORED, strict=True))))
    return F.struct(F.aggregate(met, F.lit(0), lambda a, x: a + x["n"]).alias("score"), met["name"].alias("signals"))


def keyword_vote(content: Column) -> Column:
    body = F.lower(content)
    a, b = F.size(O.matches(body, R.AFFILIATE_PHRASES)), F.size(O.matches(body, R.ARBITRAGE_PHRASES))
    return F.when((a > b) & (a >= 1), "Affiliate").when((b > a) & (b >= 2), "Arbitrage").otherwise("Unknown")


def score_verdict(score: Column, content: Column) -> Column:
    """struct(ad_type, confidence) of a score; between the limits the page's words decide. With
    the default weights -3 isn't reached; it holds for rules that weigh publishers more."""
    vote = keyword_vote(content)
    kind = F.when(score >= 1, "Affiliate").when(score <= -3, "Arbitrage").otherwise(vote)
    sure = F.when(score >= 3, "high").when((score >= 1) | (score <= -3) | (vote != "Unknown"), "medium").otherwise("low")
    return F.struct(kind.alias("ad_type"), sure.alias("confidence"))


#: Marks in a landing URL that make an ad an affiliate's, whatever the page holds.
STRONG_MARKERS = [
    "hop=", "hopid=", "affid=", "aff_id=", "affiliate_id=", "cep=", "clickid=", "click_id=", "lptoken=", "offid=", "offer_id=", "voluumdata=", "voluum", "wellnessgaze", "go.php", "bsl=", "t=aff",
    "sub1=", "sub2=", "sub3=", "tid=", "extclid=", "rtkck", "trendingboom",
]
FORCED = {"buy.com": "Direct Sales", "amazon.com": "Affiliate"}


def cascade(landing: Column, final: Column, page: Column, networks: Column, structure: Column, chain: Column, forced: dict[str, str] | None = None) -> Column:
    """struct(ad_type, confidence, stage, reason, skip) by the first stage that decides.

    networks: the page's ad networks, an array, most marks first; structure: struct with
    paginated, page_number and ad_count; chain: struct with network, affiliate_id and
    offer_id of the ad's redirects. The stages are a known domain, a strong marker, an ad
    network's code, a suspicious structure, a known offer in the chain, the score, and a
    bridge page's path and paging. skip: no deeper analysis is needed.
    """
    url, text = F.lower(landing), F.lower(page)
    host = F.regexp_replace(F.lower(U.netloc(landing)), r"^www\.", "")
    known = F.coalesce(*(F.when(host == d, F.lit(t)) for d, t in (FORCED if forced is None else forced).items()))
    marked = O.contains_any(url, STRONG_MARKERS) | F.coalesce(page.contains("voluumdata") | page.contains("/go.php?"), F.lit(False))
    coded = F.coalesce(F.size(networks) > 0, F.lit(False))
    shaped = (structure["paginated"] & (structure["page_number"] >= 2)) | (structure["ad_count"] >= 3)
    named = F.coalesce(~chain["network"].isin("Unknown", "No Network Detected"), F.lit(False))
    chained = chain["affiliate_id"].isNotNull() | chain["offer_id"].isNotNull() | named
    score = ad_score(landing, final, page)["score"]
    scored = score_verdict(score, page)
    bridge = O.contains_any(url, ["trending", "article", "gallery"]) & O.contains_any(text, ["next page", "read more"])

    def verdict(kind, sure, stage: str, reason, skip: bool) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(text(kind).alias("ad_type"), text(sure).alias("confidence"), F.lit(stage).alias("stage"), text(reason).alias("reason"), F.lit(skip).alias("skip"))

    return (
        F.when(known.isNotNull(), verdict(known, "high", "Knowledge", "KNOWN_DOMAIN", False))
        .when(marked, verdict("Affiliate", "high", "Signal", "STRONG_AFFILIATE_SIGNAL_DETECTED", False))
        .when(coded | O.contains_any(url, ["syndicatedsearch.goog", "google.com/afs"]), verdict("Arbitrage", "high", "Instant", F.concat(F.lit("EXPLICIT_NETWORK_CODE_DETECTED: "), F.coalesce(F.get(networks, F.lit(0)), F.lit("Google AFD"))), True))
        .when(F.coalesce(shaped, F.lit(False)), verdict("Manual Review Required", "medium", "3", "suspicious_structure_no_ad_code", False))
        .when(chained, verdict("Affiliate", "high", "4", F.concat(F.lit("known_aff_signature_in_chain: "), F.coalesce(chain["network"], F.lit("Unknown"))), False))
        .when(scored["ad_type"] == "Affiliate", verdict("Affiliate", scored["confidence"], "5", F.concat(F.lit("scoring_system: "), score.cast("string")), False))
        .when(bridge, verdict("Arbitrage", "medium", "BridgeHeuristic", "URL_PATH_AND_PAGINATION_MATCH", True))
        .otherwise(verdict("Unknown", "low", "6", "no_conclusive_signals", False))
    )


def knowledge_override(ads: DataFrame, feedback: DataFrame, host: str, predicted: str) -> DataFrame:
    """ads with `forced`, the newest verdict that feedback(domain, forced_type, updated_at) has
    for the host, and `verdict`: that, or what was predicted. One row a domain is joined."""
    newest = feedback.groupBy(F.col("domain").alias("_domain")).agg(F.max_by("forced_type", "updated_at").alias("forced"))
    return ads.join(newest, F.col(host) == F.col("_domain"), "left").drop("_domain").withColumn("verdict", F.coalesce("forced", predicted))


def fetch_health(url: Column, status: Column, size: Column, final: Column, error: Column) -> Column:
    """The first reason why a captured fetch isn't healthy, or ok."""
    named = {404: "http_404_not_found", 403: "http_403_forbidden", 500: "http_500_server_error"}
    by_status = F.coalesce(*(F.when(status == n, F.lit(text)) for n, text in named.items()), F.concat(F.lit("http_"), status.cast("string")))
    return (
        F.when(url.isNull() | ~url.startswith("http"), "invalid_url_format")
        .when(O.contains_any(U.host(url), R.AD_TECH_HOSTS), "ad_tech_infrastructure")
        .when(error.isNotNull(), error)
        .when(~F.coalesce(status.isin(200, 201, 301, 302), F.lit(False)), by_status)
        .when(size < 3000, "thin_content")
        .when((final != url) & O.reject_reason(final).isNotNull(), "redirected_to_invalid_domain")
        .otherwise("ok")
    )
