"""Resolution of an ad's offer from what was captured: requests, responses, redirects and fetch
results. All look-ups by URL are equality joins; choices are aggregates with an explicit
order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import chains as H
from . import rules as O


def valid(url: Column) -> Column:
    return url.isNotNull() & O.reject_reason(url).isNull()


def _healthy(rows: DataFrame, url: str, health: DataFrame) -> DataFrame:
    """The rows whose URL is among health(url, healthy) as healthy."""
    good = health.where("healthy").select(F.col("url").alias("_good")).distinct()
    return rows.join(good, F.col(url) == F.col("_good"), "left_semi")


def validated(offers: DataFrame, captured: DataFrame, health: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, url) for every offers(id, url): its URL, if that is a valid offer and healthy; else the
    last of captured(id, seq, url) that is; else, with edges, where the redirects of the
    last captured intermediary lead, if that is; else null."""
    own = offers.where(valid(F.col("url"))).select("id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("seq"), "url")
    more = captured.where(valid(F.col("url"))).select("id", F.lit(0).alias("rank"), F.col("seq").cast("long").alias("seq"), "url")
    found = _healthy(own.unionByName(more), "url", health)
    if edges is not None:
        hops = captured.where(O.contains_any(U.host(F.col("url")), R.INTERMEDIARIES)).select("id", F.col("seq").cast("long").alias("seq"), F.col("url").alias("via"))
        ends = H.follow(edges, hops.select(F.col("via").alias("url")), 15).where("hops > 0").select(F.col("url").alias("via"), F.col("final").alias("url"))
        late = hops.join(ends, "via").where(valid(F.col("url"))).select("id", F.lit(-1).alias("rank"), "seq", "url")
        found = found.unionByName(_healthy(late, "url", health))
    best = found.groupBy("id").agg(F.max_by("url", F.struct("rank", "seq", "url")).alias("url"))
    return offers.select("id").join(best, "id", "left")


#: The layers of a resolution, from what costs least; 6 falls back to any capture.
LAYERS = {0: "L0_Simple_Scan", 1: "layer1_static", 2: "layer2_httpx", 3: "layer3_deep_scan", 5: "layer5_capture", 6: "layer6_fallback"}


def layered(ads: DataFrame, candidates: DataFrame, captured: DataFrame, health: DataFrame) -> DataFrame:
    """(id, url, method, layers_tried) for every ad: the candidate(id, layer, url) of the first
    layer that is a valid and healthy offer. A candidate of layer 5 that isn't is replaced by
    the last captured URL that is; so is an ad's offer where no layer has a candidate."""
    fine = _healthy(candidates.where(valid(F.col("url"))), "url", health).select("id", "layer", "url")
    back = validated(ads.select("id", F.lit(None).cast("string").alias("url")), captured, health).where("url IS NOT NULL")
    tried = candidates.where("layer = 5 AND url IS NOT NULL").select("id").distinct().withColumn("five", F.lit(True))
    back = back.join(tried, "id", "left").select("id", F.when(F.col("five"), F.lit(5)).otherwise(6).alias("layer"), "url", F.lit(1).alias("late"))
    rows = fine.withColumn("late", F.lit(0)).unionByName(back)
    best = rows.groupBy("id").agg(F.min(F.struct("layer", "late", "url")).alias("b"))
    named = F.coalesce(*(F.when(F.col("b.layer") == n, F.lit(m)) for n, m in LAYERS.items()), F.lit("failed"))
    return ads.select("id").join(best, "id", "left").select("id", F.col("b.url").alias("url"), named.alias("method"), F.coalesce("b.layer", F.lit(6)).alias("layers_tried"))


REQUEST_NOISE = [
    "mgid.com", "adskeeper.com", "ploynest.com", "clck.", "ghits/", "onetrust.com", "cookieconsent", "cookielaw.org", "bot-detected", "adtrafficquality.google", "googleadservices.com", "activeview", "sodar",
]
RESOURCES = [".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".woff2"]


def landing_of_requests(requests: DataFrame, first: bool = False) -> DataFrame:
    """(target, url): of requests(target, seq, type, url) the last one that may be a landing page:
    a document, xhr or fetch, no tracking, no resource, over 25 characters, on a host with a
    dot. With first, the first document of each target, resources not being told apart."""
    u, text = F.col("url"), F.lower("url")
    test = u.startswith("http") & (F.length(u) > 25) & U.netloc(u).contains(".") & ~O.contains_any(text, REQUEST_NOISE)
    if first:
        rows = requests.where(test & F.col("type").isin("document", "sub_document"))
        return rows.groupBy("target").agg(F.min_by("url", "seq").alias("url"))
    rows = requests.where(test & F.col("type").isin("document", "xhr", "fetch") & ~O.contains_any(text, RESOURCES))
    return rows.groupBy("target").agg(F.max_by("url", "seq").alias("url"))


BACKGROUND = ["hopid", "affiliate", "clickid", "offid"]


def foreign_responses(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, responses, offers) for each of pages(id, url) with any: its distinct responses(id, seq,
    url) that may be landing pages and don't name the page's registered domain, and those
    of any domain with an offer's keyword, each in the order in which they came first."""
    rows = responses.groupBy("id", "url").agg(F.min("seq").alias("seq"))
    home = pages.select("id", U.registered_domain(F.col("url")).alias("home"))
    rows = rows.join(home, "id")
    foreign = O.meaningful(F.col("url")) & ~F.col("url").contains(F.col("home"))
    asked = O.contains_any(F.lower("url"), BACKGROUND)
    kept = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("seq", "url")))), lambda x: x["url"])
    out = rows.where(foreign | asked).groupBy("id").agg(kept(foreign).alias("responses"), kept(asked).alias("offers"))
    return out


def final_choice(ads: DataFrame, tabs: DataFrame, responses: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, url) for every ads(id, landing, page): the last new tab (id, seq, url), else the page
    where it isn't the landing one, else the last response (id, seq, status, url) with status
    200 that is a valid offer and not the landing page. A choice that is no valid offer is
    repaired by the last URL of the chain (id, seq, url) that is one, if there is any."""
    tab = tabs.groupBy("id").agg(F.max_by("url", "seq").alias("tab"))
    land = ads.select("id", "landing")
    fit = lambda rows: rows.where(valid(F.col("url"))).join(land, "id").where(F.col("url") != F.col("landing"))
    answered = fit(responses.where("status = 200")).groupBy("id").agg(F.max_by("url", "seq").alias("answer"))
    fixed = fit(chain).groupBy("id").agg(F.max_by("url", "seq").alias("fixed"))
    rows = ads.join(tab, "id", "left").join(answered, "id", "left").join(fixed, "id", "left")
    moved = F.when(F.col("page") != F.col("landing"), F.col("page"))
    first = F.coalesce("tab", moved)
    choice = F.when(first.isNotNull() & (first != F.col("landing")), first).otherwise(F.coalesce("answer", first))
    return rows.select("id", F.when(valid(choice), choice).otherwise(F.coalesce("fixed", choice)).alias("url"))


def resolved(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, final) of the distinct urls(url) that are tracking redirects and lead elsewhere."""
    redirects = urls.where(O.contains_any(F.lower("url"), R.TRACKING_REDIRECTS)).select("url").distinct()
    return H.follow(edges, redirects, 10).where("hops > 0").select("url", "final")


def repair_fields(ads: DataFrame, key: str, fields: list[str], edges: DataFrame) -> DataFrame:
    """(key, field, old_value, new_value) of the fields whose URL is a tracking redirect that leads
    elsewhere: what would be changed. All fields are resolved in one pass."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in fields))
    rows = ads.select(key, F.inline(cells))
    done = resolved(rows.select("url"), edges)
    return rows.join(done, "url").select(key, "field", F.col("url").alias("old_value"), F.col("final").alias("new_value")).where("old_value <> new_value")


def redetect(ads: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, network, tracker, landing) of the ads(id, landing) where redirects lead to a known
    network or tool. The landing URL is replaced where the new one is longer by over 10
    characters or the old one is an ad server's."""
    ends = H.follow(edges, ads.select(F.col("landing").alias("url")), 15).select(F.col("url").alias("landing"), "final")
    rows = ads.select("id", "landing").join(ends, "landing")
    rows = rows.withColumn("network", O.affiliate_network(F.col("final"))["network"]).withColumn("tracker", O.tracking_tool(F.col("final")))
    longer = (F.length("final") > F.length("landing") + 10) | F.col("landing").contains("mgid") | F.col("landing").contains("outbrain")
    return rows.where("network IS NOT NULL OR tracker IS NOT NULL").select("id", "network", "tracker", F.when(longer, F.col("final")).otherwise(F.col("landing")).alias("landing"))


STEALTH = ["smeagol", "revcontent", "healthheadlines", "healthtrending"]


def canonical(ads: DataFrame, key: str, url: str, edges: DataFrame) -> DataFrame:
    """(key, canonical): the URL to store: redirects resolved, except on hosts that hide behind
    them, then without tracking parameters. What doesn't start with http stays."""
    rows = ads.select(key, F.col(url).alias("url"))
    hidden = O.contains_any(F.col("url"), STEALTH) & O.contains_any(F.col("url"), ["index.php", "lp", "?"])
    done = resolved(rows.where(~hidden).select("url"), edges)
    last = F.coalesce(F.when(~hidden, F.col("final")), F.col("url"))
    return rows.join(done, "url", "left").select(key, F.when(F.col("url").startswith("http"), U.strip_tracking(last)).otherwise(F.col("url")).alias("canonical"))


def certain_offer(offer: Column, landing: Column, final: Column, healthy: Column) -> Column:
    """The offer where it is valid, healthy and another URL than the landing and final ones; else
    null: nothing is guessed."""
    other = F.coalesce(offer != landing, F.lit(True)) & F.coalesce(offer != final, F.lit(True))
    return F.when(valid(offer) & F.coalesce(healthy, F.lit(False)) & other, offer)


def bot_challenge(title: Column, url: Column) -> Column:
    """Whether a page only asks whether its reader is a person."""
    return O.contains_any(title, ["Cloudflare", "Just a moment"]) | F.coalesce(url.contains("challenges.cloudflare.com"), F.lit(False))


def with_reason(reason: Column, test: Column, text: str) -> Column:
    """reason with a further one, parted by |, where test holds."""
    return F.when(test, F.concat_ws(" | ", F.nullif(reason, F.lit("")), F.lit(text))).otherwise(reason)


def deep_article(url: Column) -> Column:
    """Whether a page is an article already: long and with dashes, or dated, and no section."""
    named = ((F.length(url) > 65) & url.contains("-")) | O.contains_any(url, ["-2024", "-2025", "-2026"])
    return F.coalesce(named & ~O.ends_with_any(url, ["/", "/world", "/news"]), F.lit(False))


NOISY_CHAINS = ["taboola_hm", "rubiconproject", "gdpr_consent", "deepintent"]


def work_queue(ads: DataFrame, mode: str = "new", network: str | None = None, limit: int = 10) -> DataFrame:
    """The first `limit` ads, by day and id, that a mode takes: `new` those never analysed, of
    unknown type and not flagged; `arbitrage` all arbitrage ads; `affiliate` affiliate ads with
    ad-tech noise in their chain. ads: ad_type, analysed_at, needs_review, chain, network."""
    tests = {
        "new": F.col("analysed_at").isNull() & F.coalesce(F.col("ad_type") == "Unknown", F.lit(True)) & ~F.coalesce("needs_review", F.lit(False)),
        "arbitrage": F.col("ad_type") == "Arbitrage",
        "affiliate": (F.col("ad_type") == "Affiliate") & O.contains_any(F.lower("chain"), NOISY_CHAINS),
    }
    rows = ads.where(tests[mode])
    rows = rows if network is None else rows.where(F.col("network") == network)
    return rows.orderBy("created_day", "id").limit(limit)
