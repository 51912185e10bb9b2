"""Queries of the resolution of offers, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import offers as OF
from ..operators import resolve as RS
from ..operators import rules as O
from ..rules import tables as R
from . import base as B
from .composed import of, sub
from .jobs import HOPS_SQL, QUERIES, _hops, query

#: What a fetch of a URL gave, and redirects between the ads' URLs.
_HEALTH = "h AS (SELECT DISTINCT url, length(url) % 3 <> 0 AS healthy FROM hops)"
_TRACKED = "concat('https://trkerupper.com/click?n=', id)"
_EDGES = f"e AS (SELECT DISTINCT {_TRACKED} AS f, CASE WHEN id % 4 = 0 THEN concat('https://voluumtrk.com/r/', id) ELSE final_url END AS t FROM ads UNION SELECT DISTINCT concat('https://voluumtrk.com/r/', id), final_url FROM ads WHERE id % 4 = 0 UNION SELECT DISTINCT concat('https://clck.mgid.com/ghits/', id), url FROM ads)"
#: The end of each tracked URL, after one or two hops.
_ENDS = f"ends AS (SELECT {_TRACKED} AS u, final_url AS final FROM ads UNION ALL SELECT concat('https://voluumtrk.com/r/', id), final_url FROM ads WHERE id % 4 = 0 UNION ALL SELECT concat('https://clck.mgid.com/ghits/', id), url FROM ads)"


def _health(hops: DataFrame) -> DataFrame:
    return hops.select("url", (F.length("url") % 3 != 0).alias("healthy")).distinct()


def _edges(a: DataFrame) -> DataFrame:
    tracked, hub = F.expr(_TRACKED), F.expr("concat('https://voluumtrk.com/r/', id)")
    rows = a.select(tracked.alias("from_url"), F.when(F.col("id") % 4 == 0, hub).otherwise(F.col("final_url")).alias("to_url"))
    rows = rows.unionByName(a.where("id % 4 = 0").select(hub.alias("from_url"), F.col("final_url").alias("to_url")))
    return rows.unionByName(a.select(F.expr("concat('https://clck.mgid.com/ghits/', id)").alias("from_url"), F.col("url").alias("to_url")))


_GOOD = f"g AS (SELECT id, arg_max(hops.url, hop) AS url FROM hops JOIN h ON h.url = hops.url AND h.healthy WHERE {B.reject_reason('hops.url')} IS NULL GROUP BY id)"
_VIA = f"v AS (SELECT ads.id, url FROM ads WHERE id % 3 = 0 AND {B.reject_reason('url')} IS NULL AND length(url) % 3 <> 0)"


@query("h05_validate_fallback", f"{HOPS_SQL}, {_HEALTH}, {_GOOD}, {_VIA} SELECT ads.id, CASE WHEN ads.id % 2 = 0 AND {B.reject_reason('ads.final_url')} IS NULL AND length(final_url) % 3 <> 0 THEN ads.final_url WHEN ads.id % 3 <> 0 THEN g.url ELSE v.url END AS offer FROM ads LEFT JOIN g ON g.id = ads.id LEFT JOIN v ON v.id = ads.id")
def _(s, d):
    a, hops = B.ads(s, d), _hops(s, d)
    offers = a.select("id", F.when(F.col("id") % 2 == 0, F.col("final_url")).alias("url"))
    # every third ad has captured an ad server's link only
    captured = hops.where("id % 3 <> 0").select("id", F.col("hop").alias("seq"), "url")
    captured = captured.unionByName(a.where("id % 3 = 0").select("id", F.lit(0).alias("seq"), F.expr("concat('https://clck.mgid.com/ghits/', id)").alias("url")))
    return RS.validated(offers, captured, _health(hops), _edges(a)).select("id", F.col("url").alias("offer"))


_CANDIDATES = {0: "CASE WHEN id % 7 = 0 THEN final_url END", 1: "CASE WHEN id % 5 = 0 THEN url END", 2: "CASE WHEN id % 4 = 1 THEN final_url END", 3: "CASE WHEN id % 6 = 1 THEN landing END", 5: "CASE WHEN id % 2 = 0 THEN landing END"}


@query("h13_layered", f"""{HOPS_SQL}, {_HEALTH}, {_GOOD}, c AS ({' UNION ALL '.join(f'SELECT id, {n} AS layer, {c} AS url FROM ads' for n, c in _CANDIDATES.items())}),
 f AS (SELECT id, layer, 0 AS late, url FROM c WHERE url IS NOT NULL AND {B.reject_reason('url')} IS NULL AND length(url) % 3 <> 0 UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 5 ELSE 6 END, 1, url FROM g WHERE id % 11 <> 0),
 b AS (SELECT id, arg_min(url, layer * 2 + late) AS url, min(layer * 2 + late) // 2 AS layer FROM f GROUP BY id)
 SELECT ads.id, b.url, CASE b.layer {' '.join(f"WHEN {n} THEN '{m}'" for n, m in RS.LAYERS.items())} ELSE 'failed' END AS method, coalesce(b.layer, 6)::INTEGER AS layers_tried FROM ads LEFT JOIN b ON b.id = ads.id""")
def _(s, d):
    a, hops = B.ads(s, d), _hops(s, d)
    candidates = a.select("id", F.inline(F.array(*(F.struct(F.lit(n).alias("layer"), F.expr(c).alias("url")) for n, c in _CANDIDATES.items()))))
    return RS.layered(a, candidates, hops.where("id % 11 <> 0").select("id", F.col("hop").alias("seq"), "url"), _health(hops))


_TYPED = "split_part('document|xhr|image|sub_document|fetch', '|', CAST((id + hop * 2) % 5 AS INT) + 1)"
_ASKED = "concat(url, CASE (id + hop) % 7 WHEN 0 THEN '&x=clck.y' WHEN 1 THEN '/a.JPG' WHEN 2 THEN '?z=Activeview' ELSE '' END)"
_FIT = f"starts_with(u, 'http') AND length(u) > 25 AND contains({B.part('u', 2)}, '.') AND NOT {B.any_in('lower(u)', RS.REQUEST_NOISE)}"


@query("h17_landing_from_requests", f"""{HOPS_SQL}, q AS (SELECT id, hop, {_TYPED} AS type, {_ASKED} AS u FROM hops), l AS (SELECT id, arg_max(u, hop) AS last FROM q WHERE type IN ('document', 'xhr', 'fetch') AND {_FIT} AND NOT {B.any_in('lower(u)', RS.RESOURCES)} GROUP BY id),
 f AS (SELECT id, arg_min(u, hop) AS first FROM q WHERE type IN ('document', 'sub_document') AND {_FIT} GROUP BY id) SELECT coalesce(l.id, f.id) AS id, last, first FROM l FULL JOIN f ON f.id = l.id""")
def _(s, d):
    requests = _hops(s, d).select(F.col("id").alias("target"), F.col("hop").alias("seq"), F.expr(_TYPED).alias("type"), F.expr(_ASKED).alias("url"))
    last, first = RS.landing_of_requests(requests), RS.landing_of_requests(requests, first=True)
    return last.withColumnRenamed("url", "last").join(first.withColumnRenamed("url", "first"), "target", "full").withColumnRenamed("target", "id")


_ANSWERED = "CASE WHEN (id + hop) % 6 = 0 THEN concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'Affiliate=', id) ELSE url END"


@query("h18_foreign_responses", f"""{HOPS_SQL}, q AS (SELECT id, {_ANSWERED} AS u, min(hop) AS hop FROM hops GROUP BY ALL), r AS (SELECT q.*, {B.meaningful('u')} AND NOT contains(u, {B.registered_domain('ads.url')}) AS far, {B.any_in('lower(u)', RS.BACKGROUND)} AS asked FROM q JOIN ads ON ads.id = q.id)
 SELECT id, coalesce(string_agg(u, ' ' ORDER BY hop) FILTER (far), '') AS responses, coalesce(string_agg(u, ' ' ORDER BY hop) FILTER (asked), '') AS offers FROM r WHERE far OR asked GROUP BY id""")
def _(s, d):
    responses = _hops(s, d).select("id", F.col("hop").alias("seq"), F.expr(_ANSWERED).alias("url"))
    found = RS.foreign_responses(B.ads(s, d).select("id", "url"), responses)
    return found.select("id", F.array_join("responses", " ").alias("responses"), F.array_join("offers", " ").alias("offers"))


_PAGE = "CASE WHEN id % 3 = 0 THEN landing ELSE url END"


@query("h19_final_choice", f"""{HOPS_SQL}, w AS (SELECT id, arg_max(url, hop) AS answer FROM (SELECT h.*, a.landing FROM hops h JOIN ads a ON a.id = h.id) WHERE (id + hop) % 3 <> 0 AND url <> landing AND {B.reject_reason('url')} IS NULL GROUP BY id), x AS (SELECT id, arg_max(url, hop) AS fixed FROM (SELECT h.*, a.landing FROM hops h JOIN ads a ON a.id = h.id) WHERE url <> landing AND {B.reject_reason('url')} IS NULL GROUP BY id),
 c AS (SELECT ads.id, answer, fixed, landing, coalesce(CASE WHEN ads.id % 6 < 2 THEN new_tab END, CASE WHEN {_PAGE.replace('id', 'ads.id')} <> landing THEN {_PAGE.replace('id', 'ads.id')} END) AS f FROM ads LEFT JOIN w ON w.id = ads.id LEFT JOIN x ON x.id = ads.id), k AS (SELECT *, CASE WHEN f IS NOT NULL AND f <> landing THEN f ELSE coalesce(answer, f) END AS choice FROM c)
 SELECT id, CASE WHEN choice IS NOT NULL AND {B.reject_reason('choice')} IS NULL THEN choice ELSE coalesce(fixed, choice) END AS choice FROM k""")
def _(s, d):
    a, hops = B.ads(s, d), _hops(s, d).withColumnRenamed("hop", "seq")
    tabs = a.where("id % 6 < 2 AND new_tab IS NOT NULL").select("id", F.lit(0).alias("seq"), F.col("new_tab").alias("url"))
    responses = hops.withColumn("status", F.when((F.col("id") + F.col("seq")) % 3 == 0, 404).otherwise(200))
    return RS.final_choice(a.select("id", "landing", F.expr(_PAGE).alias("page")), tabs, responses, hops).select("id", F.col("url").alias("choice"))


_LANDS = f"CASE id % 5 WHEN 0 THEN {_TRACKED} WHEN 1 THEN concat('https://clck.mgid.com/ghits/', id) WHEN 2 THEN concat('https://voluumtrk.com/r/', id) ELSE landing END"
_OFFERED = f"CASE id % 3 WHEN 0 THEN {_TRACKED} ELSE final_url END"


@query("n10_repair_urls", f"""{_ENDS}, c AS (SELECT id, 'landing' AS field, {_LANDS} AS old_value FROM ads UNION ALL SELECT id, 'final_url', {_OFFERED} FROM ads) SELECT c.id, field, old_value, ends.final AS new_value FROM c JOIN ends ON ends.u = c.old_value WHERE {B.any_in('lower(old_value)', R.TRACKING_REDIRECTS)} AND old_value <> final""")
def _(s, d):
    a = B.ads(s, d)
    return RS.repair_fields(a.select("id", F.expr(_LANDS).alias("landing"), F.expr(_OFFERED).alias("final_url")), "id", ["landing", "final_url"], _edges(a))


@query("n11_redetect", f"""{_ENDS}, c AS (SELECT id, {_LANDS} AS land FROM ads), f AS (SELECT c.*, coalesce(ends.final, land) AS final FROM c LEFT JOIN ends ON ends.u = land), r AS (SELECT *, {B.affiliate_network('final')} AS network, {B.tracking_tool('final')} AS tracker FROM f)
 SELECT id, network, tracker, CASE WHEN length(final) > length(land) + 10 OR contains(land, 'mgid') OR contains(land, 'outbrain') THEN final ELSE land END AS landing FROM r WHERE network IS NOT NULL OR tracker IS NOT NULL""")
def _(s, d):
    a = B.ads(s, d)
    return RS.redetect(a.select("id", F.expr(_LANDS).alias("landing")), _edges(a))


_STORED = f"CASE id % 6 WHEN 0 THEN {_TRACKED} WHEN 1 THEN concat('https://trkerupper.com/click?n=', id - 1, '&x=smeagol') WHEN 2 THEN concat('ftp://trkerupper.com/', id) ELSE landing END"


@query("b17_canonical", f"""{_ENDS}, c AS (SELECT id, {_STORED} AS land FROM ads), f AS (SELECT c.id, land, coalesce(CASE WHEN {B.any_in('lower(land)', R.TRACKING_REDIRECTS)} THEN ends.final END, land) AS landing FROM c LEFT JOIN ends ON ends.u = land)
 SELECT id, CASE WHEN starts_with(land, 'http') THEN {B.stripped('landing')} ELSE land END AS canonical FROM f""")
def _(s, d):
    a = B.ads(s, d)
    return RS.canonical(a.select("id", F.expr(_STORED).alias("landing")), "id", "landing", _edges(a))


@query("f12_certainty", f"SELECT a.id, CASE WHEN {B.reject_reason('a.final_url')} IS NULL AND h.health = 'ok' AND a.final_url <> a.landing AND a.final_url <> a.url THEN a.final_url END AS offer FROM ads a JOIN {sub('f11_fetch_health')} h ON h.id = a.id")
def _(s, d):
    rows = B.ads(s, d).join(of("f11_fetch_health", s, d).select("id", "health"), "id")
    return rows.select("id", RS.certain_offer(F.col("final_url"), F.col("landing"), F.col("url"), F.col("health") == "ok").alias("offer"))


_TITLE = B.pick(["Just a moment...", "Attention: Cloudflare", "A page", "just a moment"], "id")
_SEEN = "CASE WHEN id % 7 = 0 THEN concat('https://challenges.cloudflare.com/', id) ELSE final_url END"
_GIVEN = "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no_conclusive_signals' END"


@query("c17_bot_challenge", f"SELECT id, id % 4 < 2 OR id % 7 = 0 OR contains(final_url, 'challenges.cloudflare.com') AS challenge, CASE WHEN id % 4 < 2 OR id % 7 = 0 OR contains(final_url, 'challenges.cloudflare.com') THEN concat_ws(' | ', nullif({_GIVEN}, ''), 'BOT_CHALLENGE_DETECTED') ELSE {_GIVEN} END AS reason, {B.any_in('lower(html)', R.CHALLENGES)} AS own FROM ads")
def _(s, d):
    test = RS.bot_challenge(F.expr(_TITLE), F.expr(_SEEN))
    return B.ads(s, d).select("id", test.alias("challenge"), RS.with_reason(F.expr(_GIVEN), test, "BOT_CHALLENGE_DETECTED").alias("reason"), O.contains_any(F.lower("html"), R.CHALLENGES).alias("own"))


_ARTICLE = "concat(url, CASE id % 6 WHEN 0 THEN '/x-2025-y' WHEN 1 THEN '/a-very-long-title-of-an-article-that-is-told-in-many-words-here' WHEN 2 THEN '/x-2026-y/news' WHEN 3 THEN '/x-2024/' WHEN 4 THEN '/2025/x' ELSE '/world' END)"


@query("c19_deep_article", f"SELECT id, ((length({_ARTICLE}) > 65 AND contains({_ARTICLE}, '-')) OR {B.any_in(_ARTICLE, ['-2024', '-2025', '-2026'])}) AND NOT {B.any_end(_ARTICLE, ['/', '/world', '/news'])} AS deep FROM ads")
def _(s, d):
    return B.ads(s, d).select("id", RS.deep_article(F.expr(_ARTICLE)).alias("deep"))


@query("d15_traffic_source", f"SELECT id, coalesce(CASE WHEN id % 9 = 0 THEN concat('Source ', id % 2) END, {B.traffic_source('landing')}) AS source FROM ads")
def _(s, d):
    decoded = F.when(F.col("id") % 9 == 0, F.concat(F.lit("Source "), (F.col("id") % 2).cast("string")))
    return B.ads(s, d).select("id", OF.traffic_source(F.col("landing"), decoded).alias("source"))


_QUEUED = "id, network, created_day, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE ad_type END AS ad_type, CASE WHEN id % 3 = 0 THEN created_day END AS analysed_at, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS needs_review, concat(landing, CASE WHEN id % 2 = 0 THEN '&Taboola_hm=1' ELSE '' END) AS chain"
_MODES = {
    ("new", None): "analysed_at IS NULL AND coalesce(ad_type = 'Unknown', true) AND NOT coalesce(needs_review, false)", ("new", "MGID"): "analysed_at IS NULL AND coalesce(ad_type = 'Unknown', true) AND NOT coalesce(needs_review, false) AND network = 'MGID'",
    ("arbitrage", None): "ad_type = 'Arbitrage'", ("affiliate", "Outbrain"): f"ad_type = 'Affiliate' AND {B.any_in('lower(chain)', RS.NOISY_CHAINS)} AND network = 'Outbrain'",
}


@query("n13_work_queue", f"q AS (SELECT {_QUEUED} FROM ads) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}-{n or 'all'}' AS mode, id FROM q WHERE {t} ORDER BY created_day, id LIMIT 25)" for (m, n), t in _MODES.items()))
def _(s, d):
    rows = B.ads(s, d).selectExpr(*_split(_QUEUED))
    parts = [RS.work_queue(rows, m, n, 25).select(F.lit(f"{m}-{n or 'all'}").alias("mode"), "id") for m, n in _MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _split(columns: str) -> list[str]:
    """The expressions of a select list; commas in brackets and quotes don't part them."""
    out, depth, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


_DATA = """concat('{"offer":"https://deep.example.net/o?url=https%3A%2F%2Fend.example.org%2F', id, '"}')"""


@query("b12_peel", f"""n AS (SELECT id, u3 AS own FROM ({B.peel('landing')})) SELECT n.id, own, CASE n.id % 3 WHEN 0 THEN concat('https://end.example.org/', n.id) WHEN 1 THEN concat('https://x.example.net/p?dest=ftp://a&n=', n.id) ELSE own END AS target FROM n""")
def _(s, d):
    coded = F.regexp_replace(F.regexp_replace(F.base64(F.expr(_DATA).cast("binary")), "=+$", ""), r"\s", "")
    hidden = F.concat(F.lit("https://t.example.com/c?url=https%3A%2F%2Fwrong.example.com&voluumdata="), coded, F.lit("&x=1"))
    carried = F.when(F.col("id") % 3 == 0, hidden).when(F.col("id") % 3 == 1, F.expr("concat('https://x.example.net/p?dest=ftp://a&n=', id)")).otherwise(F.col("landing"))
    return B.ads(s, d).select("id", U.peel(F.col("landing")).alias("own"), U.peel(carried).alias("target"))
