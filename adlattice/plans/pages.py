"""Queries on stored pages: public suffixes, weighted signals, tokens of the markup, the
cascade of verdicts and what follows from them, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import domains as D
from ..operators import rules as O
from ..operators import score as S
from ..operators import signals as SG
from ..rules import signals as RS
from ..rules import tables as R
from ..sources import html as G
from . import base as B
from .composed import of, sub
from .jobs import ABS, QUERIES as JOBS
from .jobs import query

QUERIES = JOBS

# ---- public suffixes ----

_HOSTED = f"concat('https://', {B.pick(['a.b.co.uk', 'co.uk', 'www.ck', 'a.www.ck', 'x.y.ck', 'y.ck', 'www.shop.com.au', 'a.b.example.com', 'localhost', '10.0.0.7', 'x.kyoto.jp', 'news.or.jp', 'b.a.gov.bd', 'independent.co.uk'], 'id')}, ':80/p', id)"
_SUFFIX_ROWS = ", ".join(f"({B.q(n.lstrip('!') + '.' + top if n != '*' else top)}, {(1 if n != '*' else 0) + 1 + (n == '*') - (n[0] == '!')}, {str(n[0] == '!').lower()})" for top, names in R.SUFFIXES.items() for n in names)


@query("b03_registered_domain", f"""s(suffix, n, own) AS (VALUES {_SUFFIX_ROWS}), u AS (SELECT id, 'landing' AS field, {B.host('landing')} AS h FROM ads UNION ALL SELECT id, 'listed', {B.host(f'({_HOSTED})')} FROM ads),
 m AS (SELECT u.id, field, h, string_split(h, '.') AS parts, max(CASE WHEN s.own THEN 1000 + s.n ELSE s.n END) AS top FROM u LEFT JOIN s ON (h = s.suffix OR ends_with(h, '.' || s.suffix)) AND NOT regexp_matches(h, '^[0-9.]*$') GROUP BY u.id, field, h),
 t AS (SELECT *, coalesce(top % 1000, 1) + 1 AS take FROM m) SELECT id, field, CASE WHEN regexp_matches(h, '^[0-9.]*$') OR len(parts) < take THEN h ELSE array_to_string(parts[len(parts) - take + 1:], '.') END AS domain FROM t""")
def _(s, d):
    rows = B.ads(s, d).select("id", F.inline(F.array(F.struct(F.lit("landing").alias("field"), F.col("landing").alias("u")), F.struct(F.lit("listed").alias("field"), F.expr(_HOSTED).alias("u")))))
    keyed = rows.select(F.struct("id", "field").alias("k"), "u")
    return D.registered_domains(keyed, "k", F.col("u"), D.suffix_table(s)).select("k.id", "k.field", "domain")


# ---- weighted signals, over pages that hold them ----


def _paged(s, d):
    return B.table(s, d, "pages").selectExpr("page_id AS id", f"{B.PAGE} AS page", f"{B.PAGED.split(' AS page, ')[1].rsplit(' AS link', 1)[0]} AS link")


_FIELDS_SQL = {"title": B.title("page"), "head": f"substring({B.text('page')}, 1, 500)", "body": B.text("page"), "html": "page", "url": "link"}


def _fields() -> dict:
    page = F.col("page")
    return {"body": G.visible_text(page), "html": page, "url": F.col("link")}


def _sql(*names: str) -> dict[str, str]:
    return {n: _FIELDS_SQL[n] for n in names}


_BEST = "b AS (SELECT id, max(score) AS score, arg_min({'kind': kind, 'signals': signals}, ord - score * 1000) AS top, string_agg(concat(kind, '=', score), ',' ORDER BY kind) AS all_scores FROM k GROUP BY id)"


@query("f06_offer_type", f"""WITH {B.PAGED}, {B.kinds(RS.OFFER_TYPES, _sql('body', 'html', 'url'), 'p')}, {_BEST}
 SELECT p.id, CASE WHEN score >= 3 THEN top.kind ELSE 'Unknown' END AS best, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence, coalesce(score, 0) AS score,
 coalesce(all_scores, '') AS all_scores, CASE WHEN score >= 3 THEN array_to_string(top.signals[1:5], ',') ELSE '' END AS top_signals FROM p LEFT JOIN b ON b.id = p.id""", ads=False)
def _(s, d):
    found = SG.best_kind(_paged(s, d), "id", _fields(), SG.table(s, RS.OFFER_TYPES))
    text = F.array_join(F.transform(F.map_entries("all_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("id", "best", "confidence", "score", text.alias("all_scores"), F.array_join("top_signals", ",").alias("top_signals"))


def _wide(kinds: list[str]) -> str:
    cells = ", ".join(f"coalesce(max(score) FILTER (kind = '{k}'), 0) AS {k}_score, coalesce(max(signals) FILTER (kind = '{k}'), []) AS {k}_signals" for k in kinds)
    return f"w AS (SELECT p.id, {cells} FROM p LEFT JOIN k ON k.id = p.id GROUP BY p.id)"


@query("f05_page_validity", f"""WITH {B.PAGED}, {B.kinds(RS.VALIDITY, _sql('title', 'head', 'body', 'html'), 'p')}, {_wide(['tracking', 'offer', 'arbitrage'])},
 c AS (SELECT w.*, length({B.text('page')}) AS body_length, contains(lower(page), 'name="description"') OR contains(lower(page), 'property="og:description"') OR contains(lower(page), 'property="og:title"') AS has_meta FROM w JOIN p ON p.id = w.id),
 z AS (SELECT *, CASE WHEN tracking_score > 0 THEN 'tracking_redirect_page' WHEN body_length < 400 THEN 'thin_content' WHEN arbitrage_score >= 5 THEN 'arbitrage_page' END AS reason FROM c)
 SELECT id, reason IS NULL AS valid, reason, tracking_signals[1] AS matched_signal, offer_score, array_to_string(offer_signals[1:5], ',') AS offer_signals, arbitrage_score, has_meta, body_length FROM z""", ads=False)
def _(s, d):
    page = F.col("page")
    found = SG.page_validity(_paged(s, d), "id", G.title(page), G.visible_text(page), page, SG.table(s, RS.VALIDITY))
    return found.withColumn("offer_signals", F.array_join("offer_signals", ",")).withColumn("body_length", F.col("body_length").cast("long"))


_MARKED = f"{B.kinds(RS.FINGERPRINTS, _sql('html'), 'p')}"


@query("d09_ad_networks", f"""WITH {B.PAGED}, {_MARKED}, b AS (SELECT id, list({{'n': -score, 'ord': ord, 'kind': kind, 'signals': signals}} ORDER BY score DESC, ord) AS l FROM k GROUP BY id)
 SELECT p.id, l[1].kind AS network, coalesce(-l[1].n, 0) AS n, array_to_string(l[1].signals[1:3], ',') AS matches, coalesce(array_to_string(list_transform(l, lambda x: x.kind), ','), '') AS networks FROM p LEFT JOIN b ON b.id = p.id""", ads=False)
def _(s, d):
    found = SG.fingerprints(_paged(s, d), "id", F.col("page"), SG.table(s, RS.FINGERPRINTS))
    return found.withColumn("matches", F.array_join("matches", ",")).withColumn("networks", F.array_join("networks", ","))


@query("f03_arbitrage_url", f"""WITH {B.PAGED}, f AS (SELECT * FROM (WITH {_MARKED} SELECT DISTINCT id FROM k)), {B.kinds(RS.ARBITRAGE, _sql('html', 'url'), 'p')}, {_wide(['url', 'content'])}
 SELECT w.id, f.id IS NOT NULL AS arbitrage, CASE WHEN f.id IS NOT NULL THEN url_score + content_score ELSE 0 END AS score, CASE WHEN f.id IS NOT NULL THEN array_to_string(list_concat(url_signals, content_signals), ',') ELSE '' END AS signals FROM w LEFT JOIN f ON f.id = w.id""", ads=False)
def _(s, d):
    found = SG.arbitrage(_paged(s, d), "id", F.col("link"), F.col("page"), SG.table(s, RS.FINGERPRINTS), SG.table(s, RS.ARBITRAGE))
    return found.withColumn("signals", F.array_join("signals", ","))


@query("f13_offer_validation", f"SELECT h.id, coalesce(CASE WHEN h.health <> 'ok' THEN h.health END, v.reason, 'valid') AS verdict, CASE WHEN h.health = 'ok' AND v.valid THEN o.best END AS offer_type, CASE WHEN h.health = 'ok' AND v.valid THEN o.confidence END AS confidence, CASE WHEN h.health = 'ok' THEN v.offer_score END AS offer_score FROM {sub('f11_fetch_health')} h JOIN ({QUERIES['f05_page_validity'][1]}) v ON v.id = h.id JOIN ({QUERIES['f06_offer_type'][1]}) o ON o.id = h.id", ads=False)
def _(s, d):
    rows = of("f11_fetch_health", s, d).join(of("f05_page_validity", s, d), "id").join(of("f06_offer_type", s, d).select("id", "best", "confidence"), "id")
    healthy = F.col("health") == "ok"
    verdict = F.coalesce(F.when(~healthy, F.col("health")), F.col("reason"), F.lit("valid"))
    fine = healthy & F.col("valid")
    return rows.select("id", verdict.alias("verdict"), F.when(fine, F.col("best")).alias("offer_type"), F.when(fine, F.col("confidence")).alias("confidence"), F.when(healthy, F.col("offer_score")).alias("offer_score"))


# ---- tokens of the markup ----

_NAMES = ["google_ad", "google_ads", "adsbygoogle", "my-taboola", "outbrain", "revcontent", "mgid", "contentad", "ad-container", "sponsored-content", "ad_slot", "dfp-ad", "advertisement", "ad-x", "x-ad", "banner-ad", "adx-1", "ads-box", "zergnet", "rc-widget", "plain", "add", "shade", "next-page", "pagination", "slideshow-nav", "dfp"]
#: A page with an element that names what its id and class are, quoted in both ways, and repeated.
_LAID = f"""concat('<noscript><div class="adsbygoogle"></div></noscript><script>"<div class=taboola>"</script>', html, repeat(concat('<div data-id="taboola" ID=', chr(39), {B.pick(_NAMES, 'page_id')}, chr(39), ' title="a > b" class="Big  ', {B.pick(_NAMES, '(page_id * 5 + 1)')}, '"><li class=', {B.pick(_NAMES, '(page_id * 3 + 2)')}, '>x</li></div>'), CAST(page_id % 13 AS INT)))"""


def _tags(page: str, names: str) -> str:
    own = f"regexp_replace({page}, {B.q(G.ASIDE)}, ' ', 'g')"
    return f"list_transform(regexp_extract_all({own}, {B.q(G.tag_pattern([names], G.PLAIN_ATTRIBUTES))}, 2), lambda x: {{'id': lower({B.attribute('x', 'id')}), 'classes': lower({B.attribute('x', 'class')})}})"


@query("f07_ad_density", rf"""WITH t AS (SELECT page_id AS id, list_transform({_tags(f'({_LAID})', '|'.join(G.BLOCKS))}, lambda y: concat(y.id, ' ', array_to_string(list_filter(regexp_split_to_array(y.classes, '\s+'), lambda c: c <> ''), ' '))) AS names FROM pages),
 a AS (SELECT id, len(names) AS blocks, list_filter(names, lambda n: trim(n) <> '' AND regexp_matches(n, {B.q('|'.join(R.AD_IDENTIFIERS))})) AS ads FROM t), u AS (SELECT id, first(n ORDER BY i) AS n, min(i) AS i FROM (SELECT id, unnest(ads) AS n, generate_subscripts(ads, 1) AS i FROM a) GROUP BY id, n)
 SELECT a.id, blocks, len(ads) AS ads, CASE WHEN blocks > 0 THEN round(len(ads) / blocks, 4) ELSE 0.0 END AS ratio, blocks > 0 AND (len(ads) > 10 OR len(ads) * 100 > blocks * 8) AS high, coalesce(array_to_string((SELECT list(n ORDER BY i) FROM u WHERE u.id = a.id)[1:5], ';'), '') AS sample FROM a""", ads=False)
def _(s, d):
    rows = B.table(s, d, "pages").select(F.col("page_id").alias("id"), G.ad_density(F.expr(_LAID)).alias("x")).select("id", "x.*")
    return rows.withColumn("sample", F.array_join("sample", ";"))


_WAYS = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in ("contains(y.id, 'google_ads')", "{h}", "contains(y.id, 'taboola')", "contains(y.id, 'outbrain')", "contains(y.classes, 'taboola')", "contains(y.classes, 'outbrain')", "contains(y.classes, 'revcontent')", "{h}", "contains(y.classes, 'dfp')")).replace("{h}", r"list_contains(regexp_split_to_array(y.classes, '\s+'), 'adsbygoogle')")
_NUMBERED = "concat(url, CASE page_id % 5 WHEN 0 THEN '/page/3' WHEN 1 THEN '?page=2' WHEN 2 THEN '?x=1&p=9' WHEN 3 THEN '/page/x' ELSE '' END)"


@query("f08_page_structure", rf"""WITH t AS (SELECT page_id AS id, {_NUMBERED} AS u, {_LAID} AS page, {_tags(f'({_LAID})', '[a-z][a-z0-9]*')} AS ts FROM pages),
 c AS (SELECT id, u, page, len(list_filter(ts, lambda y: contains(y.classes, 'pagination') OR contains(y.classes, 'next') OR list_contains(regexp_split_to_array(y.classes, '\s+'), 'slideshow-nav'))) > 0 AS paginated, coalesce(list_sum(list_transform(ts, lambda y: {_WAYS})), 0)::BIGINT AS ad_count FROM t)
 SELECT id, paginated, coalesce(TRY_CAST(nullif(regexp_extract(lower(u), '(?:/page/|[?&](?:page|p)=)([0-9]{{1,6}})\b', 1), '') AS INTEGER), 1) AS page_number, ad_count, ad_count >= 3 AS high_density, CASE WHEN paginated THEN 'slideshow_arbitrage' WHEN ad_count >= 3 THEN 'article_arbitrage' ELSE 'unknown' END AS guess FROM c""", ads=False)
def _(s, d):
    rows = B.table(s, d, "pages").select(F.col("page_id").alias("id"), G.page_structure(F.expr(_NUMBERED), F.expr(_LAID)).alias("x"))
    return rows.select("id", "x.paginated", "x.page_number", "x.ad_count", "x.high_density", "x.guess")


@query("f09_density_override", f"SELECT ads.id, CASE WHEN ad_type <> 'Affiliate' AND d.high THEN 'Arbitrage' ELSE ad_type END AS verdict FROM ads JOIN ({QUERIES['f07_ad_density'][1]}) d ON d.id = ads.id")
def _(s, d):
    rows = B.ads(s, d).join(of("f07_ad_density", s, d).select("id", "high"), "id")
    return rows.select("id", F.when((F.col("ad_type") != "Affiliate") & F.col("high"), "Arbitrage").otherwise(F.col("ad_type")).alias("verdict"))


_CALLS = f"concat(html, '<p><a class=\"', {B.pick([*R.CTA_MARKS, 'x', 'plain link'], 'page_id')}, '\" href=/x><b>Go</b> <i>on</i></a><BUTTON id=', {B.pick(['x', *R.CTA_MARKS], 'page_id')}, '><span>', {B.pick([*R.CTA_TEXTS, 'Read', 'Order  <b>Now</b>'], 'page_id')}, '</span></BUTTON><a href=\"/y\" class=z>', {B.pick([*R.CTA_TEXTS, 'Home'], '(page_id * 2 + 1)')}, '</a>')"
_E = G.element_pattern(["a", "button"], G.PLAIN_ATTRIBUTES)


@query("c13_likely_cta", rf"""WITH o AS (SELECT page_id, regexp_replace({_CALLS}, {B.q(G.ASIDE)}, ' ', 'g') AS h FROM pages), e AS (SELECT page_id, lower(unnest(regexp_extract_all(h, {B.q(_E)}, 1))) AS name, unnest(regexp_extract_all(h, {B.q(_E)}, 2)) AS rest, unnest(regexp_extract_all(h, {B.q(_E)}, 3)) AS inn, generate_subscripts(regexp_extract_all(h, {B.q(_E)}, 1), 1) - 1 AS pos FROM o),
 x AS (SELECT page_id, pos, name, lower(concat({B.attribute('rest', 'class')}, ' ', {B.attribute('rest', 'id')})) AS marks, trim(regexp_replace(regexp_replace(inn, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM e) SELECT page_id, pos, name, text FROM x WHERE {B.any_in('marks', R.CTA_MARKS)} OR {B.any_in('lower(text)', R.CTA_TEXTS)}""", ads=False)
def _(s, d):
    rows = B.table(s, d, "pages").selectExpr("page_id", f"{_CALLS} AS html")
    return G.calls_to_action(rows).select("page_id", F.col("pos").cast("long"), "name", "text")


#: Links of a page on another host and on its own, bare and in attributes, with signatures or noise.
_LINKED = f"concat(html, '<a href=\"', CASE page_id % 4 WHEN 0 THEN '/click/1?hop=a' WHEN 1 THEN '//o.example.net/p?aff_id=2' WHEN 2 THEN 'https://cbtb.clickbank.net/?hop=x' ELSE '#a' END, '\">x</a> see https://s.', {B.pick(['shop.co.uk', 'shop.com.au', 'example.com', 'offers.io'], 'page_id')}, {B.pick(['/a?hop=1', '/checkout/?aff_id=2', '/x', '/api/?clickid=1', '/pixel?hop=2', '/b?oid=3).', '/video/?hopid=9,'], 'page_id')}, ' <script>var u=\"', {B.pick(['https://w.offers.io/order/?offer_id=1', 'https://v.offers.io/z?tid=8', 'x'], 'page_id')}, '\"</script>')"


@query("g05_affiliate_from_html", f"""o AS (SELECT id, url, {_LINKED.replace('page_id', 'id')} AS h FROM ads), l AS (SELECT id, url, list_concat(regexp_extract_all(h, {B.q(G.LINK)}, 0), list_transform(regexp_extract_all(h, {B.q(G.HREF)}, 1), lambda href: {ABS})) AS links FROM o),
 n AS (SELECT id, url, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM l), f AS (SELECT id, url, link, min(pos) AS pos FROM n GROUP BY ALL), c AS (SELECT id, url, regexp_replace(link, '[.,;)]+$', '') AS link, pos FROM f)
 SELECT id AS page_id, arg_min(link, pos + CASE WHEN {B.any_in('lower(link)', G.PRIORITY_PATHS)} THEN 0 ELSE 1000000 END) AS link FROM c WHERE {B.registered_domain('link')} <> {B.registered_domain('url')} AND {B.any_in('lower(link)', R.SIGNATURES)} AND NOT {B.any_in('lower(link)', R.API_ENDPOINTS)} AND {B.meaningful('link')} AND NOT {B.any_in('lower(link)', G.SKIPPED)} GROUP BY id""")
def _(s, d):
    return G.affiliate_links(B.table(s, d, "pages").selectExpr("page_id", "url", f"{_LINKED} AS html"))


# ---- the cascade, with all its stages ----

_LANDED = "CASE id % 9 WHEN 0 THEN 'https://www.buy.com/x' WHEN 1 THEN concat('https://amazon.com/', id) WHEN 2 THEN landing WHEN 3 THEN concat('https://news.example.org/trending/', id) WHEN 4 THEN concat('https://syndicatedsearch.goog/', id) WHEN 5 THEN concat('https://o.example.org/gallery/', id) ELSE concat('https://plain', id % 7, '.example.org/p') END"
_READ = "concat(html, CASE id % 5 WHEN 0 THEN ' Read more' WHEN 1 THEN ' buy now' WHEN 2 THEN ' next page' ELSE '' END, CASE id % 17 WHEN 3 THEN ' voluumdata' WHEN 7 THEN '/go.php?' ELSE '' END)"
_LAST = "CASE WHEN id % 5 = 0 THEN concat('https://x.example.net/offer/', id) WHEN id % 5 < 3 THEN concat('https://y.example.net/', id) ELSE final_url END"
_SCORE = B.ad_score_sql("land", "last", "page")


@query("f04_cascade", f"""n AS ({QUERIES['d09_ad_networks'][1]}), g AS ({QUERIES['f08_page_structure'][1]}), i AS {sub('e13_offer_intelligence')}, b AS (SELECT id, {_LANDED} AS land, {_LAST} AS last, {_READ} AS page FROM ads),
 j AS (SELECT b.*, CASE WHEN b.id % 4 = 0 THEN n.network END AS code, CASE WHEN b.id % 7 < 3 THEN g.paginated AND g.page_number >= 2 OR g.ad_count >= 3 ELSE false END AS shaped, CASE WHEN b.id % 2 = 0 THEN i.network END AS net, CASE WHEN b.id % 2 = 0 THEN i.affiliate_id END AS aff, CASE WHEN b.id % 2 = 0 THEN i.offer_id END AS off FROM b LEFT JOIN n ON n.id = b.id LEFT JOIN g ON g.id = b.id LEFT JOIN i ON i.id = b.id),
 v AS (SELECT *, {_SCORE} AS score, CASE WHEN {_SCORE} >= 1 THEN 'Affiliate' WHEN {_SCORE} <= -3 THEN 'Arbitrage' ELSE {B.vote_sql('page')} END AS kind FROM j),
 z AS (SELECT *, CASE WHEN regexp_replace(lower({B.part('land', 2)}), '^www\\.', '') IN ({', '.join(map(B.q, S.FORCED))}) THEN 'Knowledge' WHEN {B.any_in('lower(land)', S.STRONG_MARKERS)} OR contains(page, 'voluumdata') OR contains(page, '/go.php?') THEN 'Signal'
  WHEN code IS NOT NULL OR {B.any_in('lower(land)', ['syndicatedsearch.goog', 'google.com/afs'])} THEN 'Instant' WHEN shaped THEN '3' WHEN aff IS NOT NULL OR off IS NOT NULL OR net NOT IN ('Unknown', 'No Network Detected') THEN '4' WHEN kind = 'Affiliate' THEN '5'
  WHEN {B.any_in('lower(land)', ['trending', 'article', 'gallery'])} AND {B.any_in('lower(page)', ['next page', 'read more'])} THEN 'BridgeHeuristic' ELSE '6' END AS stage FROM v)
 SELECT id, stage, CASE stage WHEN 'Knowledge' THEN CASE WHEN contains(land, 'buy.com') THEN 'Direct Sales' ELSE 'Affiliate' END WHEN '3' THEN 'Manual Review Required' WHEN 'Instant' THEN 'Arbitrage' WHEN 'BridgeHeuristic' THEN 'Arbitrage' WHEN '6' THEN 'Unknown' ELSE 'Affiliate' END AS ad_type,
 CASE WHEN stage IN ('Knowledge', 'Signal', 'Instant', '4') THEN 'high' WHEN stage = '5' AND score >= 3 THEN 'high' WHEN stage = '6' THEN 'low' ELSE 'medium' END AS confidence,
 CASE stage WHEN 'Knowledge' THEN 'KNOWN_DOMAIN' WHEN 'Signal' THEN 'STRONG_AFFILIATE_SIGNAL_DETECTED' WHEN 'Instant' THEN concat('EXPLICIT_NETWORK_CODE_DETECTED: ', coalesce(code, 'Google AFD')) WHEN '3' THEN 'suspicious_structure_no_ad_code' WHEN '4' THEN concat('known_aff_signature_in_chain: ', coalesce(net, 'Unknown'))
  WHEN '5' THEN concat('scoring_system: ', score) WHEN 'BridgeHeuristic' THEN 'URL_PATH_AND_PAGINATION_MATCH' ELSE 'no_conclusive_signals' END AS reason, stage IN ('Instant', 'BridgeHeuristic') AS skip FROM z""")
def _(s, d):
    networks = of("d09_ad_networks", s, d).select("id", F.when((F.col("id") % 4 == 0) & (F.col("networks") != ""), F.split("networks", ",")).otherwise(F.array().cast("array<string>")).alias("networks"))
    shape = of("f08_page_structure", s, d)
    bare = F.struct(F.lit(False).alias("paginated"), F.lit(1).alias("page_number"), F.lit(0).cast("long").alias("ad_count"))
    shape = shape.select("id", F.when(F.col("id") % 7 < 3, F.struct("paginated", "page_number", "ad_count")).otherwise(bare).alias("structure"))
    kept = lambda c: F.when(F.col("id") % 2 == 0, F.col(c)).alias(c)
    chain = of("e13_offer_intelligence", s, d).select("id", F.struct(kept("network"), kept("affiliate_id"), kept("offer_id")).alias("chain"))
    rows = B.ads(s, d).selectExpr("id", f"{_LANDED} AS land", f"{_LAST} AS last", f"{_READ} AS page").join(networks, "id").join(shape, "id").join(chain, "id")
    verdict = S.cascade(F.col("land"), F.col("last"), F.col("page"), F.col("networks"), F.col("structure"), F.col("chain"))
    return rows.select("id", verdict.alias("v")).select("id", "v.stage", "v.ad_type", "v.confidence", "v.reason", "v.skip")


# ---- repairs that rest on these ----

_CHAINED = f"concat(landing, ' ', final_url, ' ', {B.pick([w.upper() if i % 2 else w for i, w in enumerate(R.FALSE_POSITIVES)] + [''] * 7, 'id')})"


@query("n08_false_positives", f"""b AS (SELECT *, ad_type = 'Affiliate' AND {B.any_in(f'lower({_CHAINED})', R.FALSE_POSITIVES)} AS bad FROM ads) SELECT id, CASE WHEN bad THEN 'Arbitrage' ELSE ad_type END AS ad_type, CASE WHEN bad THEN 'high' END AS confidence, CASE WHEN bad THEN 'ad-tech noise in redirect chain' END AS reason, CASE WHEN bad THEN false ELSE id % 5 = 0 END AS needs_review,
 CASE WHEN NOT bad THEN affiliate_network END AS affiliate_network, CASE WHEN bad THEN 'No Tracker' ELSE tracker_tool END AS tracker_tool, CASE WHEN NOT bad THEN {B.first_param('landing', R.AFFILIATE_ALIASES)} END AS affiliate_id, CASE WHEN NOT bad THEN {B.first_param('landing', R.OFFER_ALIASES)} END AS offer_id, CASE WHEN bad THEN landing ELSE final_url END AS final_url FROM b""")
def _(s, d):
    rows = B.ads(s, d).withColumn("chain", F.expr(_CHAINED)).withColumn("affiliate_id", U.first_param(F.col("landing"), R.AFFILIATE_ALIASES)).withColumn("offer_id", U.first_param(F.col("landing"), R.OFFER_ALIASES))
    bad = (F.col("ad_type") == "Affiliate") & O.contains_any(F.lower("chain"), R.FALSE_POSITIVES)
    reset = {
        "ad_type": F.lit("Arbitrage"), "affiliate_network": F.lit(None).cast("string"), "tracker_tool": F.lit("No Tracker"), "affiliate_id": F.lit(None).cast("string"), "offer_id": F.lit(None).cast("string"), "final_url": F.col("landing"),
    }
    return rows.select("id", *(F.when(bad, v).otherwise(F.col(c)).alias(c) for c, v in reset.items()), F.when(bad, "high").alias("confidence"), F.when(bad, "ad-tech noise in redirect chain").alias("reason"), (~bad & (F.col("id") % 5 == 0)).alias("needs_review"))


# ---- ad cards ----

#: Cards of all networks: images inside, behind and lazy, titles inside and in the next div, short ones, and other links.
_CARD = f"""concat('<div class="item"><A HREF="', {B.pick(["https://trc.taboola.com/c?x=", "//www.mgid.com/ghits/", "/servenobid/", "https://paid.outbrain.com/n?", "https://trends.revcontent.com/click?q=", "https://plain.example.org/"], "page_id")}, page_id, '">',
 CASE page_id % 4 WHEN 0 THEN '<img alt="a > b" data-src="/lazy.jpg">' WHEN 1 THEN '<img src="https://i.example.org/x.png">' ELSE '' END, CASE page_id % 5 WHEN 0 THEN 'Short' WHEN 1 THEN '' ELSE '<b>A title that is long</b>  enough ' END, repeat('very ', CAST(page_id % 50 AS INT)), '</A>',
 CASE page_id % 3 WHEN 0 THEN '<p><img data-lazy-src="//c.example.org/b.gif"></p>' ELSE '' END, '<div id="t">The <i>next</i> division of the page</div></div>')"""
_CARDED = f"concat({_CARD}, html, {_CARD.replace('page_id', '(page_id + 3)')})"


def _source(markup: str) -> str:
    rest = f"regexp_extract({markup}, {B.q(G.PLAIN_IMAGE)}, 1)"
    return f"coalesce({', '.join(f'nullif({B.attribute(rest, n)}, {B.q(str())})' for n in ('src', 'data-src', 'data-lazy-src'))}, '')"


def _inner(markup: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({markup}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("a05_ad_cards", rf"""WITH o AS (SELECT page_id, url, regexp_split_to_array(regexp_replace({_CARDED}, {B.q(G.ASIDE)}, ' ', 'g'), '(?i)</a\s*>') AS parts FROM pages),
 i AS (SELECT *, list_transform(parts, lambda m: {_source('m')}) AS images, list_transform(parts, lambda m: {_inner(f'regexp_extract(m, {B.q(G.DIV)}, 1)')}) AS texts FROM o),
 e AS (SELECT page_id, url, images, texts, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM i),
 c AS (SELECT *, regexp_extract(part, {B.q(G.PLAIN_LAST_ANCHOR)}, 2) AS inn, {B.attribute(f'regexp_extract(part, {B.q(G.PLAIN_LAST_ANCHOR)}, 1)', 'href')} AS href FROM e WHERE k < n),
 f AS (SELECT page_id, url, k - 1 AS pos, href, {B.first_regex('lower(href)', [(p, n) for n, p in R.CARD_NETWORKS])} AS network, coalesce(nullif({_inner('inn')}, ''), list_filter(texts[k + 1:], lambda x: x <> '')[1], '') AS title, coalesce(nullif({_source('inn')}, ''), list_filter(images[k + 1:], lambda x: x <> '')[1], '') AS image FROM c WHERE href <> '')
 SELECT page_id, pos, network, {ABS} AS landing, substring(title, 1, 180) AS title, CASE WHEN image <> '' THEN {ABS.replace('href', 'image')} END AS image FROM f WHERE network IS NOT NULL AND length(title) > 15""", ads=False)
def _(s, d):
    rows = B.table(s, d, "pages").selectExpr("page_id", "url", f"{_CARDED} AS html")
    return G.ad_cards(rows).withColumn("pos", F.col("pos").cast("long"))
