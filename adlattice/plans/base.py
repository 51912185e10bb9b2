"""The ad table that queries run on, derived from pages, and SQL twins of the column
functions. Both sides derive it by the same expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.url import SPLIT, suffix_patterns
from ..operators.score import SCORED
from ..rules import signals as RS
from ..rules import tables as R
from ..sources import html as G

#: Hosts and parameters that the rules name, so that the queries meet all of them.
_HOSTS = [h for hosts in (R.STRICT_BLOCK, R.AD_TECH_HOSTS, R.INTERMEDIARIES, R.INVALID_HOSTS, R.PRELANDERS, R.PUBLISHERS, R.SKIP_SITES, [h for h, _ in R.KNOWN_OFFERS], ["rt.redtrack.io", "binom.example", "leadbit.com", "advidi.com"]) for h in hosts if "/" not in h and not h.endswith(".")]
_PARAMS = sorted({*R.AFFILIATE_ALIASES, *R.OFFER_ALIASES, *R.SUB_ALIASES, *R.CLICK_ALIASES, *R.TARGET_PARAMS, *(n for names in R.SECOND_ALIASES.values() for n in names), *(p for *_, ps, _ in R.NETWORK_LADDER for p in ps), "pixel", *R.WIDGET_PARAMS.values()})
#: Column expressions in the common subset of both SQL dialects.
ADS = {
    "id": "page_id",
    "url": "url",
    "html": "html",
    "landing": """CASE page_id % 14
 WHEN 0 THEN concat('https://aff', page_id % 5, '.shop', page_id % 7, '.hop.clickbank.net/?hop=aff', page_id % 5, '&hopId=h', page_id, '&utm_source=x')
 WHEN 1 THEN concat('https://www.Offers', page_id % 3, '.example.net/video.php?aff_id=', page_id % 50, '&subid=s', page_id % 9, '&fbclid=abc&aff_id=9')
 WHEN 2 THEN concat('https://go2cloud.org/aff_c?offer_id=', page_id % 20, '&aff_id=', page_id % 11)
 WHEN 3 THEN concat('https://track.voluumtrk.com/click?cid={clickid}&cep=', page_id, '&lptoken=t', page_id % 3)
 WHEN 4 THEN concat('https://www.digistore24.com/redir/', page_id, '/x?aff=a', page_id % 4)
 WHEN 5 THEN '//cdn.example.net/static/x.js'
 WHEN 6 THEN concat('https://tr.outbrain.com/cachedClickId?url=https%3A%2F%2Fshop', page_id % 9, '.example.org%2Fbuy%3Faff_id%3D', page_id % 6)
 WHEN 8 THEN concat('https://m', page_id % 4, '.example.com/lp/?effp=', page_id, '&oid=', page_id % 8, '&affid=', page_id % 5, '&event_source_url=get', page_id % 3, '.com')
 WHEN 9 THEN concat('https://p', page_id % 4, '.sjv.io/c?irpid=', page_id % 7, '&irclickid=i', page_id, '&empty=&sub1=a+b')
 WHEN 10 THEN concat('https://health', page_id % 6, '.example.com/order?subid2=__SUB__&utm_campaign={!c!}&affid=', page_id % 5)
 WHEN 11 THEN concat('https://user@news.example.org:8080/trending/', page_id % 30, '/')
 WHEN 12 THEN concat('https://q.example.net/p?', split_part('""" + "|".join(_PARAMS) + f"""', '|', CAST(page_id % {len(_PARAMS)} AS INT) + 1), '=v', page_id, '&net=', page_id % 3 * 1673)
 WHEN 13 THEN concat('https://', split_part('""" + "|".join(_HOSTS) + f"""', '|', CAST(page_id % {len(_HOSTS)} AS INT) + 1), '/p', page_id)
 ELSE url END""",
    "final_url": """CASE page_id % 5
 WHEN 0 THEN concat('https://keto-shop', page_id % 6, '.example.net/checkout/?aff_id=', page_id % 12, '&offer_id=', page_id % 9)
 WHEN 1 THEN concat('https://', split_part('""" + "|".join(_HOSTS) + f"""', '|', CAST(page_id % {len(_HOSTS)} AS INT) + 1), split_part('/|/index|/x/y|/cards?aff_id=1|/dashboard|/v1?hop=a&vndr=evf|/REPLACE_ME|/tracking/?clickid=2|/a.gz|/b.png&c', '|', CAST(page_id % 11 AS INT) + 1))
 WHEN 2 THEN concat('https://img.example.org/p', page_id % 10, '.webp')
 WHEN 3 THEN url
 ELSE concat('https://getretinaclear.com/vsl/?aff_id=', page_id % 12) END""",
    "new_tab": "CASE page_id % 6 WHEN 0 THEN concat('https://tab', page_id % 4, '.example.net/p?oid=', page_id) WHEN 1 THEN 'https://www.facebook.com/tr?id=1' END",
    "title": "concat(CASE page_id % 6 WHEN 0 THEN 'Doctors Hate This Keto Trick ' WHEN 1 THEN ' order now   and SAVE ' WHEN 2 THEN 'Invest in crypto: ' WHEN 3 THEN 'مرحبا ' ELSE 'Trending now ' END, page_id % 40)",
    "network": "CASE page_id % 4 WHEN 0 THEN 'MGID' WHEN 1 THEN 'Taboola' WHEN 2 THEN 'Outbrain' ELSE 'Revcontent' END",
    "country_code": "CASE page_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'ES' ELSE 'MA' END",
    "language": "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'fr' ELSE 'en' END",
    "impressions": "CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id * 37 % 101 END",
    "created_day": "page_id * 13 % 60",
    "affiliate_network": "CASE page_id % 8 WHEN 0 THEN 'Direct / Unknown' WHEN 1 THEN NULL WHEN 2 THEN 'ClickBank' WHEN 3 THEN 'Everflow' ELSE 'Unknown' END",
    "tracker_tool": "CASE page_id % 6 WHEN 0 THEN 'No Tracking' WHEN 1 THEN NULL ELSE 'Voluum' END",
    "ad_type": "CASE page_id % 3 WHEN 0 THEN 'Affiliate' WHEN 1 THEN 'Arbitrage' ELSE 'Unknown' END",
}
ADS_SQL = "ads AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ADS.items()) + " FROM pages)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*(f"{e} AS {n}" for n, e in ADS.items()))


# -- DuckDB forms of the column functions --


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, {q(SPLIT)}, {n})"


def host(u: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({part(u, 2)}), '^[^@]*@|:[0-9]*$', '', 'g'), '^www\.', '')"


def registered_domain(u: str) -> str:
    h = host(u)
    return f"CASE WHEN regexp_matches({h}, '^[0-9.]+$') THEN {h} ELSE coalesce({', '.join(f'nullif(regexp_extract({h}, {q(p)}, 1), {q(str())})' for p in suffix_patterns())}, {h}) END"


def param(u: str, name: str) -> str:
    return f"nullif(url_decode(replace(regexp_extract({part(u, 4)}, {q(f'(?:^|&){re.escape(name)}=([^&]+)')}, 1), '+', ' ')), '')"


def first_param(u: str, names: list[str]) -> str:
    return f"coalesce({', '.join(param(u, n) for n in names)})"


def any_in(t: str, words: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ", false)"


def any_end(t: str, words: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"ends_with({t}, {q(w)})" for w in words) + ", false)"


def first_match(t: str, rules: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(t, ps)} THEN {q(n)}" for n, ps in rules) + " END"


def first_regex(t: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {q(n)}" for p, n in rules) + " END"


def weighted(t: str, rules: list[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({t}, {q(w)}) THEN {n} ELSE 0 END" for w, n in rules) + ")"


def host_rule(u: str, rules: dict[str, list[str]]) -> str:
    h = host(u)
    return "CASE " + " ".join("WHEN " + " OR ".join(f"{h} = {q(d)} OR ends_with({h}, {q('.' + d)})" for d in ds) + f" THEN {q(n)}" for n, ds in rules.items()) + " END"


def peel(u: str, depth: int = 3) -> str:
    """As nested lateral columns, to keep the text short."""
    steps = [f"SELECT id, {u} AS u0 FROM ads"]
    for i in range(depth):
        steps.append(f"SELECT id, CASE WHEN coalesce(starts_with({first_param(f'u{i}', R.TARGET_PARAMS)}, 'http'), false) THEN {first_param(f'u{i}', R.TARGET_PARAMS)} ELSE u{i} END AS u{i + 1} FROM ({{}})")
    sql = steps[0]
    for s in steps[1:]:
        sql = s.replace("{}", sql)
    return sql


def stripped(u: str) -> str:
    """u without tracking parameters."""
    keep, drop = (", ".join(q(x.lower()) for x in names) for names in (R.KEEP_PARAMS, R.DROP_PARAMS))
    kept = f"list_filter(string_split({part(u, 4)}, '&'), lambda p: length(p) > 0 AND (lower(split_part(p, '=', 1)) IN ({keep}) OR lower(split_part(p, '=', 1)) NOT IN ({drop})))"
    return f"concat(regexp_extract({u}, '^[^?#]*'), CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END, CASE WHEN {part(u, 5)} <> '' THEN concat('#', {part(u, 5)}) ELSE '' END)"


def traffic_source(u: str) -> str:
    return f"CASE WHEN {param(u, 'rc_uuid')} IS NOT NULL THEN 'Revcontent' WHEN {param(u, 'tblci')} IS NOT NULL THEN 'Taboola' WHEN contains({u}, 'mgid') THEN 'MGID' WHEN contains({u}, 'outbrain') THEN 'Outbrain' ELSE 'Unknown' END"


def macro(u: str) -> str:
    m = q("(?i)" + "|".join(R.MACROS))
    return f"coalesce(regexp_matches({u}, {m}) OR regexp_matches(url_decode({u}), {m}), false)"


def static_file(u: str) -> str:
    file = r"(?i)\.(" + "|".join(e[1:] for e in R.EXTENSIONS) + ")"
    return f"coalesce(regexp_matches({part(u, 3)}, {q(file + '$')}) OR regexp_matches({u}, {q(file + '[?&]')}), false)"


def meaningful(u: str) -> str:
    h, t = host(u), f"lower({u})"
    return f"""coalesce(CASE WHEN NOT starts_with({t}, 'http') THEN false WHEN {static_file(u)} THEN false
 WHEN {any_in(t, R.STRICT_BLOCK)} OR {any_in(h, R.AD_TECH_HOSTS)} THEN false WHEN {any_in(t, R.AD_TECH_PATTERNS)} THEN false
 WHEN {any_in(t, R.SIGNATURES)} THEN true ELSE length({u}) <= 800 END, false)"""


def one_of(t: str, words: list[str]) -> str:
    return f"{t} IN ({', '.join(map(q, words))})"


def reject_reason(u: str) -> str:
    h, t, p = host(u), f"lower({u})", f"lower({part(u, 3)})"
    return f"""CASE WHEN {u} IS NULL OR NOT starts_with({t}, 'http') THEN 'not_http' WHEN {macro(u)} THEN 'macro'
 WHEN {static_file(u)} THEN 'static_file' WHEN {any_in(t, R.STRICT_BLOCK)} THEN 'blocked' WHEN {any_in(h, R.AD_TECH_HOSTS)} THEN 'ad_tech'
 WHEN {any_in(h, R.INTERMEDIARIES)} THEN 'intermediary' WHEN {any_in(t, R.INVALID_HOSTS)} THEN 'invalid_domain'
 WHEN NOT {any_in(f'lower({part(u, 4)})', R.STRONG_PARAMS)} AND ({one_of(p, R.EXACT_PATHS)} OR {any_in(p, R.INVALID_PATHS)}) THEN 'path'
 WHEN {one_of(p, R.BARE_PATHS)} AND NOT {any_in(t, R.OFFER_HINTS)} THEN 'bare_path' WHEN {any_in(t, R.INFRASTRUCTURE)} THEN 'infrastructure' END"""


def ladder(u: str) -> str:
    h, t = host(u), f"lower({u})"

    def on(hosts, parts, names, values) -> str:
        tests = [f"contains({h}, {q(x)})" for x in hosts] + [f"regexp_matches({t}, {q(x)})" if x[0] == "^" else f"contains({t}, {q(x)})" for x in parts]
        tests += [f"{param(u, n)} IS NOT NULL" for n in names] + [f"coalesce({param(u, n)} = {q(v)}, false)" for n, v in values]
        return " OR ".join(tests)

    return "CASE " + " ".join(f"WHEN {on(*tests)} THEN {q(n)}" for n, *tests in R.NETWORK_LADDER) + " END"


def tier(u: str, i: int) -> str:
    name, confidence, words, names = R.NETWORK_TIERS[i]
    tests = [any_in(f"lower({u})", words)] if words else []
    tests += [f"{param(u, n)} IS NOT NULL" for n in names]
    if confidence == "medium":
        tests += [f"NOT contains(lower({u}), 'clickbank')", f"length({param(u, names[0])}) <= 20"]
    return f"CASE WHEN {' AND '.join(tests)} THEN {{'n': {q(name)}, 'c': {q(confidence)}, 'p': {i}}} END"


def url_tracker(u: str) -> str:
    return first_match(f"lower({u})", [(n, marks) for n, marks, _, _ in R.POOL_TRACKERS])


def page_tracker(html: str) -> str:
    return first_match(f"lower({html})", [(n, marks) for n, _, marks, _ in R.POOL_TRACKERS if marks])


def tracking_tool(u: str) -> str:
    t = f"lower({u})"
    return f"coalesce({first_regex(t, R.CLICK_TRACKERS)}, {host_rule(u, R.TRACKER_HOSTS)}, {first_match(t, list(R.TRACKER_PATTERNS.items()))}, CASE WHEN contains({t}, 'utm_') THEN 'Google Analytics' END)"


def named_network(u: str) -> str:
    return f"coalesce({host_rule(u, R.AFFILIATE_HOSTS)}, {first_match(f'lower({u})', list(R.AFFILIATE_HOSTS.items()))})"


def affiliate_network(u: str) -> str:
    return f"coalesce({named_network(u)}, CASE WHEN {any_in(f'lower({u})', R.GENERIC_TRACKERS)} THEN 'Unknown Affiliate' END)"



def score_tests(url: str, final: str, content: str) -> list[str]:
    last, first = f"lower(coalesce({final}, {url}))", f"lower({url})"
    return [
        any_in(last, R.AFFILIATE_PARAMS), any_in(last, R.AFFILIATE_PATHS), f"({host(last)} <> {host(url)} AND {any_in(host(last), R.HEALTH_WORDS)})",
        f"({any_in(first, R.TRACKER_MARKS)} OR {any_in(last, R.TRACKER_MARKS)})", any_in(f"lower({content})", R.BUY_WORDS), any_in(host(last), R.PUBLISHERS),
    ]


def ad_score_sql(url: str, final: str, content: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for t, (_, n) in zip(score_tests(url, final, content), SCORED, strict=True)) + ")"


def vote_sql(text: str) -> str:
    a, b = (weighted(f"lower({text})", [(w, 1) for w in ws]) for ws in (R.AFFILIATE_PHRASES, R.ARBITRAGE_PHRASES))
    return f"CASE WHEN {a} > {b} AND {a} >= 1 THEN 'Affiliate' WHEN {b} > {a} AND {b} >= 2 THEN 'Arbitrage' ELSE 'Unknown' END"


def pick(words: list[str], n: str) -> str:
    """One of the words, by a number; in both dialects."""
    return f"split_part({q('|'.join(words))}, '|', CAST({n} % {len(words)} AS INT) + 1)"


def text(html: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({html}, {q(G.ASIDE)}, ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def title(html: str) -> str:
    return f"trim(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1))"


def attribute(rest: str, name: str) -> str:
    return "concat(" + ", ".join(f"regexp_extract({rest}, {q(G.attribute_pattern(name))}, {i})" for i in (1, 2, 3)) + ")"


def rule_rows(sets) -> str:
    """The rules of signals as r(prio, ord, kind, field, signal, weight)."""
    rows, prio = [], 0
    for i, (kind, fields, signals) in enumerate(sets):
        for signal, weight in signals:
            rows += [f"({prio}, {i}, {q(kind)}, {q(field)}, {q(signal)}, {weight})" for field in fields]
            prio += 1
    return f"r(prio, ord, kind, field, signal, weight) AS (VALUES {', '.join(rows)})"


def kinds(sets, fields: dict[str, str], rows: str) -> str:
    """k(id, ord, kind, score, signals) of the kinds that rows(id, ...) meet, as common tables."""
    texts = " UNION ALL ".join(f"SELECT id, {q(f)} AS f, lower({x}) AS t FROM {rows}" for f, x in fields.items())
    return f"""{rule_rows(sets)}, x AS ({texts}), m AS (SELECT DISTINCT id, prio, ord, kind, signal, weight FROM x JOIN r ON r.field = x.f WHERE contains(x.t, r.signal)),
 k AS (SELECT id, ord, kind, sum(weight)::INTEGER AS score, list(signal ORDER BY prio) AS signals FROM m GROUP BY id, ord, kind)"""


#: URLs of the networks whose ids have a form of their own, in all their forms.
CODED = "concat(" + pick([
    "https://hop-apps.clickbank.net/error?destinationUrl=https%3A%2F%2Fwww.shop.example.co.uk%2Fx&hop=aff9&n=", "https://aff1.prod2.hop.clickbank.net/?hop=zzz&hopId=h", "https://x.hop.clickbank.net/?hop=q", "https://o.example.com/cb/vsl?hop=h2&affiliate=af",
    "https://o.example.com/p?affiliate=af", "https://www.djpcraze.com/p?aff_id=7&transaction_id=t1&event_source_url=shop.example.com&n=", "https://o.example.com/?oid=3&affid=4&ef_click_id=c5&event_source_url=https%3A%2F%2Fx.example.org%2Fa",
    "https://t.everflow.io/?affid=&aff_id=9&effp=e", "https://go.hasoffers.com/c?offer_id=", "https://x.tune.com/c?offer_id=1&aff_id=2&aff_click_id=k&aff_sub=s1&aff_sub2=s", "https://o.example.com/?offer_id=5&aff_id=6&transaction_id=t",
    "https://www.digistore24.com/redir/1/x?aff=a&pay=p1&cid=c1&uid=u", "https://digistore24.com/redir/2/y?aff=b&cid=c", "https://go2cloud.org/aff_c?aff_id=1&x=",
], "id") + ", id)"

_SIGNALS = sorted({w for sets in (RS.OFFER_TYPES, RS.VALIDITY[1:], RS.FINGERPRINTS, RS.ARBITRAGE) for _, fields, signals in sets for w, _ in signals if fields != ["url"]})
_TRACKING = [w for w, _ in RS.VALIDITY[0][2]]
#: A page with a title that may tell of a challenge, some signals and an ad's element.
PAGE = f"""concat('<title>', {pick([*_TRACKING, *["A page"] * len(_TRACKING)], "page_id")}, '</title>', html, '<p>', {pick(_SIGNALS, "page_id")}, ' ', {pick(_SIGNALS, "(page_id * 7 + 3)")}, ' ', {pick(_SIGNALS, "(page_id * 11 + 5)")}, '</p>',
 CASE page_id % 3 WHEN 0 THEN {pick(['<meta name="description" content="x">', '<meta property="og:title" content="y">', '<meta property="og:description">'], "page_id")} ELSE '' END)"""
PAGED = f"p AS (SELECT page_id AS id, {PAGE} AS page, concat('https://o.example.com', {pick([w for w, _ in RS.ARBITRAGE[0][2]] + ['/category/x', '/tag/y'], 'page_id')}, page_id) AS link FROM pages)"


def decoders(u: str) -> dict[str, dict[str, str]]:
    """The networks' own forms of ids in a URL: {network: {id: expression}}."""
    h, labels, source = host(u), f"string_split({host(u)}, '.')", param(u, "event_source_url")
    error, marked = f"contains({h}, 'hop-apps.clickbank.net')", f"contains({part(u, 3)}, '/cb/')"
    hop = f"(contains({h}, 'hop.clickbank.net') AND len({labels}) >= 4)"
    everflow = f"({first_param(u, ['effp', 'ef_click_id', 'oid'])} IS NOT NULL OR {any_in(f'lower({u})', ['everflow', 'djpcraze.com'])})"
    hasoffers = f"({any_in(h, ['hasoffers.com', 'tune.com', 'go2cloud.org'])} OR ({param(u, 'offer_id')} IS NOT NULL AND {param(u, 'aff_id')} IS NOT NULL))"
    on = lambda test, names: {k: f"CASE WHEN {test} THEN {first_param(u, ns)} END" for k, ns in names.items()}
    return {
        "everflow": on(everflow, {"offer_id": ["oid"], "affiliate_id": ["affid", "aff_id"], "click_id": ["effp", "ef_click_id", "transaction_id"], "offer_domain": ["event_source_url"]})
        | {"offer_url": f"CASE WHEN NOT {everflow} THEN NULL WHEN starts_with({source}, 'http') THEN {source} WHEN {source} IS NOT NULL THEN concat('https://', {source}) END"},
        "clickbank": {
            "affiliate_id": f"CASE WHEN {error} THEN {param(u, 'hop')} ELSE coalesce(CASE WHEN {marked} THEN {param(u, 'affiliate')} END, CASE WHEN {hop} THEN split_part({h}, '.', 1) END, {param(u, 'hop')}) END",
            "offer_id": f"CASE WHEN {hop} AND NOT {error} AND len({labels}) >= 5 THEN split_part({h}, '.', 2) END", "click_id": f"CASE WHEN NOT {error} THEN {param(u, 'hopId')} END",
            "offer_url": f"CASE WHEN {error} THEN {param(u, 'destinationUrl')} END", "offer_domain": f"CASE WHEN {error} THEN {host(param(u, 'destinationUrl'))} END",
        },
        "hasoffers": on(hasoffers, {"offer_id": ["offer_id"], "affiliate_id": ["aff_id"], "click_id": ["aff_click_id", "transaction_id"], "sub_id1": ["aff_sub"], "sub_id2": ["aff_sub2"]}),
        "digistore": on(f"contains({h}, 'digistore24.com')", {"offer_id": ["pay", "cid"], "affiliate_id": ["aff"], "click_id": ["uid"]}),
        "impact": on(any_in(h, ["impact.com", "impactradius.com", "sjv.io", "prf.hn"]), {"affiliate_id": ["irpid", "subid1"], "offer_id": ["campaignid"], "click_id": ["clickid"]}),
        "generic": {"affiliate_id": first_param(u, R.AFFILIATE_ALIASES), "offer_id": first_param(u, R.OFFER_ALIASES), "sub_id1": first_param(u, R.SUB_ALIASES), "click_id": first_param(u, R.CLICK_ALIASES)},
    }


def decoded(u: str, k: str) -> str:
    """An id of a URL, generic names over the networks' forms, later ones over earlier ones."""
    gates = {
        "everflow": f"({param(u, 'effp')} IS NOT NULL OR contains(lower({u}), 'djpcraze.com'))",
        "clickbank": f"({first_param(u, ['hop', 'hopId'])} IS NOT NULL OR contains(lower({u}), 'clickbank') OR contains({part(u, 3)}, '/cb/'))",
    }
    found = [f"CASE WHEN {gates[n]} THEN {ids[k]} END" if n in gates else ids[k] for n, ids in reversed(decoders(u).items()) if k in ids]
    return f"coalesce({', '.join(found)}, NULL)"


def cloaking_kind(first: str, last: str) -> str:
    a, b = registered_domain(first), registered_domain(last)
    return f"""CASE WHEN coalesce({a} = {b}, true) THEN 'none' WHEN {any_in(a, R.CLOAK_TRACKERS)} THEN 'tracker_to_offer'
 WHEN {any_in(a, R.NEWS_WORDS)} AND ({any_in(b, R.SALES_WORDS)} OR coalesce(ends_with({last}, '.shop'), false)) THEN 'news_to_sales' ELSE 'domain_change' END"""


def same_page(a: str, b: str) -> str:
    place = lambda u: f"concat(lower({part(u, 2)}), regexp_replace(lower({part(u, 3)}), '/+$', ''))"
    return f"coalesce({place(a)} = {place(b)}, false)"


def offer_choice(rows: str, final: str, chain: list[str], real: str, domain: str, landing: str) -> str:
    """id, offer, method and needs_review of `rows`, where real and domain are expressions."""
    dead = lambda u: f"({u} IS NULL OR {any_in(f'lower({u})', R.DEAD_ENDS)})"
    fit = lambda u: f"NOT {dead(u)} AND NOT {any_in(f'lower({u})', R.NOISE)} AND {reject_reason(u)} IS NULL AND {registered_domain(u)} <> coalesce({registered_domain(landing)}, '')"
    steps = [(f"NOT {same_page(final, landing)} AND NOT {dead(final)} AND {reject_reason(final)} IS NULL", final, "direct"), (f"{reject_reason('named_')} IS NULL", "named_", "event_source_url")]
    steps += [(fit(u), u, "chain_last_valid_filtered") for u in reversed(chain)] + [("domain_ IS NOT NULL", "concat('https://', domain_)", "constructed_from_domain")]
    case = lambda n: " ".join(f"WHEN {i} THEN {q(step[n]) if n == 2 else step[n]}" for i, step in enumerate(steps))
    bound = f"SELECT *, CASE WHEN starts_with({real}, 'http') THEN {real} WHEN {real} IS NOT NULL THEN concat('https://', {real}) END AS named_, {domain} AS domain_ FROM {rows}"
    chosen = f"SELECT *, CASE {' '.join(f'WHEN {t} THEN {i}' for i, (t, _, _) in enumerate(steps))} END AS step FROM ({bound})"
    return f"SELECT id, CASE step {case(1)} END AS offer, CASE step {case(2)} ELSE 'unresolved' END AS method, step IS NULL AS needs_review FROM ({chosen})"
