"""Queries of the row-wise operators: URL functions, predicates, detection, parameters
and scores. Each names its columns once on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import params as P
from ..operators import rules as O
from ..operators import score as S
from ..rules import tables as R
from ..sources import html as G
from . import base as B



def _place(u: str) -> str:
    return f"concat(lower({B.part(u, 2)}), regexp_replace(lower({B.part(u, 3)}), '/+$', ''))"


_SAME = f"{_place('concat(url, chr(63), chr(120))')} = {_place('url')}"
_C = "coded"
_CLOAKED = f"concat('https://a.', {B.pick([*R.NEWS_WORDS, *R.CLOAK_TRACKERS, 'plain', 'x.co.uk', 'x.com'], 'id')}, CASE WHEN id % 4 = 0 THEN '' ELSE 'site.com' END, '/p')"
_SOLD = f"concat('https://www.', {B.pick([*R.SALES_WORDS, 'plain', 'x.co.uk', 'x.com'], '(id * 5 + 1)')}, CASE WHEN id % 4 = 0 THEN '' ELSE 'site.com' END, CASE WHEN id % 6 = 1 THEN '/z.shop' ELSE '/q' END)"
_PARAMED = f"concat('https://o.example.com/a?', {B.pick(R.DROP_PARAMS + R.KEEP_PARAMS, 'id')}, '=1&', {B.pick(R.DROP_PARAMS + R.KEEP_PARAMS, '(id * 5 + 2)')}, '=2&page=3#f', id)"
_SERVED = f"concat('https://', {B.pick([h for h, _ in R.AD_SERVERS] + ['x.example.com'], 'id')}, '/c?', {B.pick(sorted({n for _, ns in R.AD_SERVERS for n in ns}), '(id * 3 + 1)')}, '=https%3A%2F%2Fo.example.com%2F', id, '&', {B.pick(sorted({n for _, ns in R.AD_SERVERS for n in ns}), 'id')}, '=https%3A%2F%2Fp.example.com')"
_BOUGHT = f"concat(html, {B.pick([*R.BUY_WORDS, '', '-'], 'id')})"
_CMS = f"concat(html, {B.pick(['/wp-content/', 'wp-json', 'disqus', 'fb-comments', '', 'comment'], 'id')})"


def _of(sql: str, given: str) -> str:
    """An expression over the column `coded`, over a given one."""
    return sql.replace(_C, f"({given})")


_IM = B.any_in(B.host("landing"), ["impact.com", "impactradius.com", "sjv.io", "prf.hn"])
_TEXT_SQL = B.text('html')
#: A page with the script of one tool or none.
_TAGGED = """concat(html, '<script src="https://', split_part('cdn.example.net|rdtk.io|go.binom.org|trk.voluum.com|a.bemobtrck.com|kclick.io|affise.js|getcake.com|anytrack.io|x.everflow.io|shop.example', '|', CAST(id % 11 AS INT) + 1), '/t.js"></script>')"""
_TRACKERS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_TAGGED}, {B.q('(?i)' + p)}) THEN {B.q(n)} END" for n, p in R.HTML_TRACKERS) + ")"


def _has(n: str) -> str:
    return f"{B.param('landing', n)} IS NOT NULL"


#: query: {column: (Spark column when called, SQL expression)}, over the ad table. Columns
#: are made when a query runs, as they need a session.
SCALARS: dict[str, dict[str, tuple[Callable[[], Column], str]]] = {
    "b01_split_url": {
        'scheme': (lambda: U.scheme(F.col('landing')), f'lower({B.part('landing', 1)})'),
        'netloc': (lambda: U.netloc(F.col('landing')), B.part('landing', 2)),
        'path': (lambda: U.path(F.col('landing')), B.part('landing', 3)),
        'query': (lambda: U.query(F.col('landing')), B.part('landing', 4)),
        'fragment': (lambda: U.fragment(F.col('url')), B.part('url', 5)),
    },
    "b02_query_map": {
        'aff_id': (lambda: F.try_element_at(U.params(F.col('landing')), F.lit('aff_id')), B.param('landing', 'aff_id')),
        'sub1': (lambda: F.try_element_at(U.params(F.col('landing')), F.lit('sub1')), B.param('landing', 'sub1')),
        'empty': (lambda: F.try_element_at(U.params(F.col('landing')), F.lit('empty')), B.param('landing', 'empty')),
    },
    "b04_host": {
        'host': (lambda: U.host(F.col('landing')), B.host('landing')),
    },
    "b05_strip_tracking": {
        'clean': (lambda: U.strip_tracking(F.col('landing')), B.stripped('landing')),
        'clean_each': (lambda: U.strip_tracking(F.expr(_PARAMED)), B.stripped(f'({_PARAMED})')),
    },
    "b06_landing_key": {
        'key': (lambda: U.landing_key(F.col('landing')), "split_part(split_part(landing, '?', 1), '#', 1)"),
        'glued': (lambda: U.landing_key(F.expr("concat('https://o.example.com/a', id, '&dicbo=v2?x=1')")), "concat('https://o.example.com/a', id)"),
    },
    "b07_blank_macros": {
        'blanked': (lambda: U.blank_macros(F.col('landing')), "regexp_replace(landing, '=(\\{[^}]+\\}|__[A-Z]+__)', '=', 'g')"),
    },
    "b08_same_page": {
        'same': (lambda: U.same_page(F.concat(F.col("url"), F.lit("?x=1")), F.col("url")), _SAME),
        'other': (lambda: U.same_page(F.col('landing'), F.col('final_url')), "concat(lower({a}), regexp_replace(lower({b}), '/+$', '')) = concat(lower({c}), regexp_replace(lower({d}), '/+$', ''))".format(a=B.part('landing', 2), b=B.part('landing', 3), c=B.part('final_url', 2), d=B.part('final_url', 3))),
    },
    "b09_absolute": {
        'rooted': (lambda: U.absolute(F.col('url'), F.lit('/a/b?c=1')), f"concat(lower({B.part('url', 1)}), '://', {B.part('url', 2)}, '/a/b?c=1')"),
        'relative': (lambda: U.absolute(F.lit('https://h.example.com/x/y'), F.concat(F.lit('p'), F.col('id').cast('string'))), "concat('https://h.example.com/x/p', id)"),
        'other': (lambda: U.absolute(F.col('url'), F.col('landing')), f"CASE WHEN starts_with(landing, '//') THEN concat(lower({B.part('url', 1)}), ':', landing) ELSE landing END"),
    },
    "b10_with_scheme": {
        'fixed': (lambda: U.with_scheme(F.col('landing')), "CASE WHEN starts_with(landing, '//') THEN concat('https:', landing) ELSE landing END"),
    },
    "b11_origin": {
        'origin': (lambda: U.origin(F.col('landing')), "concat(array_to_string(list_slice(string_split(landing, '/'), 1, 3), '/'), '/')"),
    },
    "b13_peel_ad_server": {
        'target': (lambda: U.peel_ad_server(F.expr(_SERVED)), _of("coalesce(" + ", ".join(f"CASE WHEN ends_with({B.host(_C)}, {B.q(s)}) THEN {B.first_param(_C, ns)} END" for s, ns in R.AD_SERVERS) + f", {_C})", _SERVED)),
    },
    "b14_thumbnail": {
        'image': (lambda: U.clean_thumbnail(F.concat(F.lit('https://i.example.net/ui/?src=%2F%2Fcdn.example.net%2Fa'), F.col('id').cast('string'), F.lit('.jpg&w=1'))), "concat('https://cdn.example.net/a', id, '.jpg')"),
    },
    "b15_plausible_host": {
        'plausible': (lambda: U.plausible(F.col('landing')), f"contains({B.host('landing')}, '.')"),
    },
    "b16_unescape": {
        'decoded': (lambda: U.unescape(F.col('landing')), 'url_decode(landing)'),
    },
    "c01_meaningful": {
        'landing_ok': (lambda: O.meaningful(F.col('landing')), B.meaningful('landing')),
        'final_ok': (lambda: O.meaningful(F.col('final_url')), B.meaningful('final_url')),
    },
    "c02_valid_offer": {
        'reason': (lambda: O.reject_reason(F.col('final_url')), B.reject_reason('final_url')),
        'landing_reason': (lambda: O.reject_reason(F.col('landing')), B.reject_reason('landing')),
    },
    "c03_ad_tech_host": {
        'ad_tech': (lambda: O.contains_any(U.host(F.col('final_url')), R.AD_TECH_HOSTS), B.any_in(B.host('final_url'), R.AD_TECH_HOSTS)),
    },
    "c04_intermediary": {
        'intermediary': (lambda: O.contains_any(U.host(F.col('landing')), R.INTERMEDIARIES), B.any_in(B.host('landing'), R.INTERMEDIARIES)),
    },
    "c05_prelander": {
        'prelander': (lambda: O.prelander(F.col('landing')), f'{B.host('landing')} IN ({', '.join(map(B.q, R.PRELANDERS))}) OR ({_has('cep')} AND ({_has('lptoken')} OR {_has('widget_id')} OR {_has('boost_id')}))'),
    },
    "c06_macro": {
        'macro': (lambda: O.has_macro(F.col('landing')), B.macro('landing')),
    },
    "c07_tracking_redirect": {
        'redirect': (lambda: O.contains_any(F.lower(F.col('landing')), R.TRACKING_REDIRECTS), B.any_in('lower(landing)', R.TRACKING_REDIRECTS)),
    },
    "c08_dead_end": {
        'dead': (lambda: F.col('landing').isNull() | O.contains_any(F.lower(F.col('landing')), R.DEAD_ENDS), f'landing IS NULL OR {B.any_in('lower(landing)', R.DEAD_ENDS)}'),
    },
    "c09_noise": {
        'noise': (lambda: O.contains_any(F.lower(F.col('final_url')), R.NOISE), B.any_in('lower(final_url)', R.NOISE)),
    },
    "c10_api_endpoint": {
        'api': (lambda: F.col('final_url').isNull() | O.contains_any(F.lower(F.col('final_url')), R.API_ENDPOINTS), f'final_url IS NULL OR {B.any_in('lower(final_url)', R.API_ENDPOINTS)}'),
    },
    "c11_potential_offer": {
        'n': (lambda: F.size(F.filter(F.array(F.col('landing'), F.col('final_url'), F.col('url')), lambda u: O.contains_any(F.lower(u), R.OFFER_WORDS))).cast('long'), 'len(list_filter([landing, final_url, url], lambda u: ' + B.any_in('lower(u)', R.OFFER_WORDS) + '))'),
    },
    "c12_valid_cta": {
        'valid': (lambda: T.valid_cta(F.col('title')), f"trim(title) <> '' AND NOT {B.any_in('lower(title)', R.LEGAL_WORDS)}"),
    },
    "c14_skip_domain": {
        'skip': (lambda: F.get(O.matches(F.lower(F.col('final_url')), R.SKIP_SITES), F.lit(0)), B.first_match('lower(final_url)', [(w, [w]) for w in R.SKIP_SITES])),
    },
    "c15_junk_title": {
        'junk': (lambda: O.contains_any(F.lower(F.col('title')), R.JUNK_TITLES) & (F.length(F.col('title')) < 20), f'{B.any_in('lower(title)', R.JUNK_TITLES)} AND length(title) < 20'),
    },
    "c16_bogus_landing": {
        'bogus': (lambda: O.contains_any(F.lower(F.expr("concat(landing, " + B.pick([*R.BOGUS_LANDINGS, '', '-'], 'id') + ")")), R.BOGUS_LANDINGS), B.any_in("lower(concat(landing, " + B.pick([*R.BOGUS_LANDINGS, '', '-'], 'id') + "))", R.BOGUS_LANDINGS)),
    },
    "c18_arabic": {
        'arabic': (lambda: T.arabic(F.col('title')), "regexp_matches(title, '[\\x{0600}-\\x{06FF}]')"),
    },
    "d01_affiliate_network": {
        'affiliate': (lambda: O.affiliate_network(F.col('landing'))['network'], B.affiliate_network('landing')),
        'confidence': (lambda: O.affiliate_network(F.col('landing'))['confidence'], f"CASE WHEN {B.named_network('landing')} IS NOT NULL THEN 'high' WHEN {B.any_in('lower(landing)', R.GENERIC_TRACKERS)} THEN 'medium' ELSE 'unknown' END"),
    },
    "d02_tracking_tool": {
        'tracker': (lambda: O.tracking_tool(F.col('landing')), B.tracking_tool('landing')),
    },
    "d04_param_tracker": {
        'tracker': (lambda: O.first_regex(F.lower(F.col('landing')), R.PARAM_TRACKERS), B.first_regex('lower(landing)', R.PARAM_TRACKERS)),
    },
    "d08_known_offer": {
        'program': (lambda: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in R.KNOWN_OFFERS for x in pair)), U.registered_domain(F.col('final_url'))), F.when(U.first_param(F.col('final_url'), R.AFFILIATE_ALIASES + R.OFFER_ALIASES).isNotNull() & O.affiliate_network(F.col('final_url'))['network'].isNull(), F.lit('Direct Affiliate'))), f"coalesce(CASE {B.registered_domain('final_url')} {' '.join(f'WHEN {B.q(h)} THEN {B.q(n)}' for h, n in R.KNOWN_OFFERS)} END, CASE WHEN {B.first_param('final_url', R.AFFILIATE_ALIASES + R.OFFER_ALIASES)} IS NOT NULL AND {B.affiliate_network('final_url')} IS NULL THEN 'Direct Affiliate' END)"),
    },
    "d10_html_trackers": {
        'trackers': (lambda: F.array_join(O.html_trackers(F.expr(_TAGGED)), ','), _TRACKERS_SQL),
        'own': (lambda: F.array_join(O.html_trackers(F.col('html')), ','), _TRACKERS_SQL.replace(_TAGGED, 'html')),
    },
    "d11_cloaking": {
        **{k: (lambda k=k: O.cloaking(F.expr(_CLOAKED), F.expr(_SOLD), F.expr("CAST(id % 6 AS INT)"))[k], sql.replace('first_', B.registered_domain(f'({_CLOAKED})')).replace('last_', B.registered_domain(f'({_SOLD})'))) for k, sql in (
            ('changed', 'first_ <> last_'), ('forced', f"first_ <> last_ AND ({B.any_in('first_', R.CLOAK_TRACKERS)} OR ({B.any_in('first_', R.NEWS_WORDS)} AND ({B.any_in('last_', R.SALES_WORDS)} OR ends_with({_SOLD}, '.shop'))))"),
            ('kind', B.cloaking_kind(f'({_CLOAKED})', f'({_SOLD})')),
            ('redirects', 'CAST(id % 6 AS INT)'), ('suspicious', 'id % 6 > 3'),
        )},
    },
    "d12_vertical": {
        'vertical': (lambda: F.coalesce(O.first_match(F.lower(F.col('final_url')), R.VERTICALS), F.lit('Unknown')), f"coalesce({B.first_match('lower(final_url)', R.VERTICALS)}, 'Unknown')"),
    },
    "d13_title_vertical": {
        'vertical': (lambda: F.coalesce(O.first_match(F.lower(F.col('title')), R.TITLE_VERTICALS), F.lit('general')), f"coalesce({B.first_match('lower(title)', R.TITLE_VERTICALS)}, 'general')"),
    },
    "d14_page_type": {
        'page_type': (lambda: F.coalesce(O.first_match(F.lower(F.col('final_url')), [(n, [p]) for p, n in R.PAGE_TYPES]), F.lit('Landing Page')), f"coalesce({B.first_match('lower(final_url)', [(n, [p]) for p, n in R.PAGE_TYPES])}, 'Landing Page')"),
    },
    "d16_quick_type": {
        'quick': (lambda: F.coalesce(O.first_match(F.lower(F.concat(G.visible_text(F.col('html')), F.lit(' '), F.col('title'))), R.QUICK_TYPES), F.lit('Unknown')), f"coalesce({B.first_match(f"lower(concat({_TEXT_SQL}, ' ', title))", R.QUICK_TYPES)}, 'Unknown')"),
    },
    "d17_cms": {
        'wordpress': (lambda: G.page_structure(F.col('url'), F.expr(_CMS))['wordpress'], f"contains({_CMS}, '/wp-content/') OR contains({_CMS}, 'wp-json')"),
        'comments': (lambda: G.page_structure(F.col('url'), F.expr(_CMS))['comments'], f"contains({_CMS}, 'disqus') OR contains({_CMS}, 'fb-comments')"),
        'clickbait': (lambda: G.page_structure(F.expr("concat(url, " + B.pick(['Trending', 'believe', 'defying', 'celebrities', 'x'], 'id') + ")"), F.col('html'))['clickbait'], "id % 5 <> 4"),
    },
    "d18_merge_trackers": {
        'trackers': (lambda: F.array_join(O.merged_trackers(O.html_trackers(F.expr(_TAGGED)), O.url_tracker(F.col('landing'))), ','), f"array_to_string(list_sort(list_distinct(list_concat(string_split(nullif({_TRACKERS_SQL}, ''), ','), [{B.url_tracker('landing')}]))), ',')"),
    },
    "e04_widget_config": {
        **{k: (lambda k=k: P.widget_config(F.col('landing'))[k], B.param('landing', p)) for k, p in R.WIDGET_PARAMS.items()},
        'tracker': (lambda: P.widget_config(F.col('landing'))['tracker'], f"CASE WHEN {_has('lptoken')} THEN 'Custom/In-house' END"),
        'traffic_source': (lambda: P.widget_config(F.col('landing'))['traffic_source'], "'Revcontent'"),
    },
    "e05_clickbank": {k: (lambda k=k: P.clickbank_ids(F.expr(B.CODED))[k], _of(sql, B.CODED)) for k, sql in B.decoders(_C)["clickbank"].items()},
    "e06_everflow": {k: (lambda k=k: P.everflow_ids(F.expr(B.CODED))[k], _of(sql, B.CODED)) for k, sql in B.decoders(_C)["everflow"].items()},
    "e07_hasoffers": {k: (lambda k=k: P.hasoffers_ids(F.expr(B.CODED))[k], _of(sql, B.CODED)) for k, sql in B.decoders(_C)["hasoffers"].items()},
    "e08_impact": {k: (lambda k=k: P.impact_ids(F.col('landing'))[k], f'CASE WHEN {_IM} THEN {B.first_param('landing', names)} END') for k, names in (('affiliate_id', ['irpid', 'subid1']), ('offer_id', ['campaignid']), ('click_id', ['clickid']))},
    "e09_digistore": {k: (lambda k=k: P.digistore_ids(F.expr(B.CODED))[k], _of(sql, B.CODED)) for k, sql in B.decoders(_C)["digistore"].items()},
    "e10_generic_ids": {k: (lambda k=k: P.generic_ids(F.col('landing'))[k], B.first_param('landing', names)) for k, names in (('affiliate_id', R.AFFILIATE_ALIASES), ('offer_id', R.OFFER_ALIASES), ('sub_id1', R.SUB_ALIASES), ('click_id', R.CLICK_ALIASES))},
    "e11_second_ids": {k: (lambda k=k: P.second_ids(F.col('landing'))[k], B.first_param('landing', names)) for k, names in R.SECOND_ALIASES.items()},
    "d07_param_ladder": {
        'by_params': (lambda: P.network_by_params(F.col('landing')), B.ladder('landing')),
        'of_final': (lambda: P.network_by_params(F.col('final_url')), B.ladder('final_url')),
    },
    "f01_ad_score": {
        'score': (lambda: S.ad_score(F.col('landing'), F.col('final_url'), F.expr(_BOUGHT))['score'], B.ad_score_sql('landing', 'final_url', _BOUGHT)),
        'signals': (lambda: F.array_join(S.ad_score(F.col('landing'), F.col('final_url'), F.expr(_BOUGHT))['signals'], ','), "concat_ws(','," + ", ".join(f"CASE WHEN {t} THEN {B.q(n)} END" for t, (n, _) in zip(B.score_tests('landing', 'final_url', _BOUGHT), S.SCORED, strict=True)) + ")"),
        'verdict': (lambda: S.score_verdict(S.ad_score(F.col('landing'), F.col('final_url'), F.expr(_BOUGHT))['score'], F.expr(_BOUGHT))['ad_type'], f"CASE WHEN {B.ad_score_sql('landing', 'final_url', _BOUGHT)} >= 1 THEN 'Affiliate' WHEN {B.ad_score_sql('landing', 'final_url', _BOUGHT)} <= -3 THEN 'Arbitrage' ELSE {B.vote_sql(_BOUGHT)} END"),
        'confidence': (lambda: S.score_verdict(S.ad_score(F.col('landing'), F.col('final_url'), F.expr(_BOUGHT))['score'], F.expr(_BOUGHT))['confidence'], f"CASE WHEN {B.ad_score_sql('landing', 'final_url', _BOUGHT)} >= 3 THEN 'high' WHEN {B.ad_score_sql('landing', 'final_url', _BOUGHT)} >= 1 OR {B.ad_score_sql('landing', 'final_url', _BOUGHT)} <= -3 OR {B.vote_sql(_BOUGHT)} <> 'Unknown' THEN 'medium' ELSE 'low' END"),
    },
    "f02_keyword_vote": {
        'vote': (lambda: S.keyword_vote(F.col('html')), B.vote_sql('html')),
        'title_vote': (lambda: S.keyword_vote(F.col('title')), B.vote_sql('title')),
    },
    "o02_title_norm": {
        'norm': (lambda: T.normal_title(F.col('title')), "regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')"),
    },
    "o03_clip": {
        'short': (lambda: T.clip(F.col('title'), 12), "CASE WHEN length(title) > 12 THEN concat(substring(title, 1, 12), '...') ELSE title END"),
    },
    "o04_phrase_score": {
        'score': (lambda: O.weighted(F.lower(F.col('title')), [('trending', 2), ('crypto', 3), ('now', 1)]), B.weighted('lower(title)', [('trending', 2), ('crypto', 3), ('now', 1)])),
    },
    "n03_arabic_fix": {
        'language': (lambda: F.when(T.arabic(F.col('title')), 'ar').otherwise(F.col('language')), "CASE WHEN regexp_matches(title, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE language END"),
    },
    "n09_review_flag": {
        'needs_review': (lambda: (F.col('ad_type') == 'Affiliate') & F.col('affiliate_network').isNull(), "ad_type = 'Affiliate' AND affiliate_network IS NULL"),
    },
}


def queries() -> dict[str, tuple[Callable, str]]:
    def made(columns: dict[str, tuple[Callable[[], Column], str]]) -> tuple[Callable, str]:
        spark_side = lambda spark, sf_dir: B.ads(spark, sf_dir).select("id", *(c().alias(n) for n, (c, _) in columns.items()))
        return spark_side, f"WITH {B.ADS_SQL} SELECT id, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in columns.items()) + " FROM ads"

    return {name: made(columns) for name, columns in SCALARS.items()}
