"""Queries of the operators that join, group, order or rewrite rows, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import chains as H
from ..operators import links as K
from ..operators import params as P
from ..operators import profiles as PR
from ..operators import rules as O
from ..operators import score as S
from ..operators import store as N
from ..operators.shared import numbered
from ..rules import tables as R
from ..sources import feeds
from ..sources import html as G
from ..streaming import sightings as ST
from . import base as B

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, ads: bool = True):
    """Registers a query; sql may go on from the ad table."""

    def add(made: Callable[[SparkSession, str], DataFrame]):
        text = sql and (f"WITH {B.ADS_SQL}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}" if ads else sql)
        QUERIES[name] = (made, text)
        return made

    return add


t = B.table

# ---- sources and sinks ----

_A = G.element_pattern(["a"], G.PLAIN_ATTRIBUTES)
_OWN = f"regexp_replace(html, {B.q(G.ASIDE)}, ' ', 'g')"
ANCHORS_SQL = rf"""a0 AS (SELECT id, url, unnest(regexp_extract_all({_OWN}, {B.q(_A)}, 2)) AS rest,
 unnest(regexp_extract_all({_OWN}, {B.q(_A)}, 3)) AS inn, generate_subscripts(regexp_extract_all({_OWN}, {B.q(_A)}, 1), 1) - 1 AS pos FROM ads),
 a AS (SELECT id, url, pos, {B.attribute('rest', 'href')} AS href, trim(regexp_replace(regexp_replace(inn, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM a0 WHERE {B.attribute('rest', 'href')} <> '')"""
ABS = f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN concat(lower({B.part('url', 1)}), ':', href) WHEN starts_with(href, '/') THEN concat(lower({B.part('url', 1)}), '://', {B.part('url', 2)}, href) WHEN starts_with(href, '#') THEN concat(regexp_extract(url, '^[^#]*'), href) ELSE concat(lower({B.part('url', 1)}), '://', {B.part('url', 2)}, CASE WHEN regexp_extract({B.part('url', 3)}, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({B.part('url', 3)}, '^(.*/)', 1) END, href) END"


@query("g01_anchors", f"{ANCHORS_SQL} SELECT id AS page_id, pos, href, trim(text) AS text, {ABS} AS absolute FROM a")
def _(s, d):
    return G.anchors(t(s, d, "pages")).select("page_id", F.col("pos").cast("long"), "href", "text", "absolute")


@query("a06_scan", "SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND value > 50", ads=False)
def _(s, d):
    return t(s, d, "events").where("event_type = 'click' AND value > 50").select("event_id", "ts", "value")


@query("a07_full_scan", "SELECT network, count(*) AS n, count(*) FILTER (landing IS NULL) AS blank FROM ads GROUP BY network")
def _(s, d):
    return B.ads(s, d).groupBy("network").agg(F.count("*").alias("n"), F.count_if(F.col("landing").isNull()).alias("blank"))


@query("a09_update_by_key", "SELECT id, CASE WHEN id % 10 = 0 THEN concat('fixed', id) ELSE title END AS title, CASE WHEN id % 10 = 0 THEN 'Affiliate' ELSE ad_type END AS ad_type FROM ads")
def _(s, d):
    old = B.ads(s, d).select("id", "title", "ad_type")
    new = old.where("id % 10 = 0").select("id", F.expr("concat('fixed', id)").alias("title"), F.lit("Affiliate").alias("ad_type"))
    return N.patch(old, new, "id", ["title", "ad_type"])


@query("a10_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1", ads=False)
def _(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "value")
    return N.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("a11_insert_absent", "SELECT id, landing FROM ads WHERE id % 3 <> 0 AND landing NOT IN (SELECT landing FROM ads WHERE id % 3 = 0)")
def _(s, d):
    a = B.ads(s, d).select("id", "landing")
    return N.insert_absent(a.where("id % 3 = 0"), a.where("id % 3 <> 0"), "landing").select("id", "landing")


@query("a12_conform", "SELECT CAST(id AS VARCHAR) AS id, title, CAST(impressions AS BIGINT) AS impressions, CAST(NULL AS VARCHAR) AS offer_id FROM ads")
def _(s, d):
    from pyspark.sql.types import _parse_datatype_string

    return N.conform(B.ads(s, d), _parse_datatype_string("id string, title string, impressions long, offer_id string"))[0]


@query("a13_dead_letter", f"SELECT id AS ad_id, 'offer' AS stage, 'error' AS level, {B.reject_reason('final_url')} AS message FROM ads WHERE {B.reject_reason('final_url')} IS NOT NULL")
def _(s, d):
    return N.split_rejects(B.ads(s, d), O.reject_reason(F.col("final_url")), "id", "offer")[1]


#: Every page links to another one, some by a blacklisted address, and some show a network's mark.
_MARK = B.pick([*R.NATIVE_MARKS, "none", "x"], "page_id")


@query("a14_targets", f"""SELECT * FROM (WITH n AS (SELECT count(*) AS n FROM pages), i AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS i, {_MARK} AS mark FROM pages), l AS (SELECT DISTINCT CASE WHEN a.page_id % 9 = 0 THEN concat(b.url, '?via=Facebook') ELSE b.url END AS url FROM i a, n JOIN i b ON b.i = (a.i * 7 + 3) % n),
 f AS (SELECT DISTINCT concat(array_to_string(list_slice(string_split(l.url, '/'), 1, 3), '/'), '/') AS site FROM l JOIN i ON i.url = l.url WHERE i.mark NOT IN ('none', 'x') AND NOT {B.any_in('lower(l.url)', R.TARGET_BLACKLIST)}) SELECT site FROM f WHERE site NOT IN (SELECT concat(array_to_string(list_slice(string_split(url, '/'), 1, 3), '/'), '/') FROM i WHERE i % 5 = 0))""", ads=False)
def _(s, d):
    pages = t(s, d, "pages")
    i = numbered(pages.select("page_id", "url", "html"), "page_id", "i")
    n = pages.count()
    to = numbered(pages.select("page_id", "url"), "page_id", "j").select("j", F.col("url").alias("to_url"))
    linked = i.join(to, F.col("j") == (F.col("i") * 7 + 3) % n).withColumn("to_url", F.when(F.col("page_id") % 9 == 0, F.concat("to_url", F.lit("?via=Facebook"))).otherwise(F.col("to_url")))
    shown = linked.select("page_id", "url", F.concat("html", F.lit('<a href="'), "to_url", F.lit('">next</a>'), F.expr(_MARK)).alias("html"), "i")
    known = shown.where("i % 5 = 0").select(U.origin(F.col("url")).alias("site"))
    links = G.anchors(shown).select(F.col("absolute").alias("link"))
    return PR.discover_targets(links, shown, known, R.TARGET_BLACKLIST, R.NATIVE_MARKS)


_NICHES = sorted({n for ns in R.GEO_NICHES.values() for n in ns})
_PLACES = [(g, n) for g, ns in R.GEO_NICHES.items() for n in dict.fromkeys([*ns, *R.FORCED_NICHES])]


@query("a15_sample", f"""g(geo, niche) AS (VALUES {', '.join(f"('{g}', '{n}')" for g, n in _PLACES)}), s AS (SELECT DISTINCT concat({B.host('url')}, '/', id % 40) AS site, {B.pick(_NICHES, '(id * 3)')} AS niche FROM ads),
 r AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY md5(concat(site, '7')), site)::INTEGER AS rank FROM s QUALIFY rank <= 3) SELECT geo, niche, site, rank FROM g JOIN r USING (niche)""")
def _(s, d):
    sites = B.ads(s, d).select(F.concat(U.host(F.col("url")), F.lit("/"), (F.col("id") % 40).cast("string")).alias("site"), F.expr(B.pick(_NICHES, "(id * 3)")).alias("niche"))
    return PR.sample_sites(sites, s.createDataFrame(_PLACES, "geo string, niche string"), 3, "7")


@query("a16_dimension", "SELECT id, CASE network WHEN 'MGID' THEN 'blue' WHEN 'Taboola' THEN 'navy' WHEN 'Outbrain' THEN 'orange' ELSE 'grey' END AS colour FROM ads")
def _(s, d):
    colours = s.createDataFrame([("MGID", "blue"), ("Taboola", "navy"), ("Outbrain", "orange")], "network string, colour string")
    return B.ads(s, d).join(F.broadcast(colours), "network", "left").select("id", F.coalesce("colour", F.lit("grey")).alias("colour"))


FEED_SQL = "SELECT o_orderkey AS feed, 0::BIGINT AS pos, concat('Order ', o_orderkey) AS title, concat('https://x.example.com/', o_custkey) AS landing, {image} AS image FROM orders"


def _feed(shape: str, image: str, wrap: Callable) -> tuple[Callable, str]:
    def made(s, d):
        rows = t(s, d, "orders").select(F.col("o_orderkey").alias("feed"), wrap(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("https://x.example.com/"), F.col("o_custkey").cast("string"))).alias("payload"))
        return feeds.normalise(rows, "feed", "payload").withColumn("pos", F.col("pos").cast("long"))

    return made, FEED_SQL.format(image=image)


def _keyed(title: Column, link: Column) -> Column:
    key = F.element_at(F.array(*map(F.lit, feeds.LANDING_KEYS)), (F.col("o_orderkey") % len(feeds.LANDING_KEYS) + 1).cast("int"))
    item = F.map_concat(F.create_map(F.lit("title"), F.lit(""), F.lit("text"), title, F.lit("image"), F.lit("i.jpg")), F.create_map(key, link))
    top = F.element_at(F.array(*map(F.lit, ("items", "data", "ads", "content"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return F.to_json(F.create_map(top, F.array(item)))


QUERIES["a01_feed_keyed_list"] = _feed("list", "'i.jpg'", _keyed)
QUERIES["a02_feed_script"] = _feed("script", "'t.jpg'", lambda title, link: F.concat(F.lit("callback("), F.to_json(F.array(F.struct(title.alias("name"), link.alias("url"), F.array(F.struct(F.lit("t.jpg").alias("url"))).alias("thumbnail")))), F.lit(");")))


def _nested(title: Column, link: Column) -> Column:
    """Payloads with several wrapper names, depths and list keys, and empty lists beside."""
    item = F.to_json(F.struct(title.alias("content"), link.alias("url"), F.struct(F.lit("n.jpg").alias("url")).alias("image")))
    key = F.element_at(F.array(*map(F.lit, ("documents", "items", "ads", "listings", "doc", "cards"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    inner = F.concat(F.lit('{"'), key, F.lit('":['), item, F.lit("]}"))
    shapes = ('{"a":%}', "%", '{"response":{"x":%,"items":[]}}', '{"ads":[],"r":{"s":{"t":{"u":{"v":%}}}},"z":[1,"x",null]}')
    n = (F.col("o_orderkey") / 6).cast("long") % len(shapes)
    whole = F.element_at(F.array(*(F.concat(F.lit(x.split("%")[0]), inner, F.lit(x.split("%")[1])) for x in shapes)), (n + 1).cast("int"))
    return F.concat(F.lit("OB("), whole, F.lit(")"))


QUERIES["a03_feed_nested"] = _feed("nested", "'n.jpg'", _nested)
QUERIES["a04_feed_content"] = _feed("content", "'c.jpg'", lambda title, link: F.to_json(F.struct(F.array(F.struct(title.alias("headline"), link.alias("url"), F.lit("c.jpg").alias("image"))).alias("content"))))

# ---- URL, rule tables ----


@query("i01_substring_join", f"SELECT id, {B.first_match('lower(landing)', list(R.TRACKER_PATTERNS.items()))} AS entity FROM ads WHERE {B.first_match('lower(landing)', list(R.TRACKER_PATTERNS.items()))} IS NOT NULL")
def _(s, d):
    rows = B.ads(s, d).select("id", F.lower("landing").alias("text"))
    return O.match_substrings(rows, "id", "text", O.rule_table(s, R.TRACKER_PATTERNS))


@query("i02_host_suffix_join", f"SELECT id, {B.host_rule('landing', R.AFFILIATE_HOSTS)} AS entity FROM ads WHERE {B.host_rule('landing', R.AFFILIATE_HOSTS)} IS NOT NULL")
def _(s, d):
    rows = B.ads(s, d).select("id", U.host(F.col("landing")).alias("host"))
    return O.match_hosts(rows, "id", "host", O.rule_table(s, R.AFFILIATE_HOSTS))


@query("c20_review_queue", "SELECT id FROM ads WHERE ad_type = 'Affiliate' AND affiliate_network IS NULL")
def _(s, d):
    return B.ads(s, d).where("ad_type = 'Affiliate' AND affiliate_network IS NULL").select("id")


# ---- html ----


_G2 = """CASE id % 4 WHEN 0 THEN concat('<p>x</p><a class="big buy-button" href="', final_url, '">buy</a><a href="https://q.example.net/product">p</a>') WHEN 1 THEN concat('<a href="https://o.example.net/deal/', id, '">d</a>')
 WHEN 2 THEN concat('<a href="https://q.example.net/abcdefgh?x=', id, '">q</a>') ELSE '<a href="https://q.example.net/x">x</a><a href="https://q.example.net/product">p</a>' END"""


@query("g02_candidate_scan", f"c AS (SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN {B.any_in(B.host('final_url'), R.AD_TECH_HOSTS)} THEN 'https://q.example.net/product' ELSE final_url END WHEN 1 THEN concat('https://o.example.net/deal/', id) WHEN 2 THEN concat('https://q.example.net/abcdefgh?x=', id) ELSE 'https://q.example.net/product' END AS href, CASE id % 4 WHEN 0 THEN CASE WHEN {B.any_in(B.host('final_url'), R.AD_TECH_HOSTS)} THEN 3 WHEN {B.any_in('lower(final_url)', R.SIGNATURES)} THEN 10 ELSE 5 END WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 3 END AS score FROM ads) SELECT id AS page_id, href, score FROM c")
def _(s, d):
    return K.quick_candidates(B.ads(s, d).selectExpr("id AS page_id", f"{_G2} AS html"), "page_id")


@query("g06_endpoints", rf"SELECT id AS page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, {B.q(G.ENDPOINT)}, 1))), ' ') AS endpoints FROM ads")
def _(s, d):
    return t(s, d, "pages").select("page_id", F.array_join(F.array_sort(G.endpoints(F.col("html"))), " ").alias("endpoints"))


@query("g08_meta_refresh", r"SELECT id AS page_id, regexp_extract(concat('<meta http-equiv=\"refresh\" content=\"0;url=', landing, '\">'), '(?i)http-equiv=[\x22'']refresh[\x22''][^>]*url=([^\x22''>]+)', 1) AS target FROM ads".replace('\\"', '"'))
def _(s, d):
    page = F.concat(F.lit('<meta http-equiv="refresh" content="0;url='), "landing", F.lit('">'))
    return B.ads(s, d).select(F.col("id").alias("page_id"), G.meta_refresh(page).alias("target"))


@query("g09_title_text", f"SELECT id AS page_id, {B.title('html')} AS title, length({B.text('html')}) AS n FROM ads")
def _(s, d):
    return t(s, d, "pages").select("page_id", G.title(F.col("html")).alias("title"), F.length(G.visible_text(F.col("html"))).cast("long").alias("n"))


# ---- chains: hops of a chain are three URLs of an ad ----

HOPS_SQL = "hops AS (SELECT id, 0 AS hop, landing AS url FROM ads UNION ALL SELECT id, 1, url FROM ads UNION ALL SELECT id, 2, final_url FROM ads)"


def _hops(s, d) -> DataFrame:
    return H.hops_of(B.ads(s, d).withColumn("chain", F.array("landing", "url", "final_url")), "id", "chain")


@query("h01_clean_chain", f"SELECT id, array_to_string(list_filter([landing, CASE WHEN url <> landing THEN url END, CASE WHEN final_url <> landing AND final_url <> url THEN final_url END], lambda u: u IS NOT NULL AND NOT {B.any_end('lower(u)', R.EXTENSIONS)}), ' ') AS chain FROM ads")
def _(s, d):
    return B.ads(s, d).select("id", F.array_join(H.clean_chain(F.array("landing", "url", "final_url")), " ").alias("chain"))


@query("h02_clean_responses", f"{HOPS_SQL}, r AS (SELECT *, CASE WHEN hop = 1 THEN 404 ELSE 200 END AS status FROM hops) SELECT id, min(hop) AS hop, url FROM r WHERE status IN (200, 301, 302, 303, 307, 308) AND NOT {B.any_in('lower(url)', R.NOISE)} GROUP BY id, url")
def _(s, d):
    rows = _hops(s, d).withColumn("status", F.when(F.col("hop") == 1, 404).otherwise(200))
    rows = rows.where(F.col("status").isin(200, 301, 302, 303, 307, 308) & ~O.contains_any(F.lower("url"), R.NOISE))
    return rows.groupBy("id", "url").agg(F.min("hop").alias("hop"))


REAL, DOMAIN = "CASE WHEN id % 4 = 0 THEN concat('get', id % 5, '.example.net/p?x=', id) END", "CASE WHEN id % 3 = 0 THEN concat('shop', id % 5, '.example.org') END"


@query("h03_offer_choice", B.offer_choice("ads", "final_url", ["landing", "url", "new_tab"], REAL, DOMAIN, "landing"))
def _(s, d):
    chain = F.array("landing", "url", "new_tab")
    best = H.offer_choice(F.col("final_url"), chain, F.expr(REAL), F.expr(DOMAIN), F.col("landing"))
    return B.ads(s, d).select("id", best.alias("b")).select("id", "b.*")


_CAPTURES = ((0, "new_tab", "new_tab", "15", "true"), (1, "final_url", "page_final", "10", "final_url <> landing"), *((i, u, "network", f"5 + CASE WHEN {B.any_in(f'lower({u})', R.CAPTURE_MARKS)} THEN 8 ELSE 0 END + CASE WHEN contains(lower({u}), 'melodyeu') THEN 5 ELSE 0 END", f"NOT {B.any_in(B.host(u), R.AD_TECH_HOSTS)} AND {B.host(u)} <> {B.host('landing')}") for i, u in ((2, "url"), (3, "final_url"))))


@query("h04_capture_ranking", "c AS (" + " UNION ALL ".join(f"SELECT id, {i} AS nth, {u} AS url, '{m}' AS source, {n} AS score FROM ads WHERE {w} AND {B.reject_reason(u)} IS NULL" for i, u, m, n, w in _CAPTURES) + ") SELECT id, url, source, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nth) AS n FROM c) WHERE n = 1")
def _(s, d):
    best = H.best_capture(F.array_compact(F.array("new_tab")), F.col("final_url"), F.array("url", "final_url"), F.col("landing"))
    return B.ads(s, d).select("id", best.alias("b")).where("b IS NOT NULL").select("id", "b.url", "b.source", "b.score")


@query("h06_longest_valid", f"{HOPS_SQL} SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(url) DESC, hop) AS n FROM hops WHERE {B.meaningful('url')}) WHERE n = 1")
def _(s, d):
    return N.first_per(_hops(s, d).where(O.meaningful(F.col("url"))), ["id"], F.desc(F.length("url")), "hop").select("id", "url")


EDGES_SQL = "edges AS (SELECT user_id AS f, min(event_id % 150) AS t FROM events GROUP BY user_id)"


def _edges(s, d) -> DataFrame:
    return t(s, d, "events").selectExpr("concat('u', user_id) AS from_url", "concat('u', event_id % 150) AS to_url").where("from_url is not null")


E_SQL = """WITH RECURSIVE e AS (SELECT concat('u', user_id) AS f, min(concat('u', event_id % 150)) AS t FROM events GROUP BY 1),
 w(u, final, seen) AS (SELECT f, f, [f] FROM e UNION ALL SELECT u, e.t, list_append(seen, e.t) FROM w JOIN e ON e.f = w.final WHERE len(seen) <= 8 AND NOT list_contains(seen, e.t))
 SELECT u AS url, arg_max(final, len(seen)) AS final, max(len(seen)) - 1 AS hops FROM w GROUP BY u"""


@query("h07_follow_redirects", E_SQL, ads=False)
def _(s, d):
    edges = _edges(s, d)
    return H.follow(edges, edges.select(F.col("from_url").alias("url"))).drop("chain")


@query("h08_resolve_many", E_SQL.replace(" SELECT u AS url, arg_max(final, len(seen)) AS final, max(len(seen)) - 1 AS hops FROM w GROUP BY u", ", r AS (SELECT u, arg_max(final, len(seen)) AS final FROM w GROUP BY u) SELECT event_id, CASE WHEN event_type = 'click' THEN r.final ELSE r.u END AS resolved FROM events JOIN r ON r.u = concat('u', user_id)"), ads=False)
def _(s, d):
    edges = _edges(s, d)
    done = H.follow(edges, edges.select(F.col("from_url").alias("url")))
    rows = t(s, d, "events").selectExpr("event_id", "event_type", "concat('u', user_id) AS url")
    return rows.join(done, "url", "left").select("event_id", F.when(F.col("event_type") == "click", F.coalesce("final", "url")).otherwise(F.col("url")).alias("resolved"))


@query("h10_last_meaningful", f"{HOPS_SQL} SELECT id, arg_max(url, hop) AS url FROM hops WHERE {B.meaningful('url')} GROUP BY id")
def _(s, d):
    return H.last_meaningful(_hops(s, d), "id")


@query("h11_repair_final", f"SELECT id, CASE WHEN {B.any_in('lower(final_url)', R.API_ENDPOINTS)} THEN CASE WHEN {B.meaningful('url')} THEN url ELSE landing END ELSE final_url END AS final_url FROM ads")
def _(s, d):
    real = F.when(O.meaningful(F.col("url")), F.col("url")).otherwise(F.col("landing"))
    return B.ads(s, d).select("id", F.when(O.contains_any(F.lower("final_url"), R.API_ENDPOINTS), real).otherwise(F.col("final_url")).alias("final_url"))


@query("h12_chain_json", "SELECT id, CASE id % 3 WHEN 2 THEN '' ELSE concat(landing, ' ', final_url) END AS chain FROM ads")
def _(s, d):
    text = F.when(F.col("id") % 3 == 0, F.to_json(F.array("landing", "final_url"))).when(F.col("id") % 3 == 1, F.to_json(F.array(F.struct(F.col("landing").alias("url")), F.struct(F.col("final_url").alias("url"))))).otherwise(F.lit("[broken"))
    return B.ads(s, d).select("id", F.array_join(H.chain_json(text), " ").alias("chain"))


@query("h14_first_per_host", f"{HOPS_SQL}, k AS (SELECT id, {B.host('url')} AS host, min(hop) AS hop, arg_min(url, hop) AS url FROM hops WHERE NOT {B.any_in(B.host('url'), R.BIG_TECH)} GROUP BY 1, 2) SELECT id, host, hop, url, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(url, {B.q('(?i)' + p)}) THEN {B.q(n)} END" for n, p in R.HTML_TRACKERS) + ") AS tools FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop) AS n FROM k) WHERE n <= 10")
def _(s, d):
    return H.first_per_host(_hops(s, d), "id").select("id", "host", "hop", "url", F.array_join("tools", ",").alias("tools"))


@query("h15_url_pool", f"{HOPS_SQL} SELECT id, count(DISTINCT url) AS n FROM hops GROUP BY id")
def _(s, d):
    return B.ads(s, d).select("id", F.size(F.array_distinct(F.array_compact(F.array("landing", "url", "final_url")))).cast("long").alias("n"))


NETS = [(n, ds) for n, ds in R.AFFILIATE_HOSTS.items()]


_TOOLS = list(R.TRACKER_PATTERNS.items())


@query("d03_chain_detection", f"{HOPS_SQL}, e AS (SELECT id, hop, {B.first_match('lower(url)', NETS[::-1])} AS n, {B.first_match('lower(url)', _TOOLS[::-1])} AS t, {B.first_regex('lower(url)', R.PARAM_TRACKERS)} AS p FROM hops) SELECT id, coalesce(arg_max(n, hop) FILTER (n IS NOT NULL), 'Direct / Private') AS network, coalesce(arg_max(t, hop) FILTER (t IS NOT NULL), arg_min(p, hop) FILTER (p IS NOT NULL), 'Direct / Unknown') AS tracker FROM e GROUP BY id")
def _(s, d):
    return H.chain_entities(_hops(s, d), "id", NETS, _TOOLS, R.PARAM_TRACKERS)


@query("d05_network_of_pool", f"{HOPS_SQL}, r AS (SELECT id, hop, unnest([" + ", ".join(B.tier("url", i) for i in range(len(R.NETWORK_TIERS))) + "]) AS r FROM hops) SELECT id, r.n AS network, r.c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r.c <> 'high', CASE WHEN r.c = 'high' THEN hop ELSE -hop END, r.p) AS k FROM r WHERE r IS NOT NULL) WHERE k = 1")
def _(s, d):
    return H.network_of_pool(_hops(s, d), "id")


@query("d06_tracker_of_pool", f"{HOPS_SQL}, u AS (SELECT id, arg_min(tr, hop) AS tr FROM (SELECT id, hop, {B.url_tracker('url')} AS tr FROM hops) WHERE tr IS NOT NULL GROUP BY id) SELECT ads.id, coalesce(u.tr, {B.page_tracker('html')}, CASE WHEN ads.id % 5 = 0 THEN 'Hyros' END) AS tracker FROM ads LEFT JOIN u ON u.id = ads.id")
def _(s, d):
    # what a page says is found before the join, so html isn't shuffled
    hit = _hops(s, d).withColumn("tr", O.url_tracker(F.col("url"))).where("tr is not null").groupBy("id").agg(F.min_by("tr", "hop").alias("tr"))
    held = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("hyros_data"), F.lit("x")))
    of_page = B.ads(s, d).select("id", O.page_tracker(F.col("html"), held).alias("of_page"))
    return of_page.join(hit, "id", "left").select("id", F.coalesce("tr", "of_page").alias("tracker"))


_POOL = f"hops AS (SELECT id, 0 AS hop, landing AS url FROM ads UNION ALL SELECT id, 1, {B.CODED} FROM ads UNION ALL SELECT id, 2, final_url FROM ads WHERE id % 2 = 0)"


@query("e12_pool_merge", f"{_POOL}, v AS (SELECT id, hop, {', '.join(f'{B.decoded("url", k)} AS {k}' for k in P.DECODED)} FROM hops) SELECT id, {', '.join(f'arg_max({k}, hop) FILTER ({k} IS NOT NULL) AS {k}' for k in P.DECODED)} FROM v GROUP BY id")
def _(s, d):
    pool = F.array(F.col("landing"), F.expr(B.CODED), F.when(F.col("id") % 2 == 0, F.col("final_url")))
    hops = H.hops_of(B.ads(s, d).select("id", pool.alias("urls")), "id", "urls").where("url IS NOT NULL")
    hops = hops.withColumn("pairs", U.pairs(F.col("url")))
    return H.last_values(hops, "id", P.decoded_ids(F.col("url"), lambda n: U.value_of(F.col("pairs"), n)))


_E1 = (("offer_id", ("offerId", "offer_id", "oid")), ("affiliate_id", ("affiliateId", "affiliate_id", "aid", "pubId")), ("campaign_id", ("campaignId",)), ("click_id", ("clickId",)), ("traffic_source_id", ("trafficSourceId",)))


@query("e01_payload", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey AS VARCHAR) END AS offer_id, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_custkey AS VARCHAR) END AS affiliate_id, CASE WHEN o_orderkey % 5 < 4 THEN concat('c', o_orderkey % 7) END AS campaign_id, CASE WHEN o_orderkey % 5 < 4 THEN concat('k', o_orderkey) END AS click_id, CASE WHEN o_orderkey % 5 < 4 THEN concat('t', o_orderkey % 3) END AS traffic_source_id FROM orders", ads=False)
def _(s, d):
    # each alias in turn, no offer in the fourth kind, and a broken payload in the fifth
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % 5 + 1).cast("int"))
    text = F.concat(
        F.lit('{"'), name(("offerId", "offer_id", "oid", "none", "x")), F.lit('":"'), key.cast("string"), F.lit('","'), name(("affiliateId", "affiliate_id", "aid", "pubId", "x")), F.lit('":"'), cust,
        F.lit('","campaignId":"c'), (key % 7).cast("string"), F.lit('","clickId":"k'), key.cast("string"), F.lit('","trafficSourceId":"t'), (key % 3).cast("string"), F.when(key % 5 == 4, F.lit('"')).otherwise(F.lit('"}')),
    )
    value = F.rtrim(F.base64(F.encode(text, "utf-8")), F.lit("="))  # padding is often missing
    rows = t(s, d, "orders").select(key.alias("id"), P.json_payload(value, dict(_E1)).alias("p"))
    return rows.select("id", "p.*")


# ---- joins ----

ORD = "SELECT o_orderkey, o_custkey FROM orders"


@query("i04_favourites", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", ads=False)
def _(s, d):
    mine = t(s, d, "customer").where("c_nationkey = 3")
    return t(s, d, "orders").join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("i05_cache", f"h AS (SELECT DISTINCT {B.host('url')} AS host FROM ads), c AS (SELECT DISTINCT {B.host('url')} AS host FROM ads WHERE id % 4 = 0) SELECT h.host, c.host IS NOT NULL AS hit FROM h LEFT JOIN c ON c.host = h.host")
def _(s, d):
    hosts = B.ads(s, d).select("id", U.host(F.col("url")).alias("host"))
    cache = hosts.where("id % 4 = 0").select("host").distinct().withColumn("hit", F.lit(True))
    return hosts.select("host").distinct().join(cache, "host", "left").select("host", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("i06_same_advertiser", f"k AS (SELECT id, {B.host('url')} AS host FROM ads) SELECT a.id, count(*) AS others, min(b.id) AS oldest FROM k a JOIN k b ON a.host = b.host AND a.id <> b.id GROUP BY a.id")
def _(s, d):
    # others of a host from per-host counts and the two smallest ids: no pairs are made
    k = B.ads(s, d).select("id", U.host(F.col("url")).alias("host"))
    per = k.groupBy("host").agg(F.count("*").alias("n"), F.min("id").alias("a"))
    second = k.join(per.select("host", "a"), "host").where("id <> a").groupBy("host").agg(F.min("id").alias("b"))
    rows = k.join(per, "host").join(second, "host")
    return rows.select("id", (F.col("n") - 1).alias("others"), F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("oldest"))


@query("i07_same_title", r"k AS (SELECT id, regexp_replace(lower(trim(title)), '\s+', ' ', 'g') AS t FROM ads) SELECT a.id, count(*) - 1 AS others FROM k a JOIN k b ON a.t = b.t GROUP BY a.id HAVING count(*) > 1")
def _(s, d):
    k = B.ads(s, d).select("id", T.normal_title(F.col("title")).alias("t"))
    n = k.groupBy("t").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return k.join(n, "t").select("id", "others")


ORIGIN = "concat(array_to_string(list_slice(string_split({u}, '/'), 1, 3), '/'), '/')"


@query("i09_link_content", f"{ANCHORS_SQL}, l AS (SELECT DISTINCT id, {ORIGIN.format(u=ABS)} AS o FROM a), f AS (SELECT {ORIGIN.format(u='url')} AS o, min(id) AS front, min(length(html)) AS least FROM ads GROUP BY 1) SELECT l.id AS page_id, f.front, f.least FROM l JOIN f USING (o)")
def _(s, d):
    links = G.anchors(t(s, d, "pages")).select("page_id", U.origin(F.col("absolute")).alias("o")).distinct()
    fronts = B.ads(s, d).groupBy(U.origin(F.col("url")).alias("o")).agg(F.min("id").alias("front"), F.min(F.length("html").cast("long")).alias("least"))
    return links.join(fronts, "o").select("page_id", "front", "least")


@query("i10_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", ads=False)
def _(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---- profiles ----

_NEWEST = "(list({c} ORDER BY created_day DESC, id) FILTER (nullif({c}, '') IS NOT NULL))[1]"
_SET = "list_sort(list(DISTINCT {c}) FILTER (nullif({c}, '') IS NOT NULL))"
_PROFILED = f"o AS (SELECT *, {B.host('landing')} AS advertiser, {B.registered_domain('final_url')} AS offer, {B.registered_domain('final_url')} AS offer_domain, {B.first_param('landing', R.OFFER_ALIASES)} AS offer_id, {B.first_param('landing', R.AFFILIATE_ALIASES)} AS affiliate_id, {B.first_match('lower(final_url)', R.VERTICALS)} AS vertical FROM ads)"
_COMMON = ", ".join(["count(*) AS ads", *(f"coalesce(array_to_string({_SET.format(c=c)}, ','), '') AS {n}" for c, n in (("network", "networks"), ("country_code", "geos"), ("tracker_tool", "trackers"))), f"coalesce({_NEWEST.format(c='affiliate_network')}, 'Direct/In-house') AS affiliate_network", "sum(coalesce(impressions, 1)) AS impressions", "min(created_day) AS first_seen", "max(created_day) AS last_seen"])


def _profiled(s, d) -> DataFrame:
    ids = P.generic_ids(F.col("landing"))
    rows = B.ads(s, d).withColumn("advertiser", U.host(F.col("landing"))).withColumn("offer", U.registered_domain(F.col("final_url"))).withColumn("offer_domain", F.col("offer"))
    return rows.withColumn("offer_id", ids["offer_id"]).withColumn("affiliate_id", ids["affiliate_id"]).withColumn("vertical", O.first_match(F.lower("final_url"), R.VERTICALS))


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else c for c, kind in df.dtypes))


@query("j03_advertiser_profile", f"{_PROFILED} SELECT advertiser, {_COMMON}, coalesce(array_to_string({_SET.format(c='vertical')}, ','), '') AS verticals, count(DISTINCT offer) AS offers FROM o WHERE advertiser <> '' GROUP BY advertiser")
def _(s, d):
    return _joined(PR.advertisers(_profiled(s, d), "advertiser"))


@query("j04_offer_profile", f"{_PROFILED} SELECT offer_id, {_COMMON}, count(DISTINCT affiliate_id) AS affiliates, coalesce({_NEWEST.format(c='vertical')}, 'General') AS vertical, coalesce({_NEWEST.format(c='offer_domain')}, offer_id) AS offer_domain, {_NEWEST.format(c='final_url')} AS final_url, {_NEWEST.format(c='landing')} AS landing FROM o WHERE offer_id <> '' GROUP BY offer_id")
def _(s, d):
    return _joined(PR.offers(_profiled(s, d), "offer_id"))


@query("j01_counts", "SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS recent FROM events", ads=False)
def _(s, d):
    return t(s, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp")).alias("recent"))


@query("j02_per_network", "SELECT network, count(*) AS n FROM ads GROUP BY network")
def _(s, d):
    return B.ads(s, d).groupBy("network").agg(F.count("*").alias("n"))


@query("j05_network_share", "c AS (SELECT l_suppkey AS advertiser, l_returnflag AS network, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT advertiser, network, n, round(100.0 * n / sum(n) OVER (PARTITION BY advertiser), 2)::DOUBLE AS share FROM c")
def _(s, d):
    c = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("advertiser"), F.col("l_returnflag").alias("network")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("advertiser")), 2))


_TITLED = "CASE id % 3 WHEN 0 THEN concat('Look: ', title, ' ', id % 4) WHEN 1 THEN upper(title) ELSE title END"
_NORMAL = r"trim(regexp_replace(lower(x), '[\s\p{Z}\x{FEFF}]+', ' ', 'g'))"


@query("j06_advertiser_intelligence", f"""r AS (SELECT id, {B.host('url')} AS host, {_TITLED} AS title, network, impressions, created_day FROM ads), k AS (SELECT *, {_NORMAL.replace('(x)', '(title)')} AS t FROM r),
 a AS (SELECT host, count(*) AS total, list_sort(list(DISTINCT network)) AS networks, count(DISTINCT title) AS titles, max(created_day) - min(created_day) AS days, list(concat(id, ':', substring(title, 1, 60)) ORDER BY created_day DESC, id DESC)[1:5] AS recent FROM k GROUP BY host),
 p AS (SELECT k.id, o.id AS other, o.network, o.t <> k.t AS near FROM k JOIN k o ON o.id <> k.id AND (o.t = k.t OR (o.host = k.host AND length(k.t) > 10 AND length(o.t) > 10 AND (contains(o.t, substring(k.t, 1, 20)) OR contains(k.t, substring(o.t, 1, 20)))))),
 n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY near, other) AS i FROM p QUALIFY i <= 10), m AS (SELECT id, string_agg(other, ',' ORDER BY i) AS matches, count(DISTINCT network) > 1 AS cross_network FROM n GROUP BY id)
 SELECT k.id, k.host, total, array_to_string(networks, ',') AS networks, titles, days, array_to_string(recent, ';') AS recent, coalesce(matches, '') AS matches, coalesce(cross_network, false) AS cross_network FROM k JOIN a ON a.host = k.host LEFT JOIN m ON m.id = k.id""")
def _(s, d):
    ads = B.ads(s, d).select("id", U.host(F.col("url")).alias("host"), F.expr(_TITLED).alias("title"), "network", "impressions", "created_day")
    found = PR.intelligence(ads, "host")
    recent = F.array_join(F.transform("recent", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["title"])), ";")
    matches = F.array_join(F.transform("matches", lambda x: x["id"].cast("string")), ",")
    return found.select("id", "host", "total", F.array_join("networks", ",").alias("networks"), "titles", "days", recent.alias("recent"), matches.alias("matches"), "cross_network")


@query("j07_tracker_histogram", f"SELECT coalesce({B.tracking_tool('landing')}, 'No Tracking') AS tracker, count(*) AS n FROM ads GROUP BY 1")
def _(s, d):
    return B.ads(s, d).groupBy(F.coalesce(O.tracking_tool(F.col("landing")), F.lit("No Tracking")).alias("tracker")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tracker")


@query("j08_outcomes", "SELECT ad_type, count(*) AS n FROM ads GROUP BY ad_type")
def _(s, d):
    return B.ads(s, d).groupBy("ad_type").agg(F.count("*").alias("n"))


@query("j09_run_summary", "SELECT network, country_code, count(*) AS n FROM ads GROUP BY ROLLUP (network, country_code)")
def _(s, d):
    return B.ads(s, d).rollup("network", "country_code").agg(F.count("*").alias("n"))


@query("j10_audit", r"SELECT count(*) FILTER (language = '') AS no_language, count(*) FILTER (affiliate_network IS NULL) AS no_network, count(*) FILTER (regexp_matches(title, '[\x{0600}-\x{06FF}]') AND language <> 'ar') AS mislabelled FROM ads")
def _(s, d):
    return B.ads(s, d).agg(F.count_if(F.col("language") == "").alias("no_language"), F.count_if(F.col("affiliate_network").isNull()).alias("no_network"), F.count_if(T.arabic(F.col("title")) & (F.col("language") != "ar")).alias("mislabelled"))


@query("j11_facet_values", "SELECT 'network' AS facet, network AS value, count(*) AS n FROM ads GROUP BY network UNION ALL SELECT 'country', country_code, count(*) FROM ads GROUP BY country_code")
def _(s, d):
    pairs = F.explode(F.array(F.struct(F.lit("network").alias("facet"), F.col("network").alias("value")), F.struct(F.lit("country").alias("facet"), F.col("country_code").alias("value"))))
    return B.ads(s, d).select(pairs.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("j12_facet_sets", "SELECT network, country_code, ad_type, count(*) AS n FROM ads GROUP BY GROUPING SETS ((network), (country_code), (ad_type), ())")
def _(s, d):
    a = B.ads(s, d)
    return a.groupingSets([[F.col("network")], [F.col("country_code")], [F.col("ad_type")], []], "network", "country_code", "ad_type").agg(F.count("*").alias("n"))


@query("j13_paid_users", "SELECT count(*) AS users, count(*) FILTER (c_mktsegment <> 'BUILDING') AS paid FROM customer", ads=False)
def _(s, d):
    return t(s, d, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_mktsegment") != "BUILDING").alias("paid"))


@query("j14_confirmed", f"SELECT count(*) FILTER ({B.named_network('landing')} IS NOT NULL) AS confirmed FROM ads")
def _(s, d):
    return B.ads(s, d).agg(F.count_if(O.affiliate_network(F.col("landing"))["confidence"] == "high").alias("confirmed"))


@query("j15_approx_distinct")
def _(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.approx_count_distinct("l_partkey", 0.02).alias("offers"))


# ---- windows, dedupe, order ----


@query("k01_first_sighting", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type", ads=False)
def _(s, d):
    return t(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("k02_preferred_sighting", "SELECT t, id FROM (SELECT lower(substring(trim(title), 1, 80)) AS t, id, row_number() OVER (PARTITION BY lower(substring(trim(title), 1, 80)) ORDER BY impressions IS NULL, contains(landing, 'track'), id) AS n FROM ads) WHERE n = 1")
def _(s, d):
    a = B.ads(s, d).withColumn("t", F.lower(F.substring(F.trim("title"), 1, 80)))
    return N.first_per(a, ["t"], F.col("impressions").isNull(), F.col("landing").contains("track"), "id").select("t", "id")


for _name, _n in (("k03_latest_50", 50), ("k04_latest_5", 5)):

    @query(_name, f"SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= {_n}", ads=False)
    def _(s, d, n=_n):
        return N.latest_per(t(s, d, "lineitem"), ["l_suppkey"], n, F.desc("l_shipdate"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("k05_best_candidate", "SELECT l_orderkey, arg_max(l_partkey, l_extendedprice * 10 - l_linenumber) AS part FROM lineitem GROUP BY l_orderkey", ads=False)
def _(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.col("l_extendedprice") * 10 - F.col("l_linenumber")).alias("part"))


@query("k06_share", "c AS (SELECT country_code, network, count(*) AS n FROM ads GROUP BY 1, 2) SELECT country_code, network, (n * 1.0 / sum(n) OVER (PARTITION BY country_code))::DOUBLE AS share FROM c")
def _(s, d):
    c = B.ads(s, d).groupBy("country_code", "network").agg(F.count("*").alias("n"))
    return c.select("country_code", "network", (F.col("n") / F.sum("n").over(Window.partitionBy("country_code"))).alias("share"))


@query("k07_first_last", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id", ads=False)
def _(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("l01_search", "SELECT id, title, impressions FROM ads WHERE title ILIKE '%trend%' AND network IN ('MGID', 'Taboola') AND impressions >= 10 ORDER BY created_day DESC, id LIMIT 20 OFFSET 5")
def _(s, d):
    a = B.ads(s, d).where(F.col("title").ilike("%trend%") & F.col("network").isin("MGID", "Taboola") & (F.col("impressions") >= 10))
    return a.orderBy(F.desc("created_day"), "id").offset(5).limit(20).select("id", "title", "impressions")


_FACETS = {
    "network": ["MGID", "Taboola", "Outbrain"], "language": ["en", "fr"], "ad_type": ["Affiliate", "Unknown"], "offer_vertical": ["Health/Supplements", "Unknown"], "affiliate_network": ["ClickBank", "Everflow", "Unknown"],
    "tracker_tool": ["Voluum"], "page_subtype": ["Landing Page", "Direct Checkout", "VSL (Video Sales Letter)"], "cloaking_type": [], "country_code": ["US", "DE", "FR", "MA"],
}


@query("l02_faceted_search", f"o AS (SELECT *, coalesce({B.first_match('lower(final_url)', R.VERTICALS)}, 'Unknown') AS offer_vertical, coalesce({B.first_match('lower(final_url)', [(n, [p]) for p, n in R.PAGE_TYPES])}, 'Landing Page') AS page_subtype FROM ads), m AS (SELECT * FROM o WHERE " + " AND ".join(B.one_of(c, v) for c, v in _FACETS.items() if v) + " AND contains(lower(title), 'o') AND impressions >= 5) SELECT id, total FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY created_day DESC, id) AS n FROM m) WHERE n <= 30")
def _(s, d):
    last = F.lower("final_url")
    a = B.ads(s, d).withColumn("offer_vertical", F.coalesce(O.first_match(last, R.VERTICALS), F.lit("Unknown")))
    a = a.withColumn("page_subtype", F.coalesce(O.first_match(last, [(n, [p]) for p, n in R.PAGE_TYPES]), F.lit("Landing Page"))).withColumn("cloaking_type", O.cloaking(F.col("landing"), F.col("final_url"))["kind"])
    return PR.faceted_search(a, _FACETS, text="O", least=5)


@query("l03_keyword_top", "SELECT id, impressions FROM ads WHERE contains(lower(title), 'keto') ORDER BY impressions DESC NULLS LAST, id LIMIT 20")
def _(s, d):
    return B.ads(s, d).where(F.lower("title").contains("keto")).orderBy(F.desc_nulls_last("impressions"), "id").limit(20).select("id", "impressions")


@query("l04_digest", "x AS (SELECT title, row_number() OVER (ORDER BY impressions DESC NULLS LAST, id) AS n FROM ads) SELECT string_agg(concat(n, '. ', title), chr(10) ORDER BY n) AS digest FROM x WHERE n <= 15")
def _(s, d):
    top = B.ads(s, d).orderBy(F.desc_nulls_last("impressions"), "id").limit(15)
    numbered = top.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("impressions"), "id")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["title"]))
    return numbered.agg(F.array_join(lines, "\n").alias("digest"))


@query("l05_filter_sort", "SELECT id, impressions FROM ads WHERE contains(lower(title), 'now') ORDER BY impressions DESC NULLS LAST, id")
def _(s, d):
    return B.ads(s, d).where(F.lower("title").contains("now")).orderBy(F.desc_nulls_last("impressions"), "id").select("id", "impressions")


@query("l06_plan_limit", "x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), p AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 10 END AS most FROM customer) SELECT o_custkey, o_orderkey FROM x JOIN p ON o_custkey = c_custkey WHERE n <= most")
def _(s, d):
    plans = t(s, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 3).otherwise(10).alias("most"))
    rows = N.latest_per(t(s, d, "orders"), ["o_custkey"], 10, "o_orderkey")
    return rows.join(plans, F.col("o_custkey") == F.col("c_custkey")).where("rank <= most").select("o_custkey", "o_orderkey")


@query("l07_keyset_page", "SELECT id, created_day FROM ads WHERE created_day < 30 OR (created_day = 30 AND id > 100) ORDER BY created_day DESC, id LIMIT 25")
def _(s, d):
    return B.ads(s, d).where("created_day < 30 OR (created_day = 30 AND id > 100)").orderBy(F.desc("created_day"), "id").limit(25).select("id", "created_day")


@query("l08_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40", ads=False)
def _(s, d):
    return t(s, d, "events").orderBy(F.desc("ts"), "event_id").limit(40).select("event_id")


# ---- sets ----


@query("m01_union", "SELECT id, landing AS link, 0 AS seq FROM ads UNION ALL SELECT id, final_url, 1 FROM ads")
def _(s, d):
    a = B.ads(s, d)
    return a.select("id", F.col("landing").alias("link"), F.lit(0).alias("seq")).unionByName(a.select("id", F.col("final_url").alias("link"), F.lit(1).alias("seq")))


@query("m02_any_pattern", "SELECT id FROM ads WHERE regexp_matches(landing, 'track|click|redir')")
def _(s, d):
    return B.ads(s, d).where(F.col("landing").rlike("track|click|redir")).select("id")


@query("m03_exact_or_fuzzy", "SELECT id FROM ads WHERE title = 'Trending now 5' OR contains(lower(title), 'keto')")
def _(s, d):
    a = B.ads(s, d).select("id", "title")
    exact, fuzzy = a.where("title = 'Trending now 5'"), a.where(F.lower("title").contains("keto"))
    return exact.union(fuzzy.join(exact.select("id"), "id", "left_anti").select("id", "title")).select("id")


@query("m04_set_difference", "SELECT id, len(list_filter([landing, url], lambda x: x <> final_url AND x IS NOT NULL)) - CASE WHEN landing = url AND landing <> final_url THEN 1 ELSE 0 END AS n FROM ads")
def _(s, d):
    return B.ads(s, d).select("id", F.size(F.array_except(F.array("landing", "url"), F.array("final_url"))).cast("long").alias("n"))


# ---- upsert, backfill, repair ----


@query("n01_sighting_upsert", "SELECT user_id, event_type, count(*) AS impressions, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(value, event_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY user_id, event_type".replace("arg_max(value, event_id)", "max(value) FILTER (n = 1)"), ads=False)
def _(s, d):
    return N.fold_sightings(t(s, d, "events"), ["user_id", "event_type"], "ts", ["event_id", "value"]).drop("event_id")


@query("n02_title_upsert", "SELECT lower(substring(trim(title), 1, 80)) AS t, count(*) AS n, arg_max(landing, (CASE WHEN contains(landing, 'track') THEN 0 ELSE 1 END) * 1000000 + id) AS landing FROM ads GROUP BY 1")
def _(s, d):
    order = F.struct((~F.col("landing").contains("track")).cast("int").alias("a"), F.col("id"))
    return B.ads(s, d).groupBy(F.lower(F.substring(F.trim("title"), 1, 80)).alias("t")).agg(F.count("*").alias("n"), F.max_by("landing", order).alias("landing"))


for _name, _policy, _cond in (("n05_fill_default", "default", "affiliate_network IS NULL OR affiliate_network IN ('', 'Direct / Unknown', 'Direct / Private', 'Unknown', 'No Tracking', 'No Tracker')"), ("n06_fill_different", "different", "true"), ("n07_fill_null", "null", "affiliate_network IS NULL")):

    @query(_name, f"SELECT id, CASE WHEN ({_cond}) AND {B.affiliate_network('landing')} IS NOT NULL THEN {B.affiliate_network('landing')} ELSE affiliate_network END AS affiliate_network FROM ads")
    def _(s, d, policy=_policy):
        return B.ads(s, d).select("id", N.fill(F.col("affiliate_network"), O.affiliate_network(F.col("landing"))["network"], policy).alias("affiliate_network"))


FEEDBACK = f"f AS (SELECT {B.host('url')} AS host, CASE WHEN max(id) % 2 = 0 THEN 'Affiliate' ELSE 'Arbitrage' END AS forced FROM ads WHERE id % 5 = 0 GROUP BY 1)"


@query("n12_human_correction", f"{FEEDBACK} SELECT ads.id, coalesce(f.forced, ads.ad_type) AS ad_type FROM ads LEFT JOIN f ON f.host = {B.host('ads.url')}")
def _(s, d):
    a = B.ads(s, d).withColumn("host", U.host(F.col("url")))
    forced = a.where("id % 5 = 0").groupBy("host").agg(F.expr("CASE WHEN max(id) % 2 = 0 THEN 'Affiliate' ELSE 'Arbitrage' END").alias("forced"))
    return a.join(forced, "host", "left").select("id", F.coalesce("forced", "ad_type").alias("ad_type"))


@query("f10_knowledge_override", f"k AS (SELECT {B.host('final_url')} AS domain, CASE WHEN page_id % 2 = 0 THEN 'Affiliate' ELSE 'Arbitrage' END AS forced, page_id AS seen FROM (SELECT *, id AS page_id FROM ads WHERE id % 6 = 4)), f AS (SELECT domain, arg_max(forced, seen) AS forced FROM k GROUP BY domain) SELECT ads.id, f.forced, coalesce(f.forced, ads.ad_type) AS verdict FROM ads LEFT JOIN f ON f.domain = {B.host('ads.final_url')}")
def _(s, d):
    a = B.ads(s, d).withColumn("domain", U.host(F.col("final_url")))
    given = a.where("id % 6 = 4").select("domain", F.when(F.col("id") % 2 == 0, "Affiliate").otherwise("Arbitrage").alias("forced_type"), F.col("id").alias("updated_at"))
    return S.knowledge_override(a, given, "domain", "ad_type").select("id", "forced", "verdict")


@query("n14_change_set", "SELECT id, 'language' AS field, language AS old_value, 'en' AS new_value FROM ads WHERE language = ''")
def _(s, d):
    old = B.ads(s, d).select("id", "language", "network")
    new = old.withColumn("language", F.when(F.col("language") == "", "en").otherwise(F.col("language")))
    return N.changes(old, new, "id", ["language", "network"])


_VOTE = lambda lang: f"len(list_filter(w, lambda x: x IN ({', '.join(map(B.q, T.STOP_WORDS[lang]))})))"


@query("o01_language", r"WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+') AS w FROM documents), v AS (SELECT doc_id, t, " + ", ".join(f"{_VOTE(x)} AS {x}" for x in T.STOP_WORDS) + r" FROM w) SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{0600}-\x{06FF}]') THEN 'ar' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS language FROM v", ads=False)
def _(s, d):
    return t(s, d, "documents").select("doc_id", T.language(F.coalesce("text", F.lit(""))).alias("language"))


_FETCH = {
    "status": "CASE id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 WHEN 3 THEN 418 ELSE 200 END", "size": "(length(html) * (id % 9))",
    "last": "CASE WHEN id % 5 = 0 THEN 'https://trkerupper.com/x' ELSE final_url END", "error": "CASE WHEN id % 11 = 0 THEN 'timeout' END",
}
_F = {k: f"({v})" for k, v in _FETCH.items()}


@query("f11_fetch_health", f"SELECT id, CASE WHEN NOT starts_with(final_url, 'http') THEN 'invalid_url_format' WHEN {B.any_in(B.host('final_url'), R.AD_TECH_HOSTS)} THEN 'ad_tech_infrastructure' WHEN {_F['error']} IS NOT NULL THEN {_F['error']} WHEN {_F['status']} = 404 THEN 'http_404_not_found' WHEN {_F['status']} = 403 THEN 'http_403_forbidden' WHEN {_F['status']} = 500 THEN 'http_500_server_error' WHEN {_F['status']} <> 200 THEN concat('http_', {_F['status']}) WHEN {_F['size']} < 3000 THEN 'thin_content' WHEN {_F['last']} <> final_url AND {B.reject_reason(_F['last'])} IS NOT NULL THEN 'redirected_to_invalid_domain' ELSE 'ok' END AS health FROM ads")
def _(s, d):
    f = {k: F.expr(v) for k, v in _FETCH.items()}
    return B.ads(s, d).select("id", S.fetch_health(F.col("final_url"), f["status"], f["size"], f["last"], f["error"]).alias("health"))


# ---- streaming forms, as batch twins ----


@query("p02_daily", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", ads=False)
def _(s, d):
    return ST.daily(t(s, d, "events"))


@query("p05_toggles", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1", ads=False)
def _(s, d):
    return ST.toggled(t(s, d, "events"))


@query("p06_quota", "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1, 2".replace("AS over", "AS above"), ads=False)
def _(s, d):
    e = t(s, d, "events").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("day"), "n", (F.col("n") > 3).alias("above"))


@query("p07_sessions", """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM g) SELECT user_id, event_type, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, event_type, k""", ads=False)
def _(s, d):
    return ST.sessions(t(s, d, "events"), "12 hours")


