"""Known cases of the operators, as literal rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from adlattice import catalog
from adlattice.functions import url as U
from adlattice.operators import chains, links, lookups, params, profiles, rules, store, titles
from adlattice.rules import tables as R
from adlattice.sources import feeds
from adlattice.streaming import sightings

ODD_URLS = [None, "", "a.com/x", "//h/x", "HTTP://WWW.Host.COM/A", "https://user@host:8080/p?q=1#f?x", "https://h.com/?a=1&a=2&b=&d", "https://h.com/?x=%zz&y=%", "https://h.com/?q=a+b", "https://h.com/?s={!x!} y", "https://h.com/ñ/é?x=1", "https://h.com/" + "x" * 900]


def one(spark, url, column):
    return spark.createDataFrame([(url,)], "u string").select(column(F.col("u")).alias("x")).first().x


@pytest.mark.parametrize("url", ODD_URLS)
def test_odd_urls_never_raise(spark, url):
    every = [U.scheme, U.host, U.registered_domain, U.strip_tracking, U.landing_key, U.blank_macros, U.origin, U.peel, U.peel_ad_server, U.clean_thumbnail, U.unescape, U.params, rules.meaningful, rules.reject_reason, rules.has_macro, rules.tracking_tool, rules.prelander]
    spark.createDataFrame([(url,)], "u string").select(*(f(F.col("u")).alias(f"c{i}") for i, f in enumerate(every))).collect()


def test_url_parts(spark):
    assert one(spark, "HTTP://WWW.Host.COM:80/A?b=1#c", U.host) == "host.com"
    assert one(spark, "https://h.com/?a=1&a=2&b=&d&e=x+y", U.params) == {"a": "1", "e": "x y"}
    assert one(spark, "https://h.com/?b=&b=2", lambda u: U.param(u, "b")) == "2"
    assert one(spark, "https://offer.com/?aff_id=123&utm_source=taboola&fbclid=abc&subid=xyz", U.strip_tracking) == "https://offer.com/?aff_id=123&subid=xyz"
    assert one(spark, "https://servicer.idealmedia.io/x?cxurl=https%3A%2F%2Fvsn.ua%2Fa", U.peel_ad_server) == "https://vsn.ua/a"
    assert one(spark, "https://hop.clickbank.net/sellerhop?requestUrl=https%3A%2F%2Fm.com%2Fp", U.peel) == "https://m.com/p"


def test_valid_offers(spark):
    good = ["https://nervovive.com/text.php", "https://completejointcare.net/vsl/?hopId=abc123", "https://healthclubjournal.com/18800025.php?aff=1834"]
    bad = ["https://trkerupper.com/click", "https://images.unsplash.com/photo-123.jpg", "https://assets.checkoutchamp.com/x/video.avif", "https://challenges.cloudflare.com/cdn-cgi/x", "https://optivell.site/opv-site/cards", "https://x.com/?subid2=%7B%21subid%21%7D"]
    assert all(one(spark, u, rules.reject_reason) is None for u in good)
    assert all(one(spark, u, rules.reject_reason) for u in bad)


def test_ids(spark):
    ids = params.clickbank_ids(F.col("u"))
    row = spark.createDataFrame([("https://b1744.completejointcare.hop.clickbank.net",)], "u string").select(*(c.alias(k) for k, c in ids.items())).first()
    assert (row.affiliate_id, row.offer_id) == ("b1744", "completejointcare")
    url = "https://go2cloud.org/aff_c?offer_id=123&aff_id=456"
    row = spark.createDataFrame([(url,)], "u string").select(*(c.alias(k) for k, c in params.hasoffers_ids(F.col("u")).items())).first()
    assert (row.offer_id, row.affiliate_id) == ("123", "456")
    assert one(spark, "https://x.com/?cep=123&lptoken=456&widget_id=789", rules.prelander)


def test_rule_tables_take_the_first_rule(spark):
    rows = spark.createDataFrame([(1, "https://a.b.track.com/x"), (2, "https://none.org")], "id long, url string")
    table = spark.createDataFrame([(2, "b.track.com", "second"), (1, "track.com", "first")], "prio int, pattern string, entity string")
    hosts = rows.withColumn("host", U.host(F.col("url")))
    assert [tuple(r) for r in rules.match_hosts(hosts, "id", "host", table).collect()] == [(1, "first")]
    assert [tuple(r) for r in rules.match_substrings(rows, "id", "url", table).collect()] == [(1, "first")]


def test_follow_stops_at_cycles_and_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")] + [(f"n{i}", f"n{i + 1}") for i in range(20)], "from_url string, to_url string")
    starts = spark.createDataFrame([("a",), ("x",), ("n0",), ("lone",)], "url string")
    got = {r.url: (r.final, r.hops) for r in chains.follow(edges, starts, 8).collect()}
    assert got == {"a": ("c", 2), "x": ("y", 1), "n0": ("n8", 8), "lone": ("lone", 0)}


def test_chain_json(spark):
    rows = {'["u1","u2"]': ["u1", "u2"], '[{"url":"a","status":200},{"from":"b"}]': ["a", "b"], "[]": [], "[broken": [], "": []}
    for text, want in rows.items():
        assert one(spark, text, chains.chain_json) == want


def test_bad_feeds_give_no_rows(spark):
    bad = spark.createDataFrame([(1, "{broken"), (2, ""), (3, None), (4, "[]"), (5, '{"items":[{"title":"t"}]}')], "id long, p string")
    assert feeds.normalise(bad, "id", "p").count() == 0


def test_feeds_at_any_depth(spark):
    item = lambda n: f'{{"title":"t{n}","url":"u{n}","thumbnail":[{{"url":"i{n}"}}]}}'
    deep = item(1)
    for i in range(40):
        deep = f'{{"w{i}":{deep}}}' if i else f'{{"listings":[{deep}]}}'
    rows = {
        "two lists": (f'{{"items":[{item(1)},{item(2)}],"b":{{"documents":[{item(3)}],"doc":[{item(4)}]}}}}', {"u1", "u2", "u3", "u4"}),
        "another wrapper": (f'cb({{"other":{{"ads":[{item(1)}]}}}});', {"u1"}),
        "an object under a list key": (f'{{"documents":{{"doc":[{item(1)}],"n":1}}}}', {"u1"}),
        "another key": (f'{{"x":[{item(1)},{{"url":"no title"}},5]}}', {"u1"}),
        "deep": (deep, {"u1"}),
        "empty first": (f'{{"ads":[],"items":[{item(1)}],"content":"text"}}', {"u1"}),
        "root": (f"[{item(1)},{item(2)}]", {"u1", "u2"}),
        "none": ('{"a":{"b":null,"c":[1,null,[2]]}}', set()),
    }
    got = feeds.normalise(spark.createDataFrame([(k, p) for k, (p, _) in rows.items()], "id string, p string"), "id", "p").collect()
    for k, (_, want) in rows.items():
        mine = [r for r in got if r.id == k]
        assert {r.landing for r in mine} == want and len({r.pos for r in mine}) == len(mine) == len(want), k


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, n int")
    once = store.upsert(old, new, ["k"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert sorted(map(tuple, store.upsert(once, new.limit(0), ["k"], "n").collect())) == sorted(map(tuple, once.collect()))
    assert store.changes(old, old, "k", ["v"]).count() == 0


def test_stream_upsert_equals_batch(spark, tmp_path):
    for part in range(3):
        rows = [(i % 4, f"t{part}", part * 100 + i) for i in range(10)]
        spark.createDataFrame(rows, "user_id long, event_type string, s long").select("user_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = sightings.read_stream(spark, f"{tmp_path}/in", batch)
    sightings.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", "user_id", ["event_type"]).awaitTermination()
    got = sightings.snapshot(spark, f"{tmp_path}/out").select("user_id", "impressions", "first_seen", "last_seen")
    want = store.fold_sightings(batch, ["user_id"], "ts", ["event_type"]).select("user_id", "impressions", "first_seen", "last_seen")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_titles_alike_by_containment(spark):
    lead = "abcdefghij klmnopqrst"  # its first 20 characters are the lead
    names = [
        "trending now 3", "trending now 39", "Trending   Now\t3 ", "see: trending now 3!", "short", "SHORT ", "sho", None, "", "exactly ten", "exactly te",
        lead + " one", lead + " two", "x " + lead, lead[:15], "abcdefghij k", "aaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaa b", "b aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    ]
    table = [(i, f"h{i % 2 if i > 99 else 0}", x) for i, x in enumerate(names + names[:4])] + [(100 + i, "h1", x) for i, x in enumerate(names)] + [(900, None, "short"), (901, None, "short")]
    norm = lambda x: " ".join((x or "").lower().split())
    link = lambda a, b: a == b or (len(a) > 10 and len(b) > 10 and (b[:20] in a or a[:20] in b))
    want = {i: n for i, g, a in table if (n := sum(g == h and i != j and link(norm(a), norm(b)) for j, h, b in table)) and g}
    got = titles.alike(spark.createDataFrame(table, "id int, h string, title string"), "id", "h", "title").collect()
    assert {r.id: r.others for r in got} == want and len(got) == len(want)
    assert want[0] > 3 and want[4] and want[13]


def test_best_links_by_pattern(spark):
    good = lambda n: f"https://shop{n}.com/p?x={n}"
    rows = [
        (1, f'<a class="big Offer-Link" href="{good(1)}">x</a><div data-offer="{good(2)}">', good(1), "class", 10),
        (2, f"<div title='a > b' data-url='{good(2)}'><script>var offerUrl = '{good(3)}';</script>", good(2), "data", 9),
        (3, f'<script>x={{url:"{good(3)}"}}</script><a href="https://y.com/p?aff_id=1">', good(3), "script", 8),
        (4, '<a href="https://www.digistore24.com/redir/1/x"><p data-link="https://y.com/p">', "https://www.digistore24.com/redir/1/x", "network", 10),
        (5, f'<a href="https://y.com/p?a=1&amp;aff_id=1"><meta http-equiv="refresh" content="0; url={good(6)}">', "https://y.com/p?a=1&aff_id=1", "param", 7),
        (6, f"<meta content=\"0;URL='{good(6)}'\" http-equiv=Refresh><a href='{good(7)}'>", good(6), "refresh", 6),
        (7, '<a href="https://hop-apps.clickbank.net/x?destinationUrl=https%3A%2F%2Fshop7.com%2Fp%3Fx%3D7">', good(7), "destination", 10),
        (8, f'<a class=offlink href="https://x.com/a.jpg"><p data-href="{good(8)}">', good(8), "data", 9),  # the best isn't valid
    ]
    pages = spark.createDataFrame([(i, h) for i, h, *_ in rows] + [(9, '<a href="https://trkflstr.com/1"><a href="https://trkflstr.com/2">'), (10, None), (11, "")], "page_id long, html string")
    got = {r.page_id: tuple(r)[1:] for r in links.best_links(pages, "page_id").collect()}
    assert got == {i: (u, m, n, None) for i, _, u, m, n in rows} | {9: (None, None, None, "https://trkflstr.com/2"), 10: (None,) * 4, 11: (None,) * 4}


def test_valid_urls_of_lists(spark, sf_dir):
    words = [*R.STRICT_BLOCK, *R.AD_TECH_HOSTS, *R.INTERMEDIARIES, *R.INVALID_HOSTS, *R.INFRASTRUCTURE]
    urls = [*ODD_URLS, *(f"https://{w}/p?x=1" for w in words), *(f"https://h.com{p}?{q}" for p in (*R.EXACT_PATHS, *R.INVALID_PATHS, *R.BARE_PATHS, "/p", "/a.png") for q in ("", "x=1", "AFF_ID=1", "u={m}"))]
    frame = spark.createDataFrame([(urls,)], "urls array<string>")
    kept = frame.select(F.filter("urls", rules.valid_in_list).alias("x")).first().x
    one_by_one = frame.select(F.explode("urls").alias("u")).where(rules.reject_reason(F.col("u")).isNull())
    assert kept == [r.u for r in one_by_one.collect()] and 0 < len(kept) < len(urls)
    # a URL is split once for each part (the path also for its ending), and configurations are read once for both results
    plan = catalog.queries()["e03_config_payload"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(U.SPLIT) == 4 and plan.count("regexp_extract_all(") == 2


def test_links_to_known_trackers(spark, tmp_path):
    # ids whose final URL is a known tracker, in a page of each kind
    ids = [1496, 1816, 2776, 9056, 11176, 11296, 12256, *range(3161, 3202, 5), *range(60006, 60047, 5)]
    spark.createDataFrame([(i, f"https://site.example.org/{i}", "") for i in ids], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    twin = con.sql(catalog.oracle_sql()["g03_pattern_scan"]).fetchall()
    columns = "page_id", "link", "method", "score", "tracker"
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in catalog.queries()["g03_pattern_scan"](spark, str(tmp_path)).collect()))) == sorted(map(str, twin))
    # an anchor of a class that leads to a tracker stays a hint
    page = spark.createDataFrame([(1, '<a class="offlink" href="https://trkerupper.com/">go</a>')], "page_id long, html string")
    assert tuple(links.best_links(page, "page_id").first()) == (1, None, None, None, "https://trkerupper.com/")


def test_prelander_walk_by_pages(spark):
    lander = lambda n: f"https://wellnesspeek.com/{n}"
    link = lambda u: f'<a class="offlink" href="{u}">'
    offers = [f"https://shop{n}.com/p?x=1" for n in range(5)]
    pages = [
        (1, lander(1), link(offers[1])), (2, lander(2), link(offers[2])), (3, lander(3), link(lander(1))), (4, lander(4), link(lander(3))), (5, lander(5), link(lander(4))),
        (6, lander(6), "<p>no link"), (7, offers[1], link(offers[2])), (8, lander(2), link(offers[3])), (9, lander(8), link(lander(8))),
    ]
    starts = [(i, u) for i, u in enumerate([lander(1), lander(2), lander(3), lander(4), lander(5), lander(6), offers[1], "https://x.com/none", lander(1), lander(8), None])]
    got = links.prelander_walk(spark.createDataFrame(starts, "id long, url string"), "id", spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = [(offers[1], 1, True), (offers[2], 1, True), (offers[1], 2, True), (offers[1], 3, True), (lander(1), 3, False), (lander(6), 0, False), (offers[1], 0, True), ("https://x.com/none", 0, True), (offers[1], 1, True), (lander(8), 3, False)]
    mine = {r.id: tuple(r)[1:] for r in got}
    assert len(got) == len(starts) and [mine[i] for i in range(10)] == want and not mine[10][2]


def test_every_listed_host_and_pattern_is_met(spark):
    """Full lists: each entry decides, in the order of the gates."""
    rows = [(h, f"https://{h}/offer/x?y=1") for h in (*R.STRICT_BLOCK, *R.INTERMEDIARIES, *R.INVALID_HOSTS) if "/" not in h and not h.endswith(".")]
    frame = spark.createDataFrame(rows, "host string, url string")
    got = {r.host: r.reason for r in frame.select("host", rules.reject_reason(F.col("url")).alias("reason")).collect()}
    assert all(got[h] == "blocked" for h in R.STRICT_BLOCK)
    assert all(got.values())
    assert one(spark, "https://shop.example.com/cards", rules.reject_reason) == "path"
    assert one(spark, "https://shop.example.com/cards?aff_id=1", rules.reject_reason) is None
    assert one(spark, "https://x.example.com/index.html", rules.reject_reason) == "bare_path"
    assert one(spark, "https://shop.example.com/i.webp?hopId=1", rules.reject_reason) == "static_file"
    for bad in ("{!subid!}", "${x}", "__CLICK_ID__", "[TAG:a]", "{{x}}", "%7B%21x%21%7D", "replace_me", "YOUR_CLICK_ID", "insert_here"):
        assert one(spark, f"https://shop.example.com/p?a={bad}", rules.has_macro), bad
    for host in R.PRELANDERS:
        assert one(spark, f"https://www.{host}/a", rules.prelander)


def test_ladder_and_aliases(spark):
    ladder = lambda u: one(spark, u, params.network_by_params)
    assert ladder("https://x.com/?v=bvsl") == "ClickBank" and ladder("https://x.com/?vndr=evf") == "Everflow"
    assert ladder("https://x.com/?screen_id=1") == "BuyGoods" and ladder("https://offer.x.com/p?a=1&offer_id=2") == "Fanyil / Native Ecom"
    assert ladder("https://x.com/?net=1673") == "Network ID 1673 (Private)" and ladder("https://x.com/aff_c?a=1") == "HasOffers (TUNE)"
    assert ladder("https://x.com/?rt=1") == "RedTrack" and ladder("https://go.leadbit.com/") == "LeadBit" and ladder("https://x.com/?a=1") is None
    ids = lambda u, k: one(spark, u, lambda c: params.generic_ids(c)[k])
    assert ids("https://x.com/?a_aid=1&refid=2", "affiliate_id") == "1" and ids("https://x.com/?deal_id=9", "offer_id") == "9"
    assert ids("https://x.com/?c3=5", "sub_id1") == "5" and ids("https://x.com/?uuid=u", "click_id") == "u"
    impact = lambda u, k: one(spark, u, lambda c: params.impact_ids(c)[k])
    assert impact("https://a.prf.hn/?subid1=s&campaignid=7&clickid=c", "affiliate_id") == "s" and impact("https://a.prf.hn/?campaignid=7", "offer_id") == "7"


def test_html_tools_and_page_variables(spark):
    html = "<script src='https://RDTK.io/x.js'></script><script src='affise.js'></script>"
    assert one(spark, html, rules.html_trackers) == ["RedTrack", "Affise"]
    merged = lambda c: rules.merged_trackers(rules.html_trackers(c), F.lit("RedTrack"))
    assert one(spark, html, merged) == ["Affise", "RedTrack"]
    held = lambda c: rules.page_tracker(c, F.create_map(F.lit("_hyros"), F.lit("1")))
    assert one(spark, "<p>", held) == "Hyros" and one(spark, "<script>window.EF = 1", held) == "Everflow"


def test_ordered_and_deep_links(spark):
    page = '<a href="https://trkflstr.com/1">x</a><script>var clickUrl = "https://js.com/2";</script><a data-href="https://d.com/3">x</a><a class="offer-link" href="/not-absolute">x</a>'
    pages = spark.createDataFrame([(1, "https://home.com/", page), (2, "https://home.com/", None), (3, "https://home.com/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.link, r.method) for r in links.ordered_link(pages, "page_id").collect()}
    assert got == {1: ("https://d.com/3", "selector"), 2: (None, None), 3: (None, None)}
    deep = '<script>{"a": "https://shop.com/checkout?x=1", "b": 1234567890}</script><button onclick="go(\'https://home.com/own?aff_id=1\')">x</button><noscript><a href="https://s.com/p?hop=a">x</a></noscript>'
    pages = spark.createDataFrame([(1, "https://home.com/", deep), (2, "https://home.com/", None), (3, None, deep)], "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in links.deep_links(pages, "page_id").collect()}
    assert got == {1: ("https://s.com/p?hop=a", "noscript", 12), 2: (None, None, None), 3: ("https://s.com/p?hop=a", "noscript", 12)}


def test_lookup_cascade_and_correlation(spark):
    ads = spark.createDataFrame([(i, "k1" if i < 60 else None, "a.com" if i % 2 else "b.com", f"https://u{i}.com/K1", "https://landing/zz", i % 7) for i in range(80)], "id long, offer_id string, offer_domain string, final_url string, landing string, day long")
    keys = spark.createDataFrame([("k1",), ("a.com",), ("u7",), ("ZZ",), ("none",), (None,), ("k1",)], "key string")
    rows = lookups.lookup_cascade(keys, ads, "day").collect()
    by = {k: [r for r in rows if r.key == k] for k in ("k1", "a.com", "u7", "ZZ", "none")}
    assert {k: (len(v), v[0].level if v else None) for k, v in by.items()} == {"k1": (50, 1), "a.com": (40, 2), "u7": (11, 3), "ZZ": (50, 4), "none": (0, None)}
    seen = spark.createDataFrame([(1, "h", "x"), (2, "", "x"), (3, None, "x"), (4, "own", "x")], "id long, hash string, href string")
    told = spark.createDataFrame([("h", "https://late", 2), ("h", "https://mgid.com/0", 0), ("h", "https://first", 1), ("own", "https://c.mgid.com/", 1), ("", "https://bad", 1)], "hash string, landing string, seq long")
    assert {r.id: r.landing for r in lookups.correlate(seen, told, "mgid.com").collect()} == {1: "https://first", 2: "x", 3: "x", 4: "x"}


def test_rules_added_between_batches_hold_for_the_next(spark, tmp_path):
    events = spark.createDataFrame([(1, "click"), (2, "view")], "event_id long, event_type string").withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    rule = lambda k, e: spark.createDataFrame([(k, e)], "event_type string, entity string").withColumn("since", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/rules")
    rule("click", "Click")
    for first, more in ((0, None), (10, ("view", "View"))):
        if more:
            rule(*more)
        events.withColumn("event_id", F.col("event_id") + first).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
        sightings.live_rules(stream, f"{tmp_path}/rules", "event_type", "event_id", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.event_id: r.entity for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "Click", 11: "Click", 12: "View"}


def test_offer_choice_by_priority(spark):
    ddl = "id int, final string, chain array<string>, real string, domain string, landing string"
    rows = [
        (1, "https://shop.example.net/p?x=1", [], None, None, "https://news.example.com/a"),
        (2, "https://news.example.com/A/?y=2", ["https://one.example.net/p?x=1", "https://two.example.net/p?x=1", "https://adnxs.com/x"], None, "d.example.net", "https://news.example.com/a"),
        (3, None, [], "get.example.net/p?x=1", "d.example.net", "https://news.example.com/a"),
        (4, "https://x.example.net/i.png", ["https://news.example.com/other?x=1", None], None, "d.example.net", "https://news.example.com/a"),
        (5, None, [], None, None, None),
    ]
    frame = spark.createDataFrame(rows, ddl)
    got = {r.id: (r.b.offer, r.b.method, r.b.needs_review) for r in frame.select("id", chains.offer_choice(*map(F.col, ("final", "chain", "real", "domain", "landing"))).alias("b")).collect()}
    assert got == {
        1: ("https://shop.example.net/p?x=1", "direct", False), 2: ("https://two.example.net/p?x=1", "chain_last_valid_filtered", False), 3: ("https://get.example.net/p?x=1", "event_source_url", False),
        4: ("https://d.example.net", "constructed_from_domain", False), 5: (None, "unresolved", True),
    }


def test_substring_rules_beyond_the_broadcast(spark):
    """The equality join on runs of characters finds what the broadcast finds."""
    rows = spark.createDataFrame([(1, "https://a.track.com/x"), (2, "none"), (3, ""), (4, None), (5, "zz"), (6, "xtrack.co")], "id long, url string")
    table = spark.createDataFrame([(3, "track.com", "t"), (1, "zz", "short"), (2, "rack", "r"), (4, "", "empty"), (5, "x", "one")], "prio int, pattern string, entity string")
    small, large = ({tuple(r) for r in rules.match_substrings(rows, "id", "url", table, most).collect()} for most in (100, 2))
    assert small == large == {(1, "r"), (5, "short"), (6, "r")}


def test_profiles_and_search(spark):
    ddl = "id long, k string, network string, country_code string, tracker_tool string, affiliate_network string, impressions long, created_day int, vertical string, offer string, title string"
    rows = [(1, "a", "MGID", "US", None, None, 5, 1, None, "o1", "Keto Now"), (2, "a", "MGID", "", "V", "CB", None, 3, "Health", "o2", "KETO"), (3, "a", None, "DE", "V", "EF", 7, 2, "Health", "o1", None), (4, None, "X", "X", "X", "X", 1, 1, "X", "X", "keto"), (5, "b", None, None, None, None, None, 9, None, None, "keto 5")]
    frame = spark.createDataFrame(rows, ddl)
    a, b = (profiles.advertisers(frame, "k").where(F.col("k") == k).first() for k in "ab")
    assert (a.ads, a.networks, a.geos, a.trackers, a.affiliate_network, a.impressions, a.first_seen, a.last_seen, a.verticals, a.offers) == (3, ["MGID"], ["DE", "US"], ["V"], "CB", 13, 1, 3, ["Health"], 2)
    assert (b.ads, b.networks, b.affiliate_network, b.impressions, b.offers) == (1, [], "Direct/In-house", 1, 0)
    found = lambda **k: [tuple(r) for r in profiles.faceted_search(frame, **k).collect()]
    assert found(facets={}, text="KETO") == [(5, 4), (2, 4), (1, 4), (4, 4)]
    assert found(facets={"network": ["MGID"], "k": []}, sort="oldest") == [(1, 2), (2, 2)]
    assert found(facets={}, text="keto", sort="impressions", size=1, page=2) == [(4, 4)]
    assert found(facets={}, least=6) == [(3, 1)]


def test_language_looks_each_word_up_once(spark):
    from adlattice.functions import text as T

    for text, want in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("que los perros", "es"), ("les chats que", "fr"), ("", "en"), ("que", "fr"), ("xyz", "en"), ("مرحبا the", "ar")):
        assert one(spark, text, T.language) == want, text


def test_config_payloads(spark):
    import base64

    def best(text):
        row = spark.createDataFrame([(base64.b64encode(text.encode()).decode(),)], "v string").select(params.config_offers(F.col("v")).alias("c")).first().c
        return row.best, row.n

    assert best('{"plain":"https://first.example.org/page?x=1","deep":{"er":[{"href":"https://third.example.org/p?x=1"},{"offerUrl":"https://best.example.org/p?x=1"}]}}') == ("https://best.example.org/p?x=1", 3)
    assert best('{"offerUrl":"https://www.google.com/x","list":["https://only.example.org/page?x=1","http://s.co/x"]}') == ("https://only.example.org/page?x=1", 1)
    assert best("{}") == (None, 0)
    for bad in ("%%%", "", None):
        row = spark.createDataFrame([(bad,)], "v string").select(params.config_offers(F.col("v")).alias("c")).first().c
        assert (row.best, row.n) == (None, 0)


def test_best_capture(spark):
    ddl = "id int, tabs array<string>, final string, responses array<string>, landing string"
    land = "https://news.example.com/a?x=1"
    rows = [
        (1, ["https://www.google.com/", "https://tab.example.net/p?x=1"], "https://fin.example.net/p?x=1", ["https://r.example.net/p?aff_id=1"], land),
        (2, [], land, ["https://news.example.com/other?aff_id=1", "https://r.example.net/p?x=1", "https://s.example.net/p?hop=1"], land),
        (3, [], "https://fin.example.net/p?x=1", ["https://s.example.net/p?melodyeu=1&hop=2"], land), (4, [], land, [], land),
    ]
    frame = spark.createDataFrame(rows, ddl).select("id", chains.best_capture(*map(F.col, ("tabs", "final", "responses", "landing"))).alias("b"))
    got = {r.id: r.b and (r.b.url, r.b.source, r.b.score) for r in frame.collect()}
    assert got == {1: ("https://tab.example.net/p?x=1", "new_tab", 15), 2: ("https://s.example.net/p?hop=1", "network", 13), 3: ("https://s.example.net/p?melodyeu=1&hop=2", "network", 18), 4: None}


def test_quick_candidates(spark):
    pages = [(1, '<a href="https://x.com/product">p</a><a class="shop-nowhere" href="https://no.com/">'), (2, '<a href="https://q.com/product"><span class="claim-btn" href="https://c.com/?aff_id=1">'), (3, '<a href="https://adnxs.com/deal">'), (4, None), (5, '<a class="get-deal" href="/rel"><a href="https://long.example.com/page?a=1">')]
    got = {r.page_id: (r.href, r.score) for r in links.quick_candidates(spark.createDataFrame(pages, "page_id long, html string"), "page_id").collect()}
    assert got == {1: ("https://x.com/product", 3), 2: ("https://c.com/?aff_id=1", 10), 5: ("https://long.example.com/page?a=1", 2)}


def test_chain_entities_take_the_last_rule(spark):
    rows = [(1, 0, "https://trk.voluum.com/x"), (1, 1, "https://x.maxbounty.com/?clickid=1"), (1, 2, "https://keitaro.io/x"), (2, 0, "https://a.com/?subid=1"), (2, 1, "https://a.com/?aff_id=1"), (3, 0, "https://a.com/"), (3, 1, None)]
    frame = spark.createDataFrame(rows, "id int, hop int, url string")
    tools, nets = list(R.TRACKER_PATTERNS.items()), list(R.AFFILIATE_HOSTS.items())
    got = {r.id: (r.network, r.tracker) for r in chains.chain_entities(frame, "id", nets, tools, R.PARAM_TRACKERS).collect()}
    assert got == {1: ("MaxBounty", "Keitaro"), 2: ("Direct / Private", "Binom / Generic"), 3: ("Direct / Private", "Direct / Unknown")}
