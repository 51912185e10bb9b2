"""Suffixes, signals, markup, the cascade and look-ups."""

import pytest
from pyspark.sql import functions as F

from adlattice import catalog
from adlattice.functions import url as U
from adlattice.operators import domains, lookups, params, rules, score, signals
from adlattice.rules import signals as RS
from adlattice.rules import tables as R
from adlattice.sources import html as G

HOSTS = {
    "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "uk": "uk", "www.example.com": "example.com", "www.ck": "ck", "x.www.ck": "www.ck", "a.x.www.ck": "www.ck", "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck",
    "b.ck": "b.ck", "shop.com.au": "shop.com.au", "x.shop.com.au": "shop.com.au", "localhost": "localhost", "10.0.0.7": "10.0.0.7", "awww.ck": "awww.ck", "q.awww.ck": "q.awww.ck", "1.2.co.uk": "2.co.uk",
    "xco.uk": "xco.uk", "deep.xco.uk": "xco.uk",
}


def test_registered_domains(spark):
    # a leading www. isn't part of a host, so www.ck reads as ck
    rows = spark.createDataFrame([(i, f"https://{h}:8/p") for i, h in enumerate(HOSTS)] + [(99, None)], "i int, u string")
    want = dict(enumerate(HOSTS.values())) | {99: None}
    assert {r.i: r.d for r in rows.select("i", U.registered_domain(F.col("u")).alias("d")).collect()} == want
    assert {r.i: r.domain for r in domains.registered_domains(rows, "i", F.col("u"), domains.suffix_table(spark)).collect()} == want
    own = spark.createDataFrame([("example",), ("*.deep.example",), ("!top.deep.example",)], "suffix string")
    found = domains.registered_domains(spark.createDataFrame([(0, "//a.b.example/"), (1, "//a.b.deep.example/"), (2, "//a.top.deep.example/")], "i int, u string"), "i", F.col("u"), own)
    assert {r.i: r.domain for r in found.collect()} == {0: "b.example", 1: "a.b.deep.example", 2: "top.deep.example"}


SIZES = {"OFFER_TYPES": [24, 22, 13, 10, 12], "VALIDITY": [11, 21, 12], "FINGERPRINTS": [4, 5, 5, 3, 3], "ARBITRAGE": [10, 9]}


@pytest.mark.parametrize("name", SIZES)
def test_every_signal_is_met(spark, name):
    sets = getattr(RS, name)
    assert [len(s) for _, _, s in sets] == SIZES[name]
    rows = [(f"{kind}:{field}:{s}", field, f"x {s.upper()} y", kind, w) for kind, fields, own in sets for s, w in own for field in fields]
    frame = spark.createDataFrame(rows, "id string, field string, text string, kind string, w int")
    fields = {f: F.when(F.col("field") == f, F.col("text")) for f in {f for _, fs, _ in sets for f in fs}}
    table = signals.table(spark, sets)
    broadcast = {(r.id, r.kind, r.signal, r.weight) for r in signals.hits(frame, "id", fields, table).collect()}
    assert all((i, kind, i.split(":", 2)[2], w) in broadcast for i, _, _, kind, w in rows)
    # the same rows without a broadcast of the rules
    assert {(r.id, r.kind, r.signal, r.weight) for r in signals.hits(frame, "id", fields, table, most=3).collect()} == broadcast
    got = {(r.id, r.kind): r.score for r in signals.scores(frame, "id", fields, table, most=3).collect()}
    for i, kind, *_ in broadcast:
        assert got[i, kind] == sum(w for j, k, _, w in broadcast if (j, k) == (i, kind))


def test_lists_are_whole():
    sizes = {"DROP_PARAMS": 27, "KEEP_PARAMS": 16, "AD_IDENTIFIERS": 19, "CTA_MARKS": 16, "CTA_TEXTS": 5, "NEWS_WORDS": 15, "SALES_WORDS": 10, "CLOAK_TRACKERS": 6, "BOGUS_LANDINGS": 4, "FALSE_POSITIVES": 7, "AD_SERVERS": 3}
    assert {n: len(getattr(R, n)) for n in sizes} == sizes
    assert [len(v) for v in R.SECOND_ALIASES.values()] == [8, 5, 3, 4]
    assert len(score.STRONG_MARKERS) == 24


def test_offer_type_by_hand(spark):
    pages = [(0, "Add to bag: FREE SHIPPING, paypal", "https://x"), (1, "taboola", "https://x"), (2, "visa", "https://x"), (3, None, None), (4, "", "https://x/category/a?tag=/tag/"), (5, "quantity countdown", "https://x")]
    frame = spark.createDataFrame(pages, "id int, t string, u string")
    got = {r.id: r for r in signals.best_kind(frame, "id", {"body": F.col("t"), "html": F.col("t"), "url": F.col("u")}, signals.table(spark, RS.OFFER_TYPES)).collect()}
    assert (got[0].best, got[0].score, got[0].confidence, got[0].top_signals) == ("Dropshipping", 7, "medium", ["add to bag", "free shipping", "paypal"])
    assert (got[1].best, got[1].score, got[1].confidence) == ("Arbitrage", 5, "medium")
    assert (got[2].best, got[2].score, got[2].confidence, got[2].top_signals) == ("Unknown", 1, "low", [])
    assert (got[3].best, got[3].score, got[3].all_scores) == ("Unknown", 0, {})
    assert (got[4].best, got[4].score) == ("WordPress Blog", 5)
    assert got[5].all_scores == {"Affiliate/CPA": 2, "Dropshipping": 2} and got[5].best == "Unknown"
    tie = signals.best_kind(frame.where("id = 5"), "id", {"body": F.col("t")}, signals.table(spark, RS.OFFER_TYPES), least=1).first()
    assert tie.best == "Affiliate/CPA"


def test_substring_rules_of_any_length_and_number(spark):
    texts = spark.createDataFrame([(0, "aa €b only $9 漢字かな"), (1, ""), (2, None), (3, "x")], "id int, text string")
    patterns = ["a", "aa", "€", "€b", "only $", "$", "漢字か", "zzz", "", "x"]
    table = spark.createDataFrame([(i, p, p) for i, p in enumerate(patterns)], "prio int, pattern string, entity string")
    want = {(i, p) for i, t in ((0, "aa €b only $9 漢字かな"), (3, "x")) for p in patterns if p and p in t}
    for most in (100, 2):
        assert {(r.id, r.pattern) for r in rules.substring_rows(texts, "text", table, most).collect()} == want


def page(spark, html, url="https://a.co.uk/p"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_anchors_in_any_form(spark):
    html = """<A class='x' HREF = "/a?b=1&c='2'"><b>Big</b> <i>deal</i>
    </A><a data-href="/no" href=/bare>t</a><a name="n">no address</a><script>"<a href='/s'>s</a>"</script><noscript><a href="/n">n</a></noscript><a title="a > b" href='//o.com/z'><img></a><article href="/q">"""
    got = [(r.pos, r.href, r.text, r.absolute) for r in G.anchors(page(spark, html)).orderBy("pos").collect()]
    assert got == [(0, "/a?b=1&c='2'", "Big deal", "https://a.co.uk/a?b=1&c='2'"), (1, "/bare", "t", "https://a.co.uk/bare"), (3, "//o.com/z", "", "https://o.com/z")]
    # broken and very long tags take linear time
    long = "<a " + "x='y' " * 20_000 + "<a href='" + "z" * 200_000
    assert G.anchors(page(spark, long)).count() == 0


def test_ad_density_by_hand(spark):
    wrap = lambda s: page(spark, s).select(G.ad_density(F.col("html")).alias("x")).first().x
    x = wrap('<div id="AD-1"></div><section class="ad-x"></section><li class="big my-ad"></li><aside></aside><p class="taboola">' + "<div>" * 96)
    assert (x.blocks, x.ads, x.ratio, x.high, x.sample) == (100, 2, 0.02, False, ["ad-1 ", " big my-ad"])  # a class doesn't start the names
    assert wrap("<li id=mgid>" + "<li>" * 11)[:4] == (12, 1, 0.0833, True) and wrap("<li id=mgid>" * 11 + "<li>" * 989).high
    assert wrap("")[:4] == (0, 0, 0.0, False)
    for i, word in enumerate(["google_ad", "google_ads", "adsbygoogle", "taboola", "outbrain", "revcontent", "mgid", "contentad", "ad-container", "sponsored-content", "ad_slot", "dfp-ad", "advertisement", "ad-", "x-ad", "banner-ad", "adx-", "ads-box", "zergnet", "rc-widget"]):
        assert wrap(f"<div ID='{word}' class=q{i}>" if not word.endswith("ad") else f"<div class='{word}'>").ads == 1, word


def test_page_structure_by_hand(spark):
    of = lambda s, u="https://x/": page(spark, s, u).select(G.page_structure(F.col("url"), F.col("html")).alias("x")).first().x
    x = of('<nav class="my-pagination"></nav><ins class="adsbygoogle big"></ins><p id="a-taboola" class="outbrain dfp">', "https://x/trending/page/12")
    assert (x.paginated, x.page_number, x.ad_count, x.high_density, x.clickbait, x.guess) == (True, 12, 5, True, True, "slideshow_arbitrage")
    x = of('<ins class="adsbygoogle"></ins><i class="revcontentx"></i>disqus /wp-content/')
    assert (x.paginated, x.page_number, x.ad_count, x.guess, x.wordpress, x.comments) == (False, 1, 3, "article_arbitrage", True, True)


def test_affiliate_link_of_a_page(spark):
    of = lambda s: page(spark, s, "https://news.a.co.uk/p").select("page_id", "url", "html").transform(G.affiliate_links).collect()
    assert of('<a href="/x?hop=1">own</a> https://www.a.co.uk/y?hop=2') == []
    assert [r.link for r in of("see https://b.co.uk/y?hop=2), then https://c.co.uk/order/?hop=3.")] == ["https://c.co.uk/order/?hop=3"]
    assert [r.link for r in of("https://b.co.uk/y?hop=2 https://c.co.uk/z?hop=1")] == ["https://b.co.uk/y?hop=2"]
    assert of("https://cbtb.clickbank.net/?hop=1 https://b.com/api/?hop=2 https://b.com/plain") == []


def test_decoders_and_their_merge(spark):
    def ids(url, of):
        frame = spark.createDataFrame([(url,)], "u string").withColumn("pairs", U.pairs(F.col("u")))
        return frame.select(*(c.alias(k) for k, c in of(F.col("u"), lambda n: U.value_of(F.col("pairs"), n)).items())).first().asDict()

    error = "https://hop-apps.clickbank.net/e?destinationUrl=https%3A%2F%2Fwww.shop.com%2Fx%3Fa%3D1&hop=me"
    assert ids(error, params.clickbank_ids) == {"affiliate_id": "me", "offer_id": None, "click_id": None, "offer_domain": "shop.com", "offer_url": "https://www.shop.com/x?a=1"}
    assert ids("https://af.prod.hop.clickbank.net/?hop=z&hopId=7", params.clickbank_ids)["affiliate_id"] == "af"
    assert ids("https://x.com/cb/v?affiliate=q&hop=z", params.clickbank_ids)["affiliate_id"] == "q"
    assert ids("https://x.com/?oid=1&aff_id=2&transaction_id=3&event_source_url=s.com", params.everflow_ids) == {"offer_id": "1", "affiliate_id": "2", "click_id": "3", "offer_domain": "s.com", "offer_url": "https://s.com"}
    assert ids("https://x.tune.com/?offer_id=1&aff_click_id=k&aff_sub=s&aff_sub2=t", params.hasoffers_ids) == {"offer_id": "1", "affiliate_id": None, "click_id": "k", "sub_id1": "s", "sub_id2": "t"}
    assert ids("https://www.digistore24.com/redir/9/x?aff=a&cid=c&uid=u", params.digistore_ids) == {"offer_id": "c", "affiliate_id": "a", "click_id": "u"}
    # generic names come over the network's own form; the host's form fills what they leave
    assert ids("https://af.prod.hop.clickbank.net/?hop=z", params.decoded_ids)["affiliate_id"] == "z"
    assert ids("https://af.prod.hop.clickbank.net/?x=1", params.decoded_ids)["offer_id"] == "prod"
    for url in ("https://a.b/?x=1&x=2&y=&y=3&z=a%20b+c&w=%zz", "https://a.b/p", "https://a.b/?=1&q", None):
        frame = spark.createDataFrame([(url,)], "u string").withColumn("pairs", U.pairs(F.col("u")))
        for n in "xyzwq":
            row = frame.select(U.param(F.col("u"), n).alias("a"), U.value_of(F.col("pairs"), n).alias("b")).first()
            assert row.a == row.b, (url, n)


def test_all_stages_of_the_cascade_are_met(spark, sf_dir):
    got = catalog.queries()["f04_cascade"](spark, sf_dir).groupBy("stage").count().collect()
    assert {r["stage"] for r in got} == {"Knowledge", "Signal", "Instant", "3", "4", "5", "BridgeHeuristic", "6"}


def test_lookup_cascade_of_many_keys(spark):
    ads = spark.createDataFrame([(i, f"o{i % 7}", f"d{i % 5}.com", f"https://x/Key{i % 11}/p", f"https://l/q{i % 13}z", i % 9) for i in range(200)] + [(900, None, None, None, None, None)], "id long, offer_id string, offer_domain string, final_url string, landing string, day int")
    keys = spark.createDataFrame([(k,) for k in ("o1", "d2.com", "KEY3", "q4z", "z", "nothing", "", None, "o1")], "key string")
    rows = [r.asDict() for r in ads.collect()]

    def first(key):
        tests = [("offer_id", False), ("offer_domain", False), ("final_url", True), ("landing", True)]
        for level, (c, part) in enumerate(tests, 1):
            hits = [r for r in rows if r[c] is not None and (key.lower() in r[c].lower() if part else r[c] == key)]
            if hits:
                return [(key, level, r["id"]) for r in sorted(hits, key=lambda r: (-r["day"], -r["id"]))[:6]]
        return []

    want = sorted(x for k in ("o1", "d2.com", "KEY3", "q4z", "z", "nothing") for x in first(k))
    for most in (100, 1):
        got = lookups.lookup_cascade(keys, ads, "day", 6, most)
        assert sorted((r.key, r.level, r.id) for r in got.collect()) == want
