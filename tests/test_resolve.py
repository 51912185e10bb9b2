"""Resolution of offers by what was captured."""

import base64

from pyspark.sql import functions as F

from adlattice.functions import url as U
from adlattice.operators import resolve as RS
from adlattice.sources import feeds
from adlattice.sources import html as G

GOOD, GOOD2, BAD, SICK = "https://shop.example.net/buy?aff_id=1", "https://shop.example.net/buy?aff_id=2", "https://www.facebook.com/x", "https://shop.example.net/buy?aff_id=3"
VIA = "https://clck.mgid.com/ghits/1"


def frames(spark):
    health = spark.createDataFrame([(GOOD, True), (GOOD2, True), (BAD, True), (SICK, False), (None, True)], "url string, healthy boolean")
    edges = spark.createDataFrame([(VIA, "https://hop.example.org/1"), ("https://hop.example.org/1", GOOD2), ("https://clck.mgid.com/ghits/2", SICK)], "from_url string, to_url string")
    return health, edges


def test_validation_falls_back(spark):
    health, edges = frames(spark)
    offers = spark.createDataFrame([(1, GOOD), (2, SICK), (3, BAD), (4, None), (5, None), (6, None), (7, None)], "id int, url string")
    captured = spark.createDataFrame([(1, 0, GOOD2), (2, 0, GOOD), (2, 1, GOOD2), (2, 2, SICK), (3, 9, GOOD), (3, 10, BAD), (4, 0, BAD), (5, 1, VIA), (5, 0, SICK), (6, 0, "https://clck.mgid.com/ghits/2"), (7, 0, None)], "id int, seq int, url string")
    want = {1: GOOD, 2: GOOD2, 3: GOOD, 4: None, 5: None, 6: None, 7: None}
    assert {r.id: r.url for r in RS.validated(offers, captured, health).collect()} == want
    assert {r.id: r.url for r in RS.validated(offers, captured, health, edges).collect()} == want | {5: GOOD2}


def test_layers_in_order(spark):
    health, _ = frames(spark)
    ads = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    candidates = spark.createDataFrame([(1, 0, SICK), (1, 2, GOOD), (1, 1, BAD), (2, 0, GOOD), (2, 1, GOOD2), (3, 5, SICK), (4, 3, BAD), (6, 5, GOOD)], "id int, layer int, url string")
    captured = spark.createDataFrame([(3, 0, GOOD), (3, 1, GOOD2), (4, 0, GOOD), (6, 0, GOOD2)], "id int, seq int, url string")
    got = {r.id: (r.url, r.method, r.layers_tried) for r in RS.layered(ads, candidates, captured, health).collect()}
    assert got == {
        1: (GOOD, "layer2_httpx", 2), 2: (GOOD, "L0_Simple_Scan", 0), 3: (GOOD2, "layer5_capture", 5), 4: (GOOD, "layer6_fallback", 6), 5: (None, "failed", 6), 6: (GOOD, "layer5_capture", 5),
    }


def test_landing_of_a_request_log(spark):
    far = "https://news.example.org/a/long/path"
    log = [("t", 0, "document", far + "1"), ("t", 1, "xhr", far + "2"), ("t", 2, "image", far + "3"), ("t", 3, "fetch", far + ".PNG"), ("t", 4, "fetch", "https://x.mgid.com/a/long/path/x"), ("t", 5, "xhr", "https://a.b/short"), ("t", 6, "xhr", "https://localhost/a/long/path/here"), ("u", 0, "sub_document", far + ".js"), ("v", 0, "fetch", None)]
    rows = spark.createDataFrame(log, "target string, seq int, type string, url string")
    assert {r.target: r.url for r in RS.landing_of_requests(rows).collect()} == {"t": far + "2"}
    assert {r.target: r.url for r in RS.landing_of_requests(rows, first=True).collect()} == {"t": far + "1", "u": far + ".js"}


def test_foreign_responses_keep_their_order(spark):
    pages = spark.createDataFrame([(1, "https://www.a.co.uk/p"), (2, "https://b.com/")], "id int, url string")
    rows = [(1, 3, "https://z.org/1"), (1, 1, "https://y.org/1"), (1, 2, "https://www.a.co.uk/x"), (1, 4, "https://y.org/1"), (1, 5, "https://a.co.uk/x?ClickId=1"), (2, 0, "https://b.com/x"), (1, 6, "https://w.org/p?hop=1&affiliate=2")]
    got = {r.id: (r.responses, r.offers) for r in RS.foreign_responses(pages, spark.createDataFrame(rows, "id int, seq int, url string")).collect()}
    assert got == {1: (["https://y.org/1", "https://z.org/1", "https://w.org/p?hop=1&affiliate=2"], ["https://a.co.uk/x?ClickId=1", "https://w.org/p?hop=1&affiliate=2"])}


def test_final_choice(spark):
    land = "https://land.example.org/p/q"
    ads = spark.createDataFrame([(i, land, land if i != 2 else GOOD2) for i in range(1, 6)], "id int, landing string, page string")
    tabs = spark.createDataFrame([(1, 0, GOOD), (1, 1, GOOD2), (5, 0, BAD)], "id int, seq int, url string")
    responses = spark.createDataFrame([(3, 0, 200, GOOD), (3, 1, 404, GOOD2), (3, 2, 200, BAD), (3, 3, 200, land)], "id int, seq int, status int, url string")
    chain = spark.createDataFrame([(5, 0, GOOD), (5, 1, BAD), (4, 0, BAD)], "id int, seq int, url string")
    assert {r.id: r.url for r in RS.final_choice(ads, tabs, responses, chain).collect()} == {1: GOOD2, 2: GOOD2, 3: GOOD, 4: None, 5: GOOD}


def test_repairs_by_redirects(spark):
    track = "https://trkerupper.com/click?n=1"
    edges = spark.createDataFrame([(track, GOOD), ("https://plain.example.org/x", GOOD2)], "from_url string, to_url string")
    ads = spark.createDataFrame([(1, track, track), (2, GOOD, None), (3, "https://plain.example.org/x", "https://trkerupper.com/click?n=2")], "id int, landing string, final_url string")
    got = sorted((r.id, r.field, r.new_value) for r in RS.repair_fields(ads, "id", ["landing", "final_url"], edges).collect())
    assert got == [(1, "final_url", GOOD), (1, "landing", GOOD)]
    found = {r.id: (r.network, r.tracker, r.landing) for r in RS.redetect(ads, edges).collect()}
    assert found[1][2] == track or len(GOOD) > len(track) + 10
    assert {r.id: r.canonical for r in RS.canonical(ads, "id", "landing", edges).collect()} == {1: GOOD, 2: GOOD, 3: "https://plain.example.org/x"}


def test_small_verdicts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(RS.certain_offer(lit(GOOD), lit("l"), lit("f"), lit(True))) == GOOD
    assert one(RS.certain_offer(lit(GOOD), lit("l"), lit(GOOD), lit(True))) is None and one(RS.certain_offer(lit(GOOD), lit("l"), lit("f"), lit(None).cast("boolean"))) is None
    assert one(RS.bot_challenge(lit("Just a moment..."), lit(None).cast("string"))) and one(RS.bot_challenge(lit(None).cast("string"), lit("https://challenges.cloudflare.com/x"))) and not one(RS.bot_challenge(lit("just a page"), lit("x")))
    assert one(RS.with_reason(lit("a"), lit(True), "B")) == "a | B" and one(RS.with_reason(lit(None).cast("string"), lit(True), "B")) == "B" and one(RS.with_reason(lit("a"), lit(False), "B")) == "a"
    assert one(RS.deep_article(lit("https://x.org/a-2025-b"))) and not one(RS.deep_article(lit("https://x.org/a-2025-b/"))) and not one(RS.deep_article(lit("https://x.org/" + "a-" * 40 + "/news"))) and one(RS.deep_article(lit("https://x.org/" + "a-" * 40)))


def test_payloads_come_before_parameters(spark):
    data = base64.b64encode(b'{"offer":"https://deep.example.net/o?url=https%3A%2F%2Fend.example.org%2F1","n":"??>>"}').decode()
    urls = [f"https://t.com/c?url=https%3A%2F%2Fwrong.com&voluumdata={data.rstrip('=')}&x=1", f"https://t.com/c?voluumdata={data.replace('+', '%2B').replace('/', '%2F').replace('=', '%3D')}", "https://t.com/c?voluumdata=%%%&url=https%3A%2F%2Fright.com", "https://t.com/c?dest=ftp%3A%2F%2Fx", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    got = {r.i: r.t for r in rows.select("i", U.peel(F.col("u")).alias("t")).collect()}
    assert got == {0: "https://end.example.org/1", 1: "https://end.example.org/1", 2: "https://right.com", 3: urls[3], 4: None}


def test_feeds_take_the_first_of_eight_keys(spark):
    items = ",".join(f'{{"title":"t{i}","{k}":"https://x/{i}","link":"https://late/{i}"}}' for i, k in enumerate(feeds.LANDING_KEYS[:-1]))
    text = f'{{"items":[{items},{{"text":"t","articleUrl":"","link":"https://x/7"}}]}}'
    got = feeds.normalise(spark.createDataFrame([(1, text)], "f int, p string"), "f", "p").orderBy("pos").collect()
    assert [r.landing for r in got] == [f"https://x/{i}" for i in range(8)] and len(feeds.LANDING_KEYS) == 8


def test_ad_cards_by_hand(spark):
    html = """<a href="https://trc.Taboola.com/1"><img src='/in.png'>A title of some length</a><a href="/mgid.com/2">short</a>
    <a href="//outbrain.com/3"></a><div class="x">The <b>next</b> division's text</div><p><img data-src="/next.png"></p><a href="https://plain.org">Another long title here</a><a href="https://revcontent.com/4">Nothing follows this title"""
    rows = G.ad_cards(spark.createDataFrame([(1, "https://p.org/a/b", html + "</a>")], "page_id int, url string, html string"), cap=12).orderBy("pos").collect()
    assert [(r.network, r.landing, r.title, r.image) for r in rows] == [
        ("Taboola", "https://trc.Taboola.com/1", "A title of s", "https://p.org/in.png"),
        ("Outbrain", "https://outbrain.com/3", "The next div", "https://p.org/next.png"),
        ("Revcontent", "https://revcontent.com/4", "Nothing foll", None),
    ]
    assert len(G.ad_cards(spark.createDataFrame([(1, "https://p.org/", html)], "page_id int, url string, html string")).collect()) == 2  # the last has no end
