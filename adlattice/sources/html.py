"""Reading stored HTML by regular expressions: start tags, attributes and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import rules as O
from ..rules import tables as R

#: What may stand in a start tag after its name. Possessive, so that long and broken tags take
#: linear time; PLAIN_* are the forms for engines without possessive quantifiers.
ATTRIBUTES = r"((?:[\s/](?:[^>\x22']++|\x22[^\x22]*+\x22|'[^']*+')*+)?+)"
PLAIN_ATTRIBUTES = r"((?:[\s/](?:[^>\x22']|\x22[^\x22]*\x22|'[^']*')*)?)"
#: Elements whose content isn't a page's.
ASIDE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
BLOCKS = ["div", "section", "article", "aside", "li"]
ENDPOINT = r"[\x22'](https?://[^\x22'\s]+|/[A-Za-z0-9_/.-]{3,}\??[^\x22'\s]*)[\x22']"


def tag_pattern(names: list[str], attributes: str = ATTRIBUTES) -> str:
    """Start tags: the name and what follows it."""
    return rf"(?i)<({'|'.join(names)}){attributes}>"


def element_pattern(names: list[str], attributes: str = ATTRIBUTES) -> str:
    """Elements that don't hold others of the same kind: name, attributes and inner markup."""
    ends = "|".join(rf"</{n}\s*>" for n in names)
    return rf"(?is)<({'|'.join(names)}){attributes}>(.*?)(?:{ends})"


def attribute_pattern(name: str) -> str:
    """The value of an attribute, in either kind of quotes or bare, in one of three groups."""
    return rf"(?i)(?:^|[\s\x22'/]){name}\s*=\s*(?:\x22([^\x22]*)\x22|'([^']*)'|([^\s\x22'>]+))"


def own(html: Column) -> Column:
    """A page without scripts, styles and what is shown without scripts."""
    return F.regexp_replace(html, ASIDE, " ")


def attribute(attributes: Column, name: str) -> Column:
    """The first value of an attribute; empty if there is none."""
    return F.concat(*(F.regexp_extract(attributes, attribute_pattern(name), i) for i in (1, 2, 3)))


def inner_text(markup: Column) -> Column:
    """Text without markup, each run of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, r"<[^>]*>", " "), r"\s+", " "))


def tags(html: Column, names: list[str]) -> Column:
    """array of struct(name, id, classes) of the start tags of these names, in order, with
    attributes in any order; scripts and styles aside."""
    found = [F.regexp_extract_all(own(html), F.lit(tag_pattern(names)), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "rest"))]
    cell = lambda x: F.struct(F.lower(x["name"]).alias("name"), F.lower(attribute(x["rest"], "id")).alias("id"), F.lower(attribute(x["rest"], "class")).alias("classes"))
    return F.transform(F.arrays_zip(*found), cell)


def elements(html: Column, names: list[str]) -> Column:
    """array of struct(name, rest, text) of elements, with their attributes and their text without
    markup."""
    found = [F.regexp_extract_all(own(html), F.lit(element_pattern(names)), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "rest"), (3, "inner"))]
    return F.transform(F.arrays_zip(*found), lambda x: F.struct(F.lower(x["name"]).alias("name"), x["rest"].alias("rest"), inner_text(x["inner"]).alias("text")))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, pos from 0, href, text and the absolute href of every anchor with an address."""
    rows = pages.select("page_id", "url", F.posexplode(elements(F.col("html"), ["a"])).alias("pos", "a"))
    rows = rows.select("page_id", "url", "pos", attribute(F.col("a.rest"), "href").alias("href"), "a.text").where("href <> ''")
    return rows.withColumn("absolute", U.absolute(F.col("url"), F.col("href")))


def likely_cta(name: Column, classes: Column, id_: Column, text: Column) -> Column:
    """Whether an anchor or button is a call to action by its class, id or text."""
    marks = F.concat_ws(" ", F.lower(classes), F.lower(id_))
    return name.isin("a", "button") & (O.contains_any(marks, R.CTA_MARKS) | O.contains_any(F.lower(text), R.CTA_TEXTS))


def calls_to_action(pages: DataFrame) -> DataFrame:
    """page_id, pos from 0 among anchors and buttons, name and text of the likely calls to action."""
    rows = pages.select("page_id", F.posexplode(elements(F.col("html"), ["a", "button"])).alias("pos", "a"))
    test = likely_cta(F.col("a.name"), attribute(F.col("a.rest"), "class"), attribute(F.col("a.rest"), "id"), F.col("a.text"))
    return rows.where(test).select("page_id", "pos", "a.name", "a.text")


#: The last anchor of a stretch of markup: its attributes and what follows.
LAST_ANCHOR = rf"(?is)^.*<a{ATTRIBUTES}>(.*)$"
PLAIN_LAST_ANCHOR = rf"(?is)^.*<a{PLAIN_ATTRIBUTES}>(.*)$"
IMAGE, PLAIN_IMAGE = rf"(?is)<img{ATTRIBUTES}>", rf"(?is)<img{PLAIN_ATTRIBUTES}>"
DIV = r"(?is)<div(?:\s[^>]*)?>(.*?)</div\s*>"


def ad_cards(pages: DataFrame, networks: list[tuple[str, str]] = R.CARD_NETWORKS, least: int = 15, cap: int = 180) -> DataFrame:
    """(page_id, pos, network, landing, title, image) of the anchors whose address matches a
    network's pattern, the first of several, and that have a title of over `least` characters,
    cut at `cap`. The title is the anchor's text, else that of the next div; the image that
    inside the anchor, else the next one. Each page is cut once at the ends of its anchors.
    """
    parts = F.split(own(F.col("html")), r"(?i)</a\s*>")
    rows = pages.select("page_id", "url", parts.alias("parts"))
    source = lambda m: F.coalesce(*(F.nullif(attribute(F.regexp_extract(m, IMAGE, 1), n), F.lit("")) for n in ("src", "data-src", "data-lazy-src")), F.lit(""))
    rows = rows.withColumn("images", F.transform("parts", source)).withColumn("texts", F.transform("parts", lambda m: inner_text(F.regexp_extract(m, DIV, 1))))
    rows = rows.select("page_id", "url", "images", "texts", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "part")).where("pos < n - 1")
    inner = F.regexp_extract("part", LAST_ANCHOR, 2)
    rows = rows.withColumn("href", attribute(F.regexp_extract("part", LAST_ANCHOR, 1), "href")).where("href <> ''").withColumn("inner", inner)
    later = lambda c: F.coalesce(F.get(F.filter(F.slice(c, F.col("pos") + 2, F.col("n")), lambda x: x != ""), F.lit(0)), F.lit(""))
    title = F.coalesce(F.nullif(inner_text(F.col("inner")), F.lit("")), later("texts"))
    image = F.coalesce(F.nullif(source(F.col("inner")), F.lit("")), later("images"))
    rows = rows.select("page_id", "url", "pos", O.first_regex(F.lower("href"), [(p, n) for n, p in networks]).alias("network"), "href", title.alias("title"), image.alias("image"))
    rows = rows.where(F.col("network").isNotNull() & (F.length("title") > least))
    whole = F.when(F.col("image") != "", U.absolute(F.col("url"), F.col("image")))
    return rows.select("page_id", "pos", "network", U.absolute(F.col("url"), F.col("href")).alias("landing"), F.substring("title", 1, cap).alias("title"), whole.alias("image"))


def ad_density(html: Column, identifiers: list[str] = R.AD_IDENTIFIERS) -> Column:
    """struct(blocks, ads, ratio, high, sample): block elements, those whose id and classes name an
    ad, their share to four digits, whether that is high, and up to five distinct names.
    Over 8 % or more than 10 are high."""
    names = F.transform(tags(html, BLOCKS), lambda t: F.concat(t["id"], F.lit(" "), F.array_join(F.filter(F.split(t["classes"], r"\s+"), lambda c: c != ""), " ")))
    test = "|".join(identifiers)
    ads = F.filter(names, lambda n: (F.trim(n) != "") & n.rlike(test))
    n, k = F.size(names), F.size(ads)
    ratio = F.when(n > 0, F.round(k / n, 4)).otherwise(0.0)
    high = (n > 0) & ((k > 10) | (k * 100 > n * 8))
    return F.struct(n.cast("long").alias("blocks"), k.cast("long").alias("ads"), ratio.alias("ratio"), high.alias("high"), F.slice(F.array_distinct(ads), 1, 5).alias("sample"))


def _holds(tag: Column, names: list[str]) -> Column:
    return F.exists(F.split(tag["classes"], r"\s+"), lambda c: c.isin(*names))


def page_structure(url: Column, html: Column) -> Column:
    """struct(paginated, page_number, ad_count, high_density, wordpress, clickbait, comments, guess).

    Paginated: a class for paging; ad_count: elements of ad containers, once for each way in
    which they are named; the page number is in the URL, 1 if it isn't."""
    every = tags(html, ["[a-z][a-z0-9]*+"])
    paged = F.exists(every, lambda t: _holds(t, ["pagination", "next-page", "slideshow-nav"]) | O.contains_any(t["classes"], ["pagination", "next"]))
    ways = lambda t: sum((c.cast("int") for c in (
        t["id"].contains("google_ads"), _holds(t, ["adsbygoogle"]), t["id"].contains("taboola"), t["id"].contains("outbrain"), t["classes"].contains("taboola"),
        t["classes"].contains("outbrain"), t["classes"].contains("revcontent"), _holds(t, ["adsbygoogle"]), t["classes"].contains("dfp"),
    )), F.lit(0))
    count = F.aggregate(every, F.lit(0), lambda n, t: n + ways(t))
    number = F.regexp_extract(F.lower(url), r"(?:/page/|[?&](?:page|p)=)([0-9]{1,6})\b", 1)
    guess = F.when(paged, "slideshow_arbitrage").when(count >= 3, "article_arbitrage").otherwise("unknown")
    return F.struct(
        paged.alias("paginated"), F.when(number != "", number.cast("int")).otherwise(1).alias("page_number"), count.cast("long").alias("ad_count"), (count >= 3).alias("high_density"),
        O.contains_any(html, ["/wp-content/", "wp-json"]).alias("wordpress"), O.contains_any(F.lower(url), ["trending", "believe", "defying", "celebrities"]).alias("clickbait"),
        O.contains_any(html, ["disqus", "fb-comments"]).alias("comments"), guess.alias("guess"),
    )


PRIORITY_PATHS = ["/pay/", "/order/", "/checkout/", "/vsl", "/video/", "/buy", "/click?", "click/"]
SKIPPED = ["google-analytics", "googletagmanager", "doubleclick", "facebook.com/tr", "clickbank.net/sellerhop", "tracking.buygoods", "cbtb.clickbank", "ml314.com", "permutive.com", "newsroom.bi"]
LINK = r"https?://[^\s\x22'<>)\\\]]+"
HREF = r"href=[\x22']([^\x22']+)[\x22']"


def affiliate_links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of the best affiliate link in each page: of the full URLs anywhere in the
    markup and then of the absolute hrefs, those of another registered domain that hold a
    signature and are neither API calls, nor noise; a sales path first, then by place."""
    urls = F.regexp_extract_all("html", F.lit(LINK), F.lit(0))
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda h: U.absolute(F.col("url"), h))
    rows = pages.select("page_id", U.registered_domain(F.col("url")).alias("home"), F.posexplode(F.array_distinct(F.concat(urls, hrefs))).alias("pos", "link"))
    rows = rows.withColumn("link", F.regexp_replace("link", r"[.,;)]+$", ""))
    text = F.lower("link")
    fine = (U.registered_domain(F.col("link")) != F.col("home")) & O.contains_any(text, R.SIGNATURES) & ~O.contains_any(text, R.API_ENDPOINTS) & O.meaningful(F.col("link")) & ~O.contains_any(text, SKIPPED)
    order = F.struct(~O.contains_any(text, PRIORITY_PATHS), "pos")
    return rows.where(fine).groupBy("page_id").agg(F.min_by("link", order).alias("link"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    return inner_text(own(html))


def meta_refresh(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)http-equiv=[\x22']refresh[\x22'][^>]*url=([^\x22'>]+)", 1)


def endpoints(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(ENDPOINT), F.lit(1)))
