"""Matching URLs and texts against rules, in three shapes: a literal list within the
row, a table of rules joined by substring, and a table joined by host suffix, which is
an equality join. The first rule in priority order wins."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R

#: Rule tables up to this number are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 100_000


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in text; null: no. Long lists are one alternation, so
    that the generated code stays small."""
    if len(words) > 8:
        return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(False))


def ends_with_any(text: Column, ends: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (text.endswith(w) for w in ends)), F.lit(False))


def first_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The entity of the first rule one of whose patterns is in text."""
    return F.coalesce(*(F.when(contains_any(text, patterns), F.lit(name)) for name, patterns in rules), F.lit(None).cast("string"))


def first_regex(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for p, name in rules), F.lit(None).cast("string"))


def matches(text: Column, words: list[str]) -> Column:
    """The words that are in text, in their order."""
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.coalesce(text.contains(w), F.lit(False)))


def weighted(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the phrases in text."""
    return reduce(lambda a, b: a + b, (F.when(text.contains(w), F.lit(n)).otherwise(0) for w, n in rules))


def rule_table(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    rows = [(i, p, name) for i, (name, p) in enumerate((n, p) for n, ps in rules.items() for p in ps)]
    return spark.createDataFrame(rows, "prio int, pattern string, entity string")


def bounded(rules: DataFrame) -> DataFrame:
    """Broadcast after a check of the number of rules."""
    return F.broadcast(rules) if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rules


GRAM = 3


def substring_rows(rows: DataFrame, text: str, rules: DataFrame, most: int = MOST_BROADCAST, on: list[str] | None = None) -> DataFrame:
    """rows joined with the rules whose pattern is in their text, and that agree in the columns
    `on`. Up to `most` rules are broadcast; more are met by the first GRAM characters of
    their patterns, an equality join on the texts' distinct runs of that length. Shorter
    patterns are met by the texts' distinct runs of their own length. Empty ones match
    nothing."""
    on = on or []
    rules = rules.where("pattern <> ''")
    held = F.col(text).contains(F.col("pattern"))
    if rules.limit(most + 1).count() <= most:
        bounded = F.broadcast(rules)
        return rows.join(bounded, on).where(held) if on else rows.join(bounded, held)

    def runs(n: int) -> DataFrame:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return rows.withColumn("_gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(n))))))

    size = F.length("pattern")
    met = runs(GRAM).join(rules.where(size >= GRAM).withColumn("_gram", F.substring("pattern", 1, GRAM)), [*on, "_gram"]).where(held).drop("_gram")
    for n in range(1, GRAM):
        met = met.unionByName(runs(n).join(rules.where(size == n).withColumn("_gram", F.col("pattern")), [*on, "_gram"]).drop("_gram"))
    return met


def match_substrings(df: DataFrame, key: str, text: str, rules: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """(key, entity) of the first rule whose pattern is in text, for rows that match."""
    hits = substring_rows(df.select(key, F.col(text).alias("_text")), "_text", rules, most)
    return hits.groupBy(key).agg(F.min_by("entity", "prio").alias("entity"))


def match_hosts(df: DataFrame, key: str, host: str, rules: DataFrame) -> DataFrame:
    """(key, entity) of the first rule that names the host or a parent domain of it."""
    suffixes = df.select(key, F.explode(U.host_suffixes(F.col(host))).alias("pattern"))
    return suffixes.join(bounded(rules), "pattern").groupBy(key).agg(F.min_by("entity", "prio").alias("entity"))


def by_host(host: Column, rules: dict[str, list[str]]) -> Column:
    """The entity that names the host or the nearest parent domain. One pattern of all domains
    is tested first; only hosts that it meets are looked up in a constant map."""
    names = F.create_map(*(F.lit(x) for name, domains in rules.items() for d in domains for x in (d, name)))
    met = host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for domains in rules.values() for d in domains) + ")$")
    found = F.transform(U.host_suffixes(host), lambda s: F.try_element_at(names, s))
    return F.when(met, F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))


def by_pattern(text: Column, rules: dict[str, list[str]]) -> Column:
    """The entity of the first pattern in text, from one constant array; texts without any are
    told apart by one pattern first."""
    table = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(name).alias("entity")) for name, ps in rules.items() for p in ps))
    met = text.rlike("|".join(re.escape(p) for ps in rules.values() for p in ps))
    return F.when(met, F.get(F.filter(table, lambda r: text.contains(r["pattern"])), F.lit(0))["entity"])


def affiliate_network(url: Column) -> Column:
    """struct(network, confidence): named hosts are certain, generic marks are not."""
    named = F.coalesce(by_host(U.host(url), R.AFFILIATE_HOSTS), by_pattern(F.lower(url), R.AFFILIATE_HOSTS))
    generic = contains_any(F.lower(url), R.GENERIC_TRACKERS)
    return F.struct(
        F.coalesce(named, F.when(generic, F.lit("Unknown Affiliate"))).alias("network"),
        F.when(named.isNotNull(), "high").when(generic, "medium").otherwise("unknown").alias("confidence"),
    )


def tracking_tool(url: Column) -> Column:
    """The tracker by click-id parameters, host, pattern, then analytics tags."""
    text = F.lower(url)
    return F.coalesce(
        first_regex(text, R.CLICK_TRACKERS), by_host(U.host(url), R.TRACKER_HOSTS), by_pattern(text, R.TRACKER_PATTERNS),
        F.when(text.contains("utm_"), F.lit("Google Analytics")),
    )


def has_macro(url: Column) -> Column:
    macro = "(?i)" + "|".join(R.MACROS)
    return F.coalesce(url.rlike(macro) | U.unescape(url).rlike(macro), F.lit(False))


FILE = r"(?i)\.(?:" + "|".join(e[1:] for e in R.EXTENSIONS) + ")"


def static_file(url: Column) -> Column:
    """A file's ending at the path's end, or before a ? or & anywhere."""
    return F.coalesce(U.path(url).rlike(FILE + "$") | url.rlike(FILE + "[?&]"), F.lit(False))


def meaningful(url: Column) -> Column:
    """Whether a URL may be a landing page: ordered gates."""
    text, host = F.lower(url), U.host(url)
    return F.coalesce(
        F.when(~text.startswith("http"), F.lit(False))
        .when(static_file(url), False)
        .when(contains_any(text, R.STRICT_BLOCK) | contains_any(host, R.AD_TECH_HOSTS), False)
        .when(contains_any(text, R.AD_TECH_PATTERNS), False)
        .when(contains_any(text, R.SIGNATURES), True)
        .otherwise(F.length(url) <= 800),
        F.lit(False),
    )


def _holds(text: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(False))


def _parts(url: Column) -> dict[str, Column]:
    return {"url": url, "text": F.lower(url), "host": U.host(url), "path": F.lower(U.path(url)), "query": F.lower(U.query(url))}


def _reason(url: Column, text: Column, host: Column, path: Column, query: Column, has: Callable[[Column, list[str]], Column]) -> Column:
    strong = has(query, R.STRONG_PARAMS)
    return (
        F.when(url.isNull() | ~text.startswith("http"), F.lit("not_http"))
        .when(has_macro(url), "macro")
        .when(static_file(url), "static_file")
        .when(has(text, R.STRICT_BLOCK), "blocked")
        .when(has(host, R.AD_TECH_HOSTS), "ad_tech")
        .when(has(host, R.INTERMEDIARIES), "intermediary")
        .when(has(text, R.INVALID_HOSTS), "invalid_domain")
        .when(~strong & (path.isin(*R.EXACT_PATHS) | has(path, R.INVALID_PATHS)), "path")
        .when(path.isin(*R.BARE_PATHS) & ~has(text, R.OFFER_HINTS), "bare_path")
        .when(has(text, R.INFRASTRUCTURE), "infrastructure")
    )


def reject_reason(url: Column) -> Column:
    """The first rule by which a URL isn't a valid offer; null: it is."""
    return _reason(**_parts(url), has=contains_any)


def valid_in_list(url: Column) -> Column:
    """Whether reject_reason is null, for a URL of a lambda function. There Spark doesn't compute
    equal parts of an expression once, so the URL's parts are bound first, and generates no
    code, so words are looked for one by one, which is faster than an alternation."""
    parts = _parts(url)
    return F.exists(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), lambda p: _reason(**{n: p[n] for n in parts}, has=_holds).isNull())


def html_trackers(html: Column) -> Column:
    """The tools whose marks are in a page, in the rules' order."""
    return F.filter(F.array(*(F.when(html.rlike("(?i)" + p), F.lit(n)) for n, p in R.HTML_TRACKERS)), lambda x: x.isNotNull())


def merged_trackers(found: Column, more: Column) -> Column:
    """A set of tools with another one, sorted; null: none more."""
    return F.array_sort(F.array_union(found, F.filter(F.array(more), lambda x: x.isNotNull())))


def page_tracker(html: Column, variables: Column) -> Column:
    """The first tool whose mark is in the page's text, else the first one of whose variables
    (a map by name) is set; null: none."""
    text = F.lower(html)
    names = F.transform(F.map_keys(variables), F.lower)
    by_text = F.coalesce(*(F.when(contains_any(text, marks), F.lit(n)) for n, _, marks, _ in R.POOL_TRACKERS if marks))
    by_name = F.coalesce(*(F.when(F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, held))), F.lit(False)), F.lit(n)) for n, _, _, held in R.POOL_TRACKERS if held))
    return F.coalesce(by_text, by_name)


def url_tracker(url: Column) -> Column:
    return first_match(F.lower(url), [(n, marks) for n, marks, _, _ in R.POOL_TRACKERS])


def prelander(url: Column) -> Column:
    has = lambda n: U.param(url, n).isNotNull()
    return F.coalesce(U.host(url).isin(*R.PRELANDERS), F.lit(False)) | (has("cep") & (has("lptoken") | has("widget_id") | has("boost_id")))


def cloaking(first: Column, last: Column, hops: Column | None = None) -> Column:
    """struct(changed, kind, forced, redirects, suspicious) of a chain's ends by registered domain:
    a tracker's domain that leads elsewhere, else a news domain that leads to a sales one,
    else a change. The first two force the verdict; over three redirects are suspicious."""
    a, b = U.registered_domain(first), U.registered_domain(last)
    changed = F.coalesce(a != b, F.lit(False))
    tracker = contains_any(a, R.CLOAK_TRACKERS)
    sold = contains_any(a, R.NEWS_WORDS) & (contains_any(b, R.SALES_WORDS) | F.coalesce(last.endswith(".shop"), F.lit(False)))
    kind = F.when(~changed, "none").when(tracker, "tracker_to_offer").when(sold, "news_to_sales").otherwise("domain_change")
    n = F.coalesce(hops, F.lit(0)) if hops is not None else F.lit(0)
    return F.struct(changed.alias("changed"), kind.alias("kind"), (changed & (tracker | sold)).alias("forced"), n.alias("redirects"), (n > 3).alias("suspicious"))
