"""Weighted signals as a table of rules, matched against the texts of a page.

One pass gives the rows (key, kind, signal, weight); sums, samples and verdicts are
groupings of these narrow rows. The rules are data: lists of any length leave the plan
as it is, and the texts themselves are never shuffled while the table is small enough to
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as O

RULES = "prio int, kind_prio int, kind string, field string, signal string, weight int"


def table(spark: SparkSession, sets: list[tuple[str, list[str], list[tuple[str, int]]]]) -> DataFrame:
    """The rules as rows; prio and kind_prio keep the order in which they are declared."""
    rows, prio = [], 0
    for i, (kind, fields, signals) in enumerate(sets):
        for signal, weight in signals:
            rows += [(prio, i, kind, field, signal, weight) for field in fields]
            prio += 1
    return spark.createDataFrame(rows, RULES)


def hits(df: DataFrame, key: str, fields: dict[str, Column], rules: DataFrame, most: int = O.MOST_BROADCAST) -> DataFrame:
    """(key, prio, kind_prio, kind, signal, weight) for each field that holds a signal. Texts are
    compared in lower case; null texts and empty signals match nothing."""
    texts = F.array(*(F.struct(F.lit(n).alias("field"), F.lower(c).alias("_text")) for n, c in fields.items()))
    rows = df.select(F.col(key).alias("_key"), F.inline(texts)).where("_text IS NOT NULL")
    met = O.substring_rows(rows, "_text", rules.withColumnRenamed("signal", "pattern"), most, on=["field"])
    return met.select(F.col("_key").alias(key), "prio", "kind_prio", "kind", F.col("pattern").alias("signal"), "weight")


def scores(df: DataFrame, key: str, fields: dict[str, Column], rules: DataFrame, most: int = O.MOST_BROADCAST) -> DataFrame:
    """(key, kind_prio, kind, score, signals) for the kinds that a row meets: the sum of the weights
    of its signals, each once, and the signals in the rules' order."""
    own = F.array_sort(F.collect_set(F.struct("prio", "signal", "weight")))
    kinds = hits(df, key, fields, rules, most).groupBy(key, "kind_prio", "kind").agg(own.alias("own"))
    total = F.aggregate("own", F.lit(0), lambda n, x: n + x["weight"])
    return kinds.select(key, "kind_prio", "kind", total.alias("score"), F.col("own.signal").alias("signals"))


def best_kind(df: DataFrame, key: str, fields: dict[str, Column], rules: DataFrame, least: int = 3, high: int = 8, medium: int = 4, most: int = O.MOST_BROADCAST) -> DataFrame:
    """(key, best, confidence, score, all_scores, top_signals) for every row: the kind of the largest
    sum, the first declared on ties; under `least` Unknown, without a sample of signals.
    all_scores holds the kinds that score."""
    found = scores(df, key, fields, rules, most)
    top = F.max(F.struct("score", (-F.col("kind_prio")).alias("order"), "kind", "signals")).alias("top")
    found = found.groupBy(key).agg(top, F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "score")))).alias("all_scores"))
    score = F.coalesce(F.col("top.score"), F.lit(0))
    known = score >= least
    none = F.array().cast("array<string>")
    return df.select(key).join(found, key, "left").select(
        key,
        F.when(known, F.col("top.kind")).otherwise("Unknown").alias("best"),
        F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low").alias("confidence"),
        score.alias("score"),
        F.coalesce("all_scores", F.create_map().cast("map<string,int>")).alias("all_scores"),
        F.when(known, F.slice("top.signals", 1, 5)).otherwise(none).alias("top_signals"),
    )


def of_kinds(df: DataFrame, key: str, fields: dict[str, Column], rules: DataFrame, kinds: list[str], most: int = O.MOST_BROADCAST) -> DataFrame:
    """(key, kind_score, kind_signals for each of `kinds`) for every row."""
    cell = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = scores(df, key, fields, rules, most).groupBy(key).agg(*(cell(k, c).alias(f"{k}_{c}") for k in kinds for c in ("score", "signals")))
    none = F.array().cast("array<string>")
    filled = [F.coalesce(f"{k}_score", F.lit(0)).alias(f"{k}_score") for k in kinds] + [F.coalesce(f"{k}_signals", none).alias(f"{k}_signals") for k in kinds]
    return df.select(key).join(wide, key, "left").select(key, *filled)


def fingerprints(df: DataFrame, key: str, html: Column, rules: DataFrame, most: int = O.MOST_BROADCAST) -> DataFrame:
    """(key, network, n, matches, networks) for every row: the ad network with most marks, the first
    declared on ties, its number of marks, up to three of them, and all networks from most
    marks to fewest."""
    found = scores(df, key, {"html": html}, rules, most)
    rank = F.struct((-F.size("signals")).alias("less"), "kind_prio", "kind", "signals")
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(rank)).alias("all"))
    first = F.get("all", F.lit(0))
    return df.select(key).join(found, key, "left").select(
        key, first["kind"].alias("network"), F.coalesce(F.size(first["signals"]), F.lit(0)).alias("n"), F.slice(first["signals"], 1, 3).alias("matches"),
        F.coalesce(F.col("all.kind"), F.array().cast("array<string>")).alias("networks"),
    )


def page_validity(df: DataFrame, key: str, title: Column, body: Column, html: Column, rules: DataFrame, least_chars: int = 400, most_ads: int = 5) -> DataFrame:
    """(key, valid, reason, matched_signal, offer_score, offer_signals, arbitrage_score, has_meta,
    body_length) for every row; the first reason holds: a redirect or challenge page by
    title or start, thin content, a page of ads."""
    fields = {"title": title, "head": F.substring(body, 1, 500), "body": body, "html": html}
    page = F.lower(html)
    meta = F.coalesce(page.contains('name="description"') | page.contains('property="og:description"') | page.contains('property="og:title"'), F.lit(False))
    size = F.coalesce(F.length(F.trim(body)), F.lit(0))
    facts = df.select(key, size.alias("body_length"), meta.alias("has_meta"))
    found = of_kinds(df, key, fields, rules, ["tracking", "offer", "arbitrage"]).join(facts, key)
    reason = (
        F.when(F.col("tracking_score") > 0, "tracking_redirect_page")
        .when(F.col("body_length") < least_chars, "thin_content")
        .when(F.col("arbitrage_score") >= most_ads, "arbitrage_page")
    )
    return found.select(
        key, reason.isNull().alias("valid"), reason.alias("reason"), F.get("tracking_signals", F.lit(0)).alias("matched_signal"), "offer_score",
        F.slice("offer_signals", 1, 5).alias("offer_signals"), "arbitrage_score", "has_meta", "body_length",
    )


def arbitrage(df: DataFrame, key: str, url: Column, html: Column, marks: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, arbitrage, score, signals) for every row: the weights of the URL's and the page's
    marks, only where an ad network's fingerprint is in the page."""
    found = of_kinds(df, key, {"url": url, "html": html}, rules, ["url", "content"])
    owned = fingerprints(df, key, html, marks).select(key, F.col("network").isNotNull().alias("arbitrage"))
    score = F.col("url_score") + F.col("content_score")
    none = F.array().cast("array<string>")
    return found.join(owned, key).select(key, "arbitrage", F.when(F.col("arbitrage"), score).otherwise(0).alias("score"), F.when(F.col("arbitrage"), F.concat("url_signals", "content_signals")).otherwise(none).alias("signals"))
