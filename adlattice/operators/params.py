"""Ids of offers, affiliates, sub ids and clicks from URL parameters and payloads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import tables as R
from . import rules as O


#: Gives a parameter of a URL by its name.
Getter = Callable[[str], Column]


def _of(url: Column, get: Getter | None) -> tuple[Getter, Callable[[list[str]], Column]]:
    """How to get a parameter, and the first of several; by default each from the URL itself."""
    one = get or (lambda n: U.param(url, n))
    return one, lambda names: F.coalesce(*map(one, names))


def generic_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    """By ordered aliases."""
    _, first = _of(url, get)
    names = {"affiliate_id": R.AFFILIATE_ALIASES, "offer_id": R.OFFER_ALIASES, "sub_id1": R.SUB_ALIASES, "click_id": R.CLICK_ALIASES}
    return {k: first(ns) for k, ns in names.items()}


def second_ids(url: Column) -> dict[str, Column]:
    return {k: U.first_param(url, names) for k, names in R.SECOND_ALIASES.items()}


def clickbank_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    """From the error page's target, the form affiliate.product.hop.clickbank.net, or parameters;
    an affiliate parameter counts on a /cb/ path."""
    one, _ = _of(url, get)
    host, path = U.host(url), U.path(url)
    error = host.contains("hop-apps.clickbank.net")
    labels = F.split(host, r"\.")
    hop = host.contains("hop.clickbank.net") & (F.size(labels) >= 4)
    marked = path.contains("/cb/")
    target = F.when(error, one("destinationUrl"))
    of_path, of_host = F.when(marked, one("affiliate")), F.when(hop, F.get(labels, F.lit(0)))
    return {
        "affiliate_id": F.when(error, one("hop")).otherwise(F.coalesce(of_path, of_host, one("hop"))),
        "offer_id": F.when(~error & hop & (F.size(labels) >= 5), F.get(labels, F.lit(1))),
        "click_id": F.when(~error, one("hopId")),
        "offer_domain": U.host(target),
        "offer_url": target,
    }


def everflow_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    """Also the offer's own address, which the event source tells."""
    _, first = _of(url, get)
    on = first(["effp", "ef_click_id", "oid"]).isNotNull() | O.contains_any(F.lower(url), ["everflow", "djpcraze.com"])
    names = {"offer_id": ["oid"], "affiliate_id": ["affid", "aff_id"], "click_id": ["effp", "ef_click_id", "transaction_id"], "offer_domain": ["event_source_url"]}
    own = {k: F.when(on, first(ns)) for k, ns in names.items()}
    source = own["offer_domain"]
    return own | {"offer_url": F.when(source.startswith("http"), source).otherwise(F.concat(F.lit("https://"), source))}


def hasoffers_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    one, first = _of(url, get)
    on = O.contains_any(U.host(url), ["hasoffers.com", "tune.com", "go2cloud.org"]) | (one("offer_id").isNotNull() & one("aff_id").isNotNull())
    names = {"offer_id": ["offer_id"], "affiliate_id": ["aff_id"], "click_id": ["aff_click_id", "transaction_id"], "sub_id1": ["aff_sub"], "sub_id2": ["aff_sub2"]}
    return {k: F.when(on, first(ns)) for k, ns in names.items()}


def digistore_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    _, first = _of(url, get)
    on = U.host(url).contains("digistore24.com")
    names = {"offer_id": ["pay", "cid"], "affiliate_id": ["aff"], "click_id": ["uid"]}
    return {k: F.when(on, first(ns)) for k, ns in names.items()}


def impact_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    _, first = _of(url, get)
    on = O.contains_any(U.host(url), ["impact.com", "impactradius.com", "sjv.io", "prf.hn"])
    return {k: F.when(on, first(names)) for k, names in (("affiliate_id", ["irpid", "subid1"]), ("offer_id", ["campaignid"]), ("click_id", ["clickid"]))}


#: What the merged ids of a URL hold.
DECODED = ("affiliate_id", "offer_id", "sub_id1", "sub_id2", "click_id", "offer_domain", "offer_url")


def decoded_ids(url: Column, get: Getter | None = None) -> dict[str, Column]:
    """The ids of a URL by the networks' own forms, later ones over earlier ones, and by generic
    names over all: Everflow, ClickBank, HasOffers, Digistore, Impact, generic. A form counts
    only where its network is told by the URL."""
    one, first = _of(url, get)
    text = F.lower(url)
    told = [
        (everflow_ids(url, get), one("effp").isNotNull() | text.contains("djpcraze.com")),
        (clickbank_ids(url, get), first(["hop", "hopId"]).isNotNull() | text.contains("clickbank") | U.path(url).contains("/cb/")),
        (hasoffers_ids(url, get), None), (digistore_ids(url, get), None), (impact_ids(url, get), None), (generic_ids(url, get), None),
    ]
    out = {}
    for k in DECODED:
        found = [ids[k] if on is None else F.when(on, ids[k]) for ids, on in reversed(told) if k in ids]
        out[k] = F.coalesce(*found, F.lit(None).cast("string"))
    return out


def json_payload(value: Column, fields: dict[str, list[str]]) -> Column:
    """struct of fields from base64 JSON, each by ordered keys; tolerant of missing
    padding and of anything that isn't JSON."""
    text = F.try_to_binary(value, F.lit("base64")).cast("string")
    parsed = F.try_parse_json(text)
    return F.struct(*(F.coalesce(*(F.try_variant_get(parsed, f"$.{k}", "string") for k in keys)).alias(name) for name, keys in fields.items()))


def network_by_params(url: Column) -> Column:
    """The network that parameters, the host or the URL name, by an ordered ladder."""
    host, text = U.host(url), F.lower(url)

    def on(hosts: list[str], parts: list[str], names: list[str], values: list[tuple[str, str]]) -> Column:
        tests = [host.contains(h) for h in hosts] + [text.rlike(p) if p[0] == "^" else text.contains(p) for p in parts]
        tests += [U.param(url, n).isNotNull() for n in names] + [F.coalesce(U.param(url, n) == v, F.lit(False)) for n, v in values]
        return reduce(lambda a, b: a | b, tests)

    return F.coalesce(*(F.when(on(*tests), F.lit(name)) for name, *tests in R.NETWORK_LADDER), F.lit(None).cast("string"))


def config_offers(value: Column) -> Column:
    """struct(best, n) of a page's configuration, JSON in base64 that may be escaped for a URL:
    its valid URLs, at any depth; those under OFFER_KEYS first, in the keys' order, then
    by place. Anything else than base64 holds none."""
    text = F.try_to_binary(U.unescape(value), F.lit("base64")).cast("string")
    pair = r'(?:"([^"\\\\]*)"\s*:\s*)?"(https?://[^"\\\\]*)"'
    order = F.array(*map(F.lit, R.OFFER_KEYS))

    def found(text: Column) -> Column:
        keys, urls = (F.regexp_extract_all(text, F.lit(pair), F.lit(i)) for i in (1, 2))
        ranked = F.transform(F.arrays_zip(keys.alias("key"), urls.alias("url")), lambda x, i: F.struct(F.nullif(F.array_position(order, x["key"]), F.lit(0)).alias("rank"), i.alias("nth"), x["url"].alias("url")))
        fine = F.filter(ranked, lambda x: (x["rank"].isNotNull() | (F.length(x["url"]) > 20)) & O.valid_in_list(x["url"]))
        return F.transform(fine, lambda x: F.struct(F.coalesce(x["rank"], F.lit(len(R.OFFER_KEYS) + 1)).alias("rank"), x["nth"].alias("nth"), x["url"].alias("url")))

    def told(late: Column) -> Column:
        return F.struct(F.array_min(late)["url"].alias("best"), F.coalesce(F.size(F.array_distinct(F.transform(late, lambda x: x["url"]))), F.lit(0)).cast("long").alias("n"))

    # lists of one bind the text and the ranked URLs, so that each is computed once
    return F.get(F.transform(F.transform(F.array(text), found), told), F.lit(0))


def widget_config(url: Column) -> dict[str, Column]:
    """The widget's parameters, the tracker that a token tells of, the source, and the offer in a
    configuration of over 500 characters."""
    cep = U.param(url, "cep")
    return {k: U.param(url, p) for k, p in R.WIDGET_PARAMS.items()} | {
        "tracker": F.when(U.param(url, "lptoken").isNotNull(), F.lit("Custom/In-house")),
        "traffic_source": F.lit("Revcontent"),
        "offer": F.when(F.length(cep) > 500, config_offers(cep)["best"]),
    }
