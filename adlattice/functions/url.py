"""URL column functions. They never raise: malformed URLs split by the generic regular
expression, malformed escapes stay as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import tables as R

#: The generic split of RFC 3986, appendix B: scheme, authority, path, query, fragment.
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    bare = F.regexp_replace(F.lower(netloc(url)), r"^[^@]*@|:[0-9]*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def _suffixes() -> tuple[str, str, str]:
    """The bundled suffixes as alternations: exceptions, those under which any label is a
    suffix, and listed ones."""
    own, wild, listed = [], [], []
    for top, names in R.SUFFIXES.items():
        for name in names:
            kind = own if name[0] == "!" else wild if name == "*" else listed
            kind.append(rf"{name.lstrip('!')}\.{top}" if name != "*" else top)
    return "|".join(own), "|".join(wild), "|".join(listed)


def suffix_patterns() -> list[str]:
    """Regular expressions of a registered domain, of which the first that matches a host
    decides; for engines without look-around."""
    own, wild, listed = _suffixes()
    return [rf"(?:^|\.)({own})$", rf"([^.]+\.[^.]+\.(?:{wild}))$", rf"([^.]+\.(?:{listed}))$", r"([^.]+\.[^.]+)$"]


def registered_domain(url: Column) -> Column:
    """The label under the longest public suffix of the host, with it, by the bundled suffixes; the
    host where it is an address, a suffix or a single label. One replacement drops the
    labels before it. By a table of suffixes: operators.domains."""
    own, wild, listed = _suffixes()
    domain = rf"(?:{own}|[^.]+\.(?!(?:{own})$)[^.]+\.(?:{wild})|[^.]+\.(?:{listed})|[^.]+\.[^.]+)$"
    return F.regexp_replace(host(url), rf"^(?:.*?\.)??(?=(?![0-9.]+$){domain})", "")


def unescape(x: Column) -> Column:
    """Percent-decoded, plus signs kept; malformed escapes stay."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)


def param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded; null if there is none. One
    match on the whole URL, so that many parameters stay a small expression."""
    found = F.get(F.regexp_extract_all(url, F.lit(rf"^[^?#]*\?(?:[^#]*?&)??{re.escape(name)}=([^&#]+)"), F.lit(1)), F.lit(0))
    return F.coalesce(F.try_url_decode(found), found)


def first_param(url: Column, names: list[str]) -> Column:
    """The first of several parameters that has a value."""
    return F.coalesce(*(param(url, n) for n in names))


def params(url: Column) -> Column:
    """All parameters as a map; the first non-blank value of a name wins."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.length(F.substring_index(p, "=", -1)) > 0)
    pairs = F.filter(pairs, lambda p: p.contains("="))
    entries = F.transform(
        pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), unescape(F.regexp_replace(F.regexp_extract(p, "=(.*)$", 1), r"\+", " ")).alias("v"))
    )
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda f: f["k"] == e["k"]))
    return F.map_from_entries(first)


def pairs(url: Column) -> Column:
    """The parameters with a value as an array of struct(k, v), in order, decoded. Kept as a
    column, many look-ups by `value_of` are small expressions."""
    cut = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    return F.transform(F.filter(cut, lambda e: e["v"] != ""), lambda e: F.struct(e["k"].alias("k"), F.coalesce(F.try_url_decode(e["v"]), e["v"]).alias("v")))


def value_of(held: Column, name: str) -> Column:
    """The first value of a parameter in `pairs`."""
    return F.get(F.filter(held, lambda e: e["k"] == name), F.lit(0))["v"]


def _named(pair: Column, names: list[str]) -> Column:
    return F.lower(F.substring_index(pair, "=", 1)).isin(*(n.lower() for n in names))


def strip_tracking(url: Column) -> Column:
    """url without tracking parameters; affiliate parameters stay."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (F.length(p) > 0) & (_named(p, R.KEEP_PARAMS) | ~_named(p, R.DROP_PARAMS)))
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    tail = F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), tail)


def landing_key(url: Column) -> Column:
    """url without the query and fragment, and without a click id glued to the path."""
    bare = F.substring_index(F.substring_index(F.substring_index(url, "&dicbo=", 1), "?", 1), "#", 1)
    return bare


def blank_macros(url: Column) -> Column:
    """url with the values of unresolved macros blanked."""
    return F.regexp_replace(url, r"=(\{[^}]+\}|__[A-Z]+__)", "=")


def same_page(a: Column, b: Column) -> Column:
    place = lambda u: F.concat(F.lower(netloc(u)), F.regexp_replace(F.lower(path(u)), "/+$", ""))
    return F.coalesce(place(a) == place(b), F.lit(False))


def absolute(base: Column, ref: Column) -> Column:
    """ref as an absolute URL on the page base."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), ref))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), ref))
    )


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def origin(url: Column) -> Column:
    return F.concat(F.substring_index(url, "/", 3), F.lit("/"))


def hidden_offer(url: Column) -> Column:
    """The offer in a URL's voluumdata, JSON in base64, whatever its padding; null if there is none."""
    data = unescape(F.regexp_extract(url, "voluumdata=([^&]*)", 1))
    size = F.length(data)
    text = F.try_to_binary(F.rpad(data, size + F.pmod(-size, F.lit(4)), "="), F.lit("base64")).cast("string")
    return F.try_variant_get(F.try_parse_json(text), "$.offer", "string")


def peel(url: Column, depth: int = 3) -> Column:
    """The innermost URL carried in an encoded payload or a destination parameter, at most `depth`
    deep; a payload comes before parameters."""

    def step(u: Column, _: Column) -> Column:
        inner = first_param(u, R.TARGET_PARAMS)
        carried = F.when(u.contains("=http") & inner.startswith("http"), inner)
        return F.coalesce(F.when(u.contains("voluumdata="), hidden_offer(u)), carried, u)

    # a fold, as nesting the step would repeat it at every use
    return F.aggregate(F.array(*map(F.lit, range(depth))), url, step)


def peel_ad_server(url: Column) -> Column:
    """The target of an ad server's link, by the server's ordered parameters."""
    steps = [F.when(host(url).endswith(server), first_param(url, names)) for server, names in R.AD_SERVERS]
    return F.coalesce(*steps, url)


def clean_thumbnail(url: Column) -> Column:
    inner = F.regexp_extract(url, r"/ui/\?src=([^&]+)", 1)
    return with_scheme(F.substring_index(F.when(inner != "", unescape(inner)).otherwise(url), "?", 1))


def plausible(url: Column) -> Column:
    return F.coalesce(host(url).contains("."), F.lit(False))


def host_suffixes(host_: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
