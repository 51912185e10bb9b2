"""Normalising ad feeds: JSON payloads to rows of title, landing and image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_KEYS = ("items", "data", "ads", "content", "list", "documents", "listings", "doc")
MOST_DEPTH = 1000  # the JSON parser allows no deeper nesting
TITLE_KEYS = ("title", "text", "name", "content", "headline")
LANDING_KEYS = ("articleUrl", "targetUrl", "destinationUrl", "originalUrl", "url", "clickUrl", "landing", "link")
IMAGE_KEYS = ("mainImage", "image", "thumbnail")


def _first(v: Column, keys: tuple[str, ...]) -> Column:
    """The first key with a value; an empty string falls through."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys))


def unwrap(payload: Column) -> Column:
    """The JSON of a plain or JSONP payload."""
    return F.regexp_extract(payload, r"(?s)^[^\[{]*?([\[{].*[\]}])[^\]}]*$", 1)


def _items(root: Column, payload: Column) -> Column:
    """Items of every list: at the root or under LIST_KEYS all, under other keys those with
    a title or content. Objects are entered at any depth, lists aren't."""
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    has = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()

    def kept(e: Column) -> Column:
        return F.filter(F.coalesce(listed(e["value"]), none), lambda v: e["key"].isin(*LIST_KEYS) | has(v, "title") | has(v, "content"))

    def step(state: Column, _: Column) -> Column:
        entries = F.flatten(F.transform(state["objects"], lambda o: F.map_entries(fields(o))))
        inner = F.transform(F.filter(entries, lambda e: fields(e["value"]).isNotNull()), lambda e: e["value"])
        return F.struct(inner.alias("objects"), F.concat(state["items"], F.flatten(F.transform(entries, kept))).alias("items"))

    none = F.array().cast("array<variant>")
    objects = F.when(fields(root).isNotNull(), F.array(root)).otherwise(none)
    start = F.struct(objects.alias("objects"), F.coalesce(listed(root), none).alias("items"))
    # a fold over as many levels as there are objects; a level without any is cheap
    levels = F.least(F.length(F.regexp_replace(payload, r"[^{]", "")), F.lit(MOST_DEPTH))
    return F.aggregate(F.array_repeat(F.lit(0), levels), start, step)["items"]


def normalise(feeds: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, title, landing, image) of each item of a feed: of all lists at the root
    or in its objects at any depth (see _items). pos runs over a feed's lists level by
    level, by key within an object. Bad JSON gives no rows."""
    root = F.try_parse_json(unwrap(F.col(payload)))
    rows = feeds.select(key, payload, root.alias("_root")).select(key, F.posexplode(_items(F.col("_root"), F.col(payload))).alias("pos", "v"))
    image = F.coalesce(F.try_variant_get("v", "$.image.url", "string"), F.try_variant_get("v", "$.thumbnail[0].url", "string"), _first(F.col("v"), IMAGE_KEYS))
    return rows.select(key, "pos", _first(F.col("v"), TITLE_KEYS).alias("title"), _first(F.col("v"), LANDING_KEYS).alias("landing"), image.alias("image")).where("landing is not null")
