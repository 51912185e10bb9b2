"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, labelled by occurrence so that each is
unique. A sketch takes the ORDER smallest labelled k-mers under a hash and keeps them
in text order, so that documents share it when they share those k-mers in that order,
which follows edit similarity. Documents that share a sketch are candidates; a banded
alignment of their k-mers decides; classes are the connected components of the links.

Equal texts are one node. Within a sketch's bucket, members are first compared with
its leader only, the member that shares most sketches with others, which stands near
the middle of a group of copies. Members of the leader's component need no further
comparison with each other. Each other member, a stray, is compared with those members
that an exact bound lets in: two texts share at most what both share with the leader
and what both have beyond it, k-mers that no other text has aside. So no link is lost,
and pairs within a large group are not made.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, ORDER = 24, 4

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEEDS = np.random.default_rng(17).integers(1, 2**63, SKETCHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words, by sums over their bytes and no loop over words."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACES[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return _mix((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def kmers(text: str | None) -> np.ndarray:
    """Hashes of the occurrence-labelled five-word shingles in text order; of a shorter
    text the one shingle it is; none without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.empty(0, np.uint64)
    words = word_hashes(raw)
    if len(words) == 0:
        return words
    k = min(SHINGLE, len(words))
    grams = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        grams = _mix(grams + words[i : len(words) - k + 1 + i] * np.uint64(2 * i + 3))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if not new.all():
        place = np.arange(len(grams))
        nth = np.empty(len(grams), dtype=np.uint64)
        nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        grams = _mix(grams + nth * np.uint64(0xD6E8FEB86659FD93))
    return grams


def sketches(grams: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the ORDER smallest k-mers in text order."""
    take = min(ORDER, len(grams))
    out = np.zeros(SKETCHES, dtype=np.uint64)
    for at in range(0, SKETCHES, 8):  # eight at a time bounds the memory of long texts
        seeds = _SEEDS[at : at + 8, None]
        values = _mix(grams[None, :] ^ seeds)
        least = np.argpartition(values, take - 1, axis=1)[:, :take] if take < len(grams) else np.tile(np.arange(take), (len(seeds), 1))
        picked = grams[np.sort(least, axis=1)]
        own = seeds[:, 0].copy()
        for i in range(take):
            own = _mix(own * np.uint64(31) + picked[:, i])
        out[at : at + 8] = own
    return out.astype(np.int64)


def _chain(places: list[int]) -> int:
    """Length of the longest increasing run of places."""
    tails: list[int] = []
    for p in places:
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of both texts, where that is at least `least`;
    else a lower bound of it. The alignment keeps to the band that `least` allows."""
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * (n - len(ia)):
        return 0.0
    band = n - 2 * least * n / (1 + least) + 1  # k-mers that may be left over
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near])
    run = ib[near][order]
    m = len(run) if (np.diff(run) > 0).all() else _chain(run.tolist())
    return m / (n - m)


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketched(docs: DataFrame) -> DataFrame:
    """(key, n, sketches) of each distinct text with words; n: its k-mers."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            keys, sizes, made = [], [], []
            for key, text in zip(part["key"], part["text"], strict=True):
                grams = kmers(text)
                if len(grams):
                    keys.append(key)
                    sizes.append(len(grams))
                    made.append(sketches(grams))
            yield {"key": keys, "n": sizes, "sketches": made}

    rows = map_rows(docs.select(text_key("text").alias("key"), "text"), run, "key binary, n long, sketches array<long>")
    return rows.groupBy("key").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))


def compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys with n_a, n_b and both, their k-mers and those that they
    share, and whether their texts are similar."""
    side = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))
    rows = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        last, grams = None, None  # rows of one leader mostly follow each other
        for part in parts:
            out: dict[str, list] = {"a": part["a"], "b": part["b"], "n_a": [], "n_b": [], "both": [], "similar": []}
            for a, ta, tb in zip(part["a"], part["text_a"], part["text_b"], strict=True):
                if a != last:
                    last, grams = a, kmers(ta)
                other = kmers(tb)
                out["n_a"].append(len(grams))
                out["n_b"].append(len(other))
                out["both"].append(len(np.intersect1d(grams, other, assume_unique=True)))
                out["similar"].append(similarity(grams, other, least) >= least)
            yield out

    schema = "a binary, b binary, n_a long, n_b long, both long, similar boolean"
    return cut(map_rows(rows.select("a", "text_a", "b", "text_b"), run, schema, step=64))


def own_kmers(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, own): how many k-mers of each text are in none of the others."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            yield {"key": part["key"], "grams": [kmers(t).astype(np.int64) for t in part["text"]]}

    grams = map_rows(texts.join(keys, "key", "left_semi").select("key", "text"), run, "key binary, grams array<long>", step=64)
    once = grams.select("key", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    return once.groupBy("key").agg(F.count("*").alias("own"))


def _sum_of(edges: DataFrame):
    """Number of edges and a sum of their hashes: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(key, root) for the keys in links: root is the smallest key of the component.

    Each round links every node to the least of its neighbours (large star, then small
    star), by partial minima and joins; the number of rounds grows with the logarithm of
    the longest path. Minima leave each task; the narrow links of one node meet in a
    task of the join.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, now = None, _sum_of(edges)
    while before != now:
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).withColumn("m", F.least("x", "m"))
        met = ways.join(least, F.col("u") == F.col("x"))
        # a larger neighbour is handed over to the least; a node keeps its own link to it
        large = met.select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(floor, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(floor.select("x", "m")).where("u <> v").distinct())
        before, now = now, _sum_of(edges)
    roots = edges.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def similar_texts(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(key, root) for the distinct texts that are similar to another."""
    nodes = cut(sketched(docs))
    members = nodes.select("key", F.explode("sketches").alias("sketch"))
    sizes = members.groupBy("sketch").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(members.join(sizes, "sketch"))
    weight = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    leaders = shared.join(weight, "key").groupBy("sketch").agg(F.max(F.struct("weight", "key"))["key"].alias("leader"))
    led = cut(shared.join(leaders, "sketch"))
    star = led.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    wanted = star.select(F.col("a").alias("key")).union(star.select("b")).distinct()
    texts = docs.select(text_key("text").alias("key"), "text").join(wanted, "key", "left_semi")
    texts = cut(texts.groupBy("key").agg(F.first("text").alias("text")))
    met = compared(star, texts, least)
    links = met.where("similar").select("a", "b")
    roots = components(links)
    pairs = cut(strays(led, nodes, roots, met, texts, least))
    if pairs.isEmpty():
        return roots
    more = compared(pairs, texts, least).where("similar").select("a", "b")
    return roots if more.isEmpty() else components(links.union(more))


def strays(led: DataFrame, nodes: DataFrame, roots: DataFrame, met: DataFrame, texts: DataFrame, least: float, block: int = 256) -> DataFrame:
    """Distinct pairs of keys in a bucket that were not compared, aren't in one component
    and may be similar by the bound.

    Pairs within the leader's component are never made: one side is a stray. The members
    of a large bucket are dealt to salted parts, so no task holds a whole bucket.
    """
    known = led.where("size > 2").join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    of_leader = roots.select(F.col("key").alias("leader"), F.col("root").alias("head"))
    known = known.join(of_leader, "leader", "left").withColumn("head", F.coalesce("head", "leader"))
    known = cut(known.join(known.where("root <> head").select("sketch").distinct(), "sketch", "left_semi"))
    own = own_kmers(texts, known.select("key").distinct())
    with_leader = met.select(F.col("a").alias("leader"), F.col("b").alias("key"), "both")
    rows = (
        known.join(with_leader, ["leader", "key"], "left")
        .join(nodes.join(own, "key", "left"), "key")
        .withColumn("both", F.coalesce("both", "n"))  # the leader itself
        .withColumn("beyond", F.col("n") - F.col("both") - F.coalesce("own", F.lit(0)))
        .where((F.col("both") + F.col("beyond")) >= F.lit(least) * F.col("n"))
        .withColumn("_parts", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    )
    here = rows.where("root <> head").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    there = rows.withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    names = ("key", "root", "n", "both", "beyond", "sketches")
    x = here.select("sketch", "_part", *(F.col(c).alias(f"{c}_x") for c in names))
    y = there.select("sketch", "_part", *(F.col(c).alias(f"{c}_y") for c in names))
    most = F.least("both_x", "both_y") + F.least("beyond_x", "beyond_y")
    needed = F.lit(least / (1 + least)) * (F.col("n_x") + F.col("n_y")) - F.lit(1e-6)
    # of the buckets that a pair shares, the one with the least sketch makes it
    once = F.col("sketch") == F.array_min(F.array_intersect("sketches_x", "sketches_y"))
    found = x.join(y, ["sketch", "_part"]).where((F.col("root_x") != F.col("root_y")) & (most >= needed) & once)
    found = found.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()
    done = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.join(done, ["a", "b"], "left_anti")


def rooted(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, key and root, the class, of every row."""
    roots = roots.select(F.col("key").alias("_key"), "root")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select("doc_id", text_key("text").alias("key"), has_words.alias("_words"))
    rows = rows.join(roots, F.col("key") == F.col("_key"), "left")
    own = F.encode(F.concat(F.lit("doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "utf-8")
    return rows.select("doc_id", "key", F.when(F.col("_words"), F.coalesce("root", "key")).otherwise(own).alias("root"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and class_size for every row; class_id is the smallest doc_id of
    the class.

    Documents without words (null and empty ones too) are each their own class; equal
    texts are one class. Repeated rows count each in class_size. An empty table gives no
    rows. Whole texts are read, of any length, in the tasks that hold them. Columns other than doc_id and text are not read.
    """
    rows = rooted(docs, similar_texts(docs, least))
    named = rows.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, F.col("root") == F.col("_root")).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: of those with the smallest doc_id, where null is
    smallest, and of its texts the one with the smallest hash; of rows that repeat both,
    the one with the smallest hash of all columns, so that reruns agree.

    Documents without words are each their own class. An empty table stays so. Names of
    docs' columns can't clash.
    """
    rows = cut(rooted(docs, similar_texts(docs, least)))
    best = rows.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct("doc_id", "key")).alias("_best"))
    gone = (
        rows.join(best, F.col("root") == F.col("_root"))
        .where(~(F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("key") == F.col("_best.key"))))
        .select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
        .distinct()
    )
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key("text").alias("key"))
    left = keyed.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # whole rows are repeated
        order = Window.partitionBy(F.col("row.doc_id"), "key").orderBy(F.xxhash64(F.to_json("row")))
        left = left.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return left.select("row.*")
