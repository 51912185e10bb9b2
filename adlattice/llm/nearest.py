"""Approximate nearest neighbours by inner product.

Vectors get one more component that makes their lengths equal, so that the largest
inner product is the smallest distance. A few Gaussian (2-stable) projections keep
distances up to a chi-square factor. A kd-tree over the projections deals the vectors
to leaves. A query visits leaves nearest box first, in rounds; within a leaf its
projected neighbours are verified, nearest first, up to the projected distance at which
the chi-square test says that a vector nearer than the k-th found so far would have
been met with probability CONFIDENCE. The same test closes a leaf whose box is beyond it.

Equal vectors are searched once. The tree's cuts come from a bounded sample, every
vector is indexed; a leaf with more than LEAF vectors is dealt to parts, all of which
are searched. Only queries that visit a leaf are sent there, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PROJECTIONS = 24  # even, for the closed form of the chi-square distribution
CONFIDENCE = 0.85
SAMPLE = 20_000  # rows that fix the tree
MOST_LEAVES = 1024  # about 20 sampled rows each; beyond, leaves have more parts
LEAF = 4096
QUERY_BLOCK = 4096
SALTS = 64


def chi_square(x: float, m: int = PROJECTIONS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def quantile(p: float, m: int = PROJECTIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def usable(vector: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda c: c != 0)


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Axis and threshold of each inner node of a complete tree in heap order, by
    medians of the widest axis."""
    nodes: list[tuple[int, float]] = []
    parts = [points]
    while len(parts) < leaves:
        below = []
        for part in parts:
            if len(part) == 0:
                nodes.append((0, 0.0))
                below += [part, part]
                continue
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            at = float(np.median(part[:, axis]))
            nodes.append((axis, at))
            below += [part[part[:, axis] < at], part[part[:, axis] >= at]]
        parts = below
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf's number of each point."""
    at = np.zeros(len(points), dtype=np.int64)
    if nodes:
        axes, cuts = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        for _ in range((len(nodes) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= cuts[at])
    return at - len(nodes)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)), dtype=np.float32)
    for i in range(points.shape[1]):
        x = points[:, i, None]
        gap = np.maximum(np.maximum(low[None, :, i] - x, x - high[None, :, i]), 0.0)
        out += gap * gap
    return out


def matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def rows_of(x: np.ndarray) -> pa.Array:
    """A matrix's rows as a binary column."""
    width = x.itemsize * x.shape[1]
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def best_of(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of hits (query's number, score), the places of the k best of each query."""
    order = np.lexsort((-scores, at))
    place = np.arange(len(order))
    new = np.append(True, np.diff(at[order]) != 0) if len(order) else np.empty(0, bool)
    nth = place - np.maximum.accumulate(np.where(new, place, 0)) if len(order) else place
    return order[nth < k]


class Leaf:
    """The vectors of one part of a leaf, with their projections."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, top: float):
        self.vectors, self.points, self.top = vectors, points, top
        self.light = vectors.astype(np.float32)
        self.lengths = (points * points).sum(axis=1)
        self.slack = 1e-5 * (1.0 + math.sqrt(top))  # more than float32 loses, for a query of length 1

    def verify(self, q: np.ndarray, let_in: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, row, inner product) of the candidates that are let in and whose
        product, in double precision, is at least the query's `least`."""
        light = q.astype(np.float32)
        floor = least - self.slack * (1.0 + np.sqrt((q * q).sum(axis=1)))
        found = []
        for i in range(len(q)):
            rows = np.flatnonzero(let_in[i])
            rows = rows[self.light.take(rows, axis=0) @ light[i] >= floor[i]]
            if len(rows):
                products = (self.vectors[rows] * q[i]).sum(axis=1)
                near = products >= least[i]
                found.append((np.full(near.sum(), i), rows[near], products[near]))
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, np.empty(0))

    def search(self, q: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's number, row, inner product) of the k best that the test lets in, and
        how many were verified. bound: squared distances known to hold k vectors."""
        base = (q * q).sum(axis=1) + self.top
        away = np.maximum((p * p).sum(axis=1)[:, None] + self.lengths[None, :] - 2.0 * (p @ self.points.T), 0.0)
        first, done = min(len(self.points), 2 * k), 0
        if len(self.points) > k and not np.isfinite(bound).all():  # the nearest by projection give a bound
            near = np.argpartition(away, first - 1, axis=1)[:, :first]
            products = np.einsum("qcd,qd->qc", self.light[near], q.astype(np.float32)).astype(float)
            kth = np.partition(products, first - k, axis=1)[:, first - k] - self.slack * (1.0 + np.sqrt((q * q).sum(axis=1)))
            bound = np.minimum(bound, np.maximum(base - 2.0 * kth, 0.0))
            done += near.size
        let_in = away <= (factor * bound)[:, None]
        done += int(let_in.sum())
        at, rows, scores = self.verify(q, let_in, np.where(np.isfinite(bound), (base - bound) / 2.0 - 1e-12, -np.inf))
        best = best_of(at, scores, k)
        return at[best], rows[best], scores[best], done


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 5, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries its k best rows of vectors
    (vec_id, embedding) other than its own, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, and
    neither do those of another length than most. No rows give no rows; with fewer than
    k candidates all are returned. Repeated rows, of one vec_id and vector, count once on
    either side; a vec_id with several vectors is several queries and candidates. Equal
    vectors are ranked by vec_id; of each, the k + 1 smallest are kept, as no others can
    be among k. Only vec_id and embedding are read. counts, if given, gets the numbers of
    (query, vector) pairs and of visited leaves and verified pairs among them.
    """
    spark = vectors.sparkSession

    def read(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & usable("embedding"))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    fine = read(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    sizes = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = sizes["dim"], sizes["n"], sizes["top"]
    classed = lambda df: df.where(F.size("v") == dim).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    fine, asked = classed(fine), classed(read(queries))
    leaves = min(MOST_LEAVES, 1 << max(0, math.ceil(math.log2(max(1.0, n / LEAF)))))
    gauss = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))
    factor = quantile(CONFIDENCE)

    def project(v: np.ndarray, lift: bool) -> np.ndarray:
        points = v @ gauss[:-1]
        if lift:
            points = points + np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))[:, None] * gauss[-1]
        return points.astype(np.float32)

    sample = fine.orderBy(F.xxhash64("vec_id"), "h1").limit(SAMPLE).select("h1", "v").collect() if leaves > 1 else []
    sample = np.array([v for _, v in sorted({r.h1: r.v for r in sample}.items())], dtype=float).reshape(-1, dim)
    nodes = split_tree(project(sample, True), leaves) if leaves > 1 else []

    # of equal vectors the k + 1 smallest ids; partitions keep no more of a vector before they send
    once = fine.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v"))
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))

    def flat(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = flat(batch)
                p = project(v, True)
                made = [pa.array(leaf_of(p, nodes)), batch.column("h1"), batch.column("ids"), rows_of(v), rows_of(p)]
                yield pa.RecordBatch.from_arrays(made, names=["leaf", "h1", "ids", "v", "p"])

    placed = cut(classes.mapInArrow(place, "leaf long, h1 long, ids array<long>, v binary, p binary"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, p = batch.column("leaf").to_numpy(), matrix(batch.column("p"), np.float32)
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
                low, high = np.minimum.reduceat(p[order], first), np.maximum.reduceat(p[order], first)
                n = np.diff(np.append(first, len(order)))
                made = [pa.array(own[order][first]), pa.array(n), *(pa.array(x[:, i]) for i in range(PROJECTIONS) for x in (low, high))]
                yield pa.RecordBatch.from_arrays(made, names=["leaf", "n", *(f"{x}{i}" for i in range(PROJECTIONS) for x in ("low", "high"))])

    ends = [f"{x}{i}" for i in range(PROJECTIONS) for x in ("low", "high")]
    boxes = placed.select("leaf", "p").mapInArrow(measure, "leaf long, n long, " + ", ".join(f"{x} float" for x in ends))
    boxes = boxes.groupBy("leaf").agg(F.sum("n").alias("n"), *((F.min if x[0] == "l" else F.max)(x).alias(x) for x in ends))
    boxes = boxes.orderBy("leaf").toPandas()  # at most MOST_LEAVES rows
    box_leaf = boxes["leaf"].to_numpy()
    low, high = (boxes[[f"{x}{i}" for i in range(PROJECTIONS)]].to_numpy(np.float32) for x in ("low", "high"))
    parts = np.maximum(1, -(-boxes["n"].to_numpy() // LEAF))

    def per_leaf(name: str, values) -> DataFrame:
        """A value for each leaf: at most MOST_LEAVES rows."""
        return F.broadcast(spark.createDataFrame([(int(i), int(x)) for i, x in zip(box_leaf, values, strict=True)], f"leaf long, {name} int"))

    index = placed.join(per_leaf("parts", parts), "leaf").withColumn("part", F.pmod("h1", "parts").cast("int"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = flat(batch)
                made = [batch.column("h1"), batch.column("h2"), rows_of(v), rows_of(project(v, False)), pa.array(np.full(len(v), np.inf))]
                yield pa.RecordBatch.from_arrays(made, names=["h1", "h2", "q", "p", "bound"])

    state = "h1 long, h2 long, q binary, p binary, bound double"
    asks = cut(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")).mapInArrow(start, state))

    def wanted(first: int, last: int, blocks: np.ndarray | None):
        """The visits to a query's first to last but one nearest leaves that the test doesn't
        close: their leaves' numbers, or with blocks all of the query for each part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    limit = factor * batch.column("bound").to_numpy(zero_copy_only=False)
                    away = box_distances(matrix(batch.column("p"), np.float32), low, high)
                    nth = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
                    q, leaf = np.nonzero((nth >= first) & (nth < last) & (away <= limit[:, None]))
                    if blocks is None:
                        yield pa.RecordBatch.from_arrays([pa.array(box_leaf[leaf])], names=["leaf"])
                        continue
                    each = parts[leaf]
                    part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    q, leaf = np.repeat(q, each), np.repeat(leaf, each)
                    rows = batch.take(pa.array(q))
                    block = np.mod(rows.column("h2").to_numpy(), blocks[leaf])
                    made = [pa.array(box_leaf[leaf]), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), *rows.columns]
                    yield pa.RecordBatch.from_arrays(made, names=["leaf", "part", "block", *rows.schema.names])

        return run

    def visit(rows: pa.Table, visits: pa.Table) -> pa.Table:
        q, p = matrix(visits["q"], float), matrix(visits["p"], np.float32)
        bound = visits["bound"].to_numpy()
        hits, done = [], 0
        if len(q) and rows.num_rows:
            leaf = Leaf(matrix(rows["v"], float), matrix(rows["p"], np.float32), top)
            for i in range(0, len(q), 256):
                at, row, score, n = leaf.search(q[i : i + 256], p[i : i + 256], bound[i : i + 256], k + 1, factor)
                hits.append((at + i, row, score))
                done += n
        at, row, score = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        made = [visits["h1"].take(pa.array(at)), visits["h2"].take(pa.array(at)), pa.array(score), rows["h1"].take(pa.array(row)), rows["ids"].take(pa.array(row))]
        report = [pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.int64()), (float(done), pa.float64()), (None, pa.int64()), (None, pa.list_(pa.int64())))]
        names = ["h1", "h2", "score", "own", "ids"]
        return pa.concat_tables([pa.table(report, names=names), pa.table([c.cast(r.type) for c, r in zip(made, report, strict=True)], names=names)])

    best, seen = None, 0
    for last in (1, 1 + len(box_leaf) // 32, len(box_leaf)):
        if seen >= min(last, len(box_leaf)):
            continue
        loads = dict(asks.mapInArrow(wanted(seen, last, None), "leaf long").groupBy("leaf").count().collect())
        if not loads:
            break
        blocks = np.array([-(-loads.get(int(i), 0) // QUERY_BLOCK) for i in box_leaf])
        visits = asks.mapInArrow(wanted(seen, last, np.maximum(blocks, 1)), f"leaf long, part int, block int, {state}")
        there = index.join(per_leaf("blocks", blocks), "leaf").where("blocks > 0").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        keys = ["leaf", "part", "block"]
        found = there.select(*keys, "h1", "ids", "v", "p").groupBy(*keys).cogroup(visits.groupBy(*keys))
        found = found.applyInArrow(visit, "h1 long, h2 long, score double, own long, ids array<long>")
        if counts is not None:
            found = cut(found)
            counts["visits"] = counts.get("visits", 0) + sum(loads.values())
            counts["verified"] = counts.get("verified", 0) + int(found.where("ids IS NULL").agg(F.sum("score")).first()[0] or 0)
        found = found.where("ids IS NOT NULL")
        found = found if best is None else best.unionByName(found)
        order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0])
        best = cut(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n"))
        seen = last
        if seen < len(box_leaf):
            full = best.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.min("score").alias("_s")).where(F.col("_n") == k + 1)

            def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        q = matrix(batch.column("q"), float)
                        s = batch.column("_s").to_numpy(zero_copy_only=False)  # not a number where there is none
                        bound = np.where(np.isnan(s), np.inf, np.maximum((q * q).sum(axis=1) + top - 2.0 * s, 0.0))
                        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bound)], names=["h1", "h2", "q", "p", "bound"])

            asks = cut(asks.join(full, ["h1", "h2"], "left").select("h1", "h2", "q", "p", "_s").mapInArrow(closer, state))
    if counts is not None:
        counts |= {"leaves": len(box_leaf), "queries": asks.count(), "vectors": int(boxes["n"].sum())}

    hits = best.groupBy("h1", "h2").agg(F.collect_list(F.struct("score", "own", "ids")).alias("hits"))
    # a vector that many queries share is spread by salts; each salt gets its hits once
    asked = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
    there = asked.select("h1", "h2", "salt").distinct().join(hits, ["h1", "h2"])
    pairs = asked.join(there, ["h1", "h2", "salt"]).select("query_id", "h1", F.explode("hits").alias("h"))
    pairs = pairs.select("query_id", "h1", "h.score", "h.own", F.explode("h.ids").alias("vec_id")).where("vec_id <> query_id OR own <> h1")
    rank = Window.partitionBy("query_id", "h1").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
