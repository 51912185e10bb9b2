"""Source divergence audit with a frequent-pattern tree of term rows.

A term's row lists the sources of a language that use it, in source order, with what
each makes of it. Equal rows are one row with a multiplicity. Sorted rows are inserted
into a tree, so that rows with the same beginning share a path; a node's multiplicity is
the number of terms below it. The sum over all terms of the differences of two sources
starts from terms that neither uses, is corrected by the counts of each source alone,
and then once for each node and ancestor, times the node's multiplicity, by what both
together change. So terms that many sources share alike are never compared one by one.

Rows are range-sorted over tasks; each task builds the tree of its range and keeps only
the path that is open. A path on the border of two ranges is a node in both, each with
its own multiplicity, which sum up to the same corrections.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows, word_lists

LEAST_DOCS = 30  # of a language, for a term that is kept
TOP = 50  # terms reported of a group
PRIOR, SCALE = 5, 1_000_000_000
RANGES = 256  # of sorted rows at most: a sample of their rows, a hundred or so for each, reaches the driver
HELD = 400_000  # entries that a task counts, or pair sums that it holds, before it hands them on

#: Letters stay, A-Z in lower case; anything else of ASCII separates terms.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, in UTF-8, in each group."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def all_of() -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("lang", "source", "term", "n", "docs")}
            for (lang, source), (n, met) in held.items():
                out["lang"] += [lang] * len(n)
                out["source"] += [source] * len(n)
                out["term"] += n.keys()
                out["n"] += n.values()
                out["docs"] += [met[t] for t in n]
            return out

        for part in parts:
            for lang, source, text in zip(part["lang"], part["source"], part["text"], strict=True):
                n, met = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in word_lists(text, _TABLE):
                    n.update(terms)
                    own.update(terms)
                met.update(own)
                size += len(n) - before
                if size > HELD:
                    yield all_of()
                    held.clear()
                    size = 0
        yield all_of()

    rows = docs.select(_plain("lang"), _plain("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = map_rows(rows, run, "lang string, source string, term binary, n long, docs long")
    # tasks have counted already; rows are dealt by term once, for this sum and the one over sources
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exactly."""
    return F.expr(f"1L + ((cast({count} as decimal(20)) + {PRIOR}) * {SCALE}) div (total + {PRIOR} * v)")


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value), for sources a before b: what their joint use of terms changes.

    rows: lang, path, an array of (source, p, zero) in source order, and m, its multiplicity.
    """

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        path: list[tuple[str, int, int]] = []  # the open nodes, from the root
        terms: list[int] = []  # their multiplicities
        sums: dict[tuple[str, str, str], int] = {}
        lang = None

        def close(depth: int) -> None:
            while len(path) > depth:
                source, p, zero = path.pop()
                m = terms.pop()
                for other, q, none in path:
                    change = abs(p - q) - abs(p - none) - abs(zero - q) + abs(zero - none)
                    if change:
                        key = (lang, other, source)
                        sums[key] = sums.get(key, 0) + m * change

        def all_of() -> dict[str, list]:
            a, b, c = zip(*sums, strict=True) if sums else ((), (), ())
            return {"lang": list(a), "a": list(b), "b": list(c), "value": list(sums.values())}

        for part in parts:
            for new, sources, ps, zeros, m in zip(*(part[c] for c in ("lang", "source", "p", "zero", "m")), strict=True):
                row = list(zip(sources, ps, zeros, strict=True))
                same = 0
                if new == lang:
                    while same < len(path) and same < len(row) and path[same] == row[same]:
                        same += 1
                close(same)
                lang = new
                for i in range(same):
                    terms[i] += m
                path += row[same:]
                terms += [m] * (len(row) - same)
                if len(sums) > HELD:
                    yield all_of()
                    sums.clear()
        close(0)
        yield all_of()

    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= RANGES
    ranges = rows.repartitionByRange("lang", "path") if few else rows.repartitionByRange(RANGES, "lang", "path")
    flat = ranges.sortWithinPartitions("lang", "path").select("lang", "path.source", "path.p", "path.zero", "m")
    return map_rows(flat, run, "lang string, a string, b string, value long")


def alone(uses: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with `apart`, the sum over the terms that the source uses of |p - other_zero|.

    Both are sorted by value within the source; running sums give the terms below and
    above, so no source's terms meet every other source.
    """
    counts = uses.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    steps = counts.select("lang", "source", F.col("p").alias("at"), "m", (F.col("m") * F.col("p")).alias("w"), F.lit(None).cast("struct<other:string,v:bigint,zero:bigint,other_zero:bigint>").alias("pair"))
    asked = pairs.select("lang", "source", F.col("other_zero").alias("at"), F.lit(0).alias("m"), F.lit(0).alias("w"), F.struct("other", "v", "zero", "other_zero").alias("pair"))
    every = Window.partitionBy("lang", "source")
    below = every.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rows = steps.unionByName(asked).select(
        "lang", "source", "at", "pair", F.sum("m").over(every).alias("terms"), F.sum("w").over(every).alias("whole"),
        F.sum("m").over(below).alias("low"), F.sum("w").over(below).alias("low_whole"),
    )
    apart = F.expr("whole - 2 * low_whole - at * (terms - 2 * low)")
    return rows.where("pair IS NOT NULL").select("lang", "source", "pair.*", "terms", apart.alias("apart"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart.

    Part `pair`: each other source of the language with the sum of |p - q| over the
    language's kept terms; part `term`: the `top` terms that the group uses most beyond its
    language. Null text, lang and source are ''. Groups without terms, and languages without
    kept terms, have pairs too (of value 0 in the latter). Repeated rows count each, as
    documents; an empty table gives no rows; texts of any length are read in pieces. Ties
    go by the item's UTF-8 order. Other columns than text, lang and source are not read. A
    term's row has a place for each source of its language, and pairs are quadratic in
    them, as the result is; documents don't make either longer.
    """
    counts = term_counts(docs).groupBy("lang", "term")
    kept = counts.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("row"))
    kept = cut(kept.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "n", "row"))
    flat = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("row"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_plain("lang"), _plain("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total"])
    groups = cut(groups.withColumn("zero", F.when(F.col("v") > 0, share("0")).otherwise(0)))

    known = bounded(groups.select("lang", "source", "total", "v", "lang_total", "zero"))
    uses = flat.join(known, ["lang", "source"]).withColumn("p", share("n"))
    beyond = uses.withColumn("total", F.col("lang_total")).withColumn("value", F.col("p") - share("lang_n"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = beyond.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    words = words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    paths = uses.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
    both = tree_corrections(cut(paths.groupBy("lang", "path").agg(F.count("*").alias("m"))))
    ends = groups.select("lang", "source", "v", "zero")
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    pairs = ends.join(others, "lang").where("source <> other")  # these are the rows of the result
    single = alone(uses.select("lang", "source", "p"), pairs)
    idle = F.abs(F.col("zero") - F.col("other_zero"))
    single = single.select("lang", "source", "other", (F.col("apart") - F.col("terms") * idle).alias("used"), (F.col("v") * idle).alias("base"))
    single = cut(single)
    sums = (
        single.select("lang", "source", "other", (F.col("base") + F.col("used")).alias("value"))
        .union(single.select("lang", "other", "source", "used"))
        .union(both.select("lang", F.explode(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))).alias("x")).select("lang", "x.a", "x.b", "x.value"))
    )
    apart = sums.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return apart.union(words)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
c AS (SELECT x.lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(t.total, 0) + {PRIOR} * l.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.n + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
  LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY ALL),
r AS (SELECT * FROM f UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
