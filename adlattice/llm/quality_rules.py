"""Line-first quality rules, with DataFrame functions only.

Each line is judged by rules on punctuation, navigation and boilerplate; lines that
fail go, and a document goes if it is too short, repeats itself, or loses too much of
its text. Everything is computed within the row, so no shuffle is needed whatever the
skew of sources or copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_LOST = 50  # per cent of the words' characters

#: Fixed phrases of menus and footers, in English, German, French and Spanish, without regard
#: to case, letters with accents included.
NAVIGATION = (
    r"(?iu)^(skip to (main )?content|read more|click here|share this|next page|previous page|back to top|sign in|log in|sign up|main menu"
    r"|zum inhalt( springen)?|mehr lesen|weiterlesen|hier klicken|nächste seite|vorherige seite|nach oben|anmelden|registrieren|hauptmenü"
    r"|aller au contenu|lire la suite|cliquez ici|page suivante|page précédente|haut de page|se connecter|s'inscrire|menu principal"
    r"|ir al contenido|leer más|haga clic aquí|página siguiente|página anterior|volver arriba|iniciar sesión|registrarse|menú principal)(?:[^\p{L}\p{N}_]|$)"
)
BOILERPLATE = (
    r"(?iu)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|powered by|enable javascript|subscribe to our|this site uses cookies"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|diese website verwendet cookies|newsletter abonnieren"
    r"|tous droits réservés|politique de confidentialité|conditions d'utilisation|ce site utilise des cookies|abonnez-vous à"
    r"|todos los derechos reservados|política de privacidad|condiciones de uso|este sitio utiliza cookies|suscríbase a)"
)
#: A line of some length holds one of these.
SENTENCE_END = r"[.!?:;…。！？]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _count(text: Column, others: str) -> Column:
    """Characters of text that are left without the class `others`."""
    return F.length(F.regexp_replace(text, others, ""))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of WINDOW words, by its start."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def sorted_windows(hashes: Column) -> Column:
    """(hash, start) in order, or nothing where no hash occurs twice."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(none)


def covered_words(windows: Column) -> Column:
    """Number of words in the windows whose hash stands beside an equal one."""

    def twice(x: Column, k: Column) -> Column:
        near = lambda at: F.coalesce(F.get(windows, at)["h"] == x["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    places = F.array_sort(F.transform(F.filter(windows, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule."""
    words = F.size(_words(line))
    bare = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    symbols = _count(line, r"[^#*$%&|<>]+")
    capitals, smalls = _count(line, r"[^A-Z]+"), _count(line, r"[^a-z]+")
    marks = _count(line, r"[^!?]+")
    return (
        ((symbols >= 3) & (symbols * 3 >= words))  # decorated or piped text
        | ((capitals >= 20) & (capitals >= smalls * 3))  # shouting
        | ((marks >= 6) & (marks * 2 >= words))
        | ((words >= 8) & ~line.rlike(SENTENCE_END))
        | ((words <= 12) & (bare.rlike(NAVIGATION) | line.rlike(BOILERPLATE)))
    )


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "kept", "clean_text")


def _verdicts(docs: DataFrame, fields: tuple[str, ...] = ADDED) -> DataFrame:
    """(row, verdict): docs' rows as structs, beside structs of ADDED columns."""
    out = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = out.select("row", "text", _words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    out = out.withColumn("n_symbols", _count(F.col("text"), r"[^#*$%&|<>]+").cast("long"))
    out = out.withColumn("full", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_dup_lines", (F.size("full") - F.size(F.array_distinct("full"))).cast("long"))
    out = out.withColumn("hashes", window_hashes(F.col("words")))
    out = out.withColumn("windows", sorted_windows(F.col("hashes")))
    out = out.withColumn("n_repeat_words", covered_words(F.col("windows")))
    out = out.withColumn("good", F.filter("lines", lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x))))
    out = out.withColumn("clean_text", F.array_join("good", "\n"))
    out = out.withColumn("left", _count(F.col("clean_text"), SPACE + "+").cast("long"))
    out = out.withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    )
    lost = (F.col("word_chars") - F.col("left")) * 100 > F.col("word_chars") * MOST_LOST
    out = out.withColumn("n_removed_lines", (F.size("lines") - F.size("good")).cast("long"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~lost)
    return out.select("row", F.struct(*fields).alias("verdict"))


def judge(docs: DataFrame) -> DataFrame:
    """docs with the measures, `base_failed`, `kept`, `n_removed_lines` and `clean_text`.

    Null and empty texts have no words, so they fail; whole texts are read, of any length.
    Lines without words stay as they are. Other columns pass unchanged; a column of docs that has the name of an added
    one is replaced, no other name can clash. Repeated rows are judged each for itself; an
    empty table stays so.
    """
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return _verdicts(docs).select(*rest, *(F.col("verdict")[c].alias(c) for c in ADDED))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failed lines; docs' columns, whatever
    their names. n_chars, if there, follows the text."""
    # a generator keeps what passes: a filter would be pushed below the projections and
    # compute all of them again
    out = _verdicts(docs, ("kept", "clean_text")).select("row", F.explode(F.filter(F.array("verdict"), lambda v: v["kept"])).alias("verdict"))
    text = F.col("verdict.clean_text")

    def column(name: str) -> Column:
        if name == "text":
            return text.alias("text")
        if name == "n_chars":
            return F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("row")[name].alias(name)

    return out.select(*(column(c) for c in docs.columns))


_SPACE = r"[\x20\x09-\x0D]"


def _sql(pattern: str) -> str:
    """A pattern as DuckDB reads it: there, case is folded for all letters anyway."""
    return pattern.replace("'", "''").replace("(?iu)", "(?i)")


#: DuckDB's form of `judge`, for the contract's columns.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT r, i, n, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER z" for k in range(1, WINDOW))}) AS gram
  FROM u WINDOW z AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE i + {WINDOW - 1} <= n),
p AS (SELECT r, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8) AS gap FROM h WHERE n > 1),
rep AS (SELECT r, sum(least(gap, 8))::BIGINT AS n FROM p GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
l1 AS (SELECT r, l, len(list_filter(regexp_split_to_array(l, '{_SPACE}+'), lambda x: x <> '')) AS n,
  regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS b,
  length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) AS sy, length(regexp_replace(l, '[^A-Z]+', '', 'g')) AS up,
  length(regexp_replace(l, '[^a-z]+', '', 'g')) AS lo, length(regexp_replace(l, '[^!?]+', '', 'g')) AS mk FROM l0),
l2 AS (SELECT r, l, n, n > 0 AND ((sy >= 3 AND sy * 3 >= n) OR (up >= 20 AND up >= lo * 3) OR (mk >= 6 AND mk * 2 >= n)
  OR (n >= 8 AND NOT regexp_matches(l, '[.!?:;\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]'))
  OR (n <= 12 AND (regexp_matches(b, '{_sql(NAVIGATION)}') OR regexp_matches(l, '{_sql(BOILERPLATE)}')))) AS bad FROM l1),
l3 AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup,
  coalesce(sum(length(regexp_replace(l, '{_SPACE}+', '', 'g'))) FILTER (NOT bad), 0) AS lft FROM l2 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, lft FROM w JOIN l3 USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
  AND NOT (100 * (word_chars - lft) > {MOST_LOST} * word_chars) AS kept
FROM m
"""
