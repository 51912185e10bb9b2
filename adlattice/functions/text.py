"""Text column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.tables import LEGAL_WORDS

#: Fixed words, each frequent in one of the languages and rare in the others.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "with", "was", "for"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "pour", "que", "du"],
    "de": ["der", "die", "das", "und", "ist", "ein", "nicht", "von", "mit", "den"],
    "es": ["el", "los", "las", "y", "que", "una", "por", "con", "del", "para"],
}


def arabic(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0600-\\u06FF]"), F.lit(False))


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def valid_cta(text: Column) -> Column:
    """Not empty and no legal boilerplate."""
    return (F.trim(text) != "") & ~reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in LEGAL_WORDS))


def language(text: Column) -> Column:
    """Arabic script first, else the language with most of its stop words; ties and
    none go to the first in order, which is English. Words are first met with all stop words
    by a hash set; only those that stay are looked up, for a number with a bit for each
    language that has it."""
    bits: dict[str, int] = {}
    for i, stop in enumerate(STOP_WORDS.values()):
        for w in stop:
            bits[w] = bits.get(w, 0) | 1 << i
    known = F.create_map(*(x for w, n in bits.items() for x in (F.lit(w), F.lit(n))))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*bits))
    found = F.transform(words, lambda w: F.try_element_at(known, w))
    top = F.array_max(F.transform(F.array(*(F.lit(i) for i in range(len(STOP_WORDS)))), lambda i: F.struct(F.size(F.filter(found, lambda n: F.getbit(n, i) == 1)).alias("n"), (-i).alias("o"))))
    name = F.element_at(F.array(*map(F.lit, STOP_WORDS)), 1 - top["o"])
    return F.when(arabic(text), F.lit("ar")).otherwise(F.coalesce(name, F.lit(next(iter(STOP_WORDS)))))
