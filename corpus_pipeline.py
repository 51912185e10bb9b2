"""From raw documents to token ids of a weighted, deduplicated mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents. Stages hand on what they keep: rejected documents and lines
are gone, one document of each near-duplicate class stays, and documents come as often
as the mix takes them, in training order.

Every stage gives no rows for an empty table, passes columns beside text and n_chars
unharmed whatever their names, and reads whole texts of any length. Null and empty texts
have no words, so the first stage rejects them; later stages take them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlattice.llm import line_dedup, mixing, near_dedup, quality_rules, sentencepiece
from adlattice.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines. Repeated rows are judged
    each; null ids and sources don't matter."""
    return quality_rules.clean(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; such a line stays in the largest
    doc_id that holds it, where null is smallest. Repeated rows count each and lose lines
    alike; a null text becomes empty."""
    return line_dedup.documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest doc_id, where null is smallest; of
    rows that repeat it one, the same in each run. Documents without words stay each."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each pass, by training position. A null source is one
    of its own; documents without words are in no pass; repeated rows take a plan each."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, in place of text; a null text has none. Repeated rows are encoded
    each. An input column named ids is replaced."""
    return sentencepiece.encode(docs, [c for c in docs.columns if c != "text"], sentencepiece.load())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Sketches, alignment and token ids have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
