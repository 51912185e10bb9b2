"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    divergence,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    nearest,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece,
    sharding,
    spelling,
)
from .common import table


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents under the law `rows`."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it and its training position."""
    return mixing.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position"
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding gives the text again."""
    ids = sentencepiece.encode(table(spark, sf_dir, "documents"), ["doc_id"], sentencepiece.load(), check=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all words."""
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of all documents and its place in a sequence."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_nearest, op3_sentencepiece, op4_sharding, op5_line_dedup, op6_quality_rules, op7_mixing,
        op8_pii, op9_quality_classifier, op10_near_dedup, op11_divergence, op12_spelling, op13_packing,
    )
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op11_divergence": divergence.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
