"""The registered queries of this subpackage, each on its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, licenses, media, mixing, packing, quality, simhash, substrings, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document through the byte-level vocabulary."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of every document."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to packed files in doc_id order and read from them again."""
    files = packing.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), packing.token_folder(spark), end_id=1)
    return packing.read(files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows that an earlier one has."""
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a motion JPEG video, read back."""
    got = media.read(media.store(table(spark, sf_dir, "documents")), carry=("n_bytes",))
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_source_mix": op2_source_mix,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_media_columns": op10_media_columns,
}

ORACLE: dict[str, str] = {}
