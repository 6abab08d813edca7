"""A corpus pipeline: quality rules, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last keep the columns of documents, and further columns whatever their names. What each does with odd rows:

    quality_rules    null and empty texts have no words and go; a null doc_id is judged like any; repeated rows stay repeated
    near_dedup       equal texts are near duplicates, null and empty ones of each other; the smallest doc_id stays, null last;
                     of rows equal in id and text one stays, chosen by all columns, so each run chooses the same
    substring_dedup  rows of a null or the same doc_id take nothing from each other
    source_mix       the null source is one of its own; rows that share id and text are taken each by itself; texts without
                     words go
    encode           any text, null as empty

Very long texts are whole in every stage. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import bpe, mixing, quality, similar, substrings
from cloakwork.llm.common import cut, drop


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, quality.trusted_ids(labels)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return similar.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the passages that an earlier one has; the text of one that loses nothing stays as it is."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = substrings.dedup(docs, carry=("text", *rest))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carry_text"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cleaned.select(*[new.get(c, F.col(f"carry_{c}")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, and parts of documents."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each text of the mix."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: The stages hash, train and encode: SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: DataFrame | None = None
    for name, stage in STAGES[:-1]:
        before, done = done, cut(stage(spark, docs if done is None else done, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
    return STAGES[-1][1](spark, done, sf_dir)
