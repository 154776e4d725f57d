"""Cleaning a corpus in four stages; every stage works on all its predecessor kept.

Rows of `documents` that are NULL or empty, repeat, or carry further columns pass through: the first
three stages return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import quality, toxicity
from wattloom.llm.common import read
from wattloom.llm.packing import pack
from wattloom.llm.simhash import simhash_groups
from wattloom.session import scratch_path


def _packed(docs: DataFrame) -> DataFrame:
    """(__row, text): the given row as one value, so that no column of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("text"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; it learns from the labelled rows."""
    scored = quality.score(_packed(docs), quality.fitted(spark, sf_dir))
    return _unpacked(scored.where(F.col("predicted") == 1), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic; its weights come from the labelled rows."""
    scored = toxicity.score(_packed(docs), toxicity.fitted(spark, sf_dir))
    return _unpacked(scored.where(F.col("predicted") == 0), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, two bits): the smallest doc_id.

    Rows that share a doc_id are one document; the one whose columns (but maps) have the smallest
    hash stays. Rows without a doc_id belong to no group and all stay.
    """
    groups = simhash_groups(docs.select("doc_id", "text"), shingle=3, max_bits=2)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    kept = docs.select(F.col("doc_id"), F.xxhash64(*plain).alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kept = kept.join(first, "doc_id", "left_semi")
    one = kept.groupBy("doc_id").agg(F.min_by("__row", "__hash").alias("__row"))
    return _unpacked(one, docs).unionByName(docs.where(F.col("doc_id").isNull()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences of at most 2048 tokens, one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
