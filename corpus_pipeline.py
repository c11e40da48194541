"""A training-corpus pipeline: quality rules, near duplicates, personal data, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's result as
Parquet in the shared folder and rereads it for the next.

Defined cases, for every stage: a null text counts as empty, and an empty text has no words; the quality rules reject texts
of fewer than 50 words, so null and empty texts end there, but each later stage takes them too (no link, no personal data,
never taken by the mix, no pieces). Repeated rows are rows of their own until the near-duplicate stage keeps one of each
class: of ties the smallest id, null last, then the smallest hash of id and text. Ids may be null or shared. Very long texts
are read whole. An empty table gives an empty result. Columns beyond those of documents are kept up to the last stage,
whatever their names, but for maps, by which rows cannot be told apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import jaccard, mixing, pieces, pii, quality_rules
from gleanery.llm.common import WORD, shared_folder, table, unused

#: Words of a block in the mix.
BLOCK = 512


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest id (null last). Rows without a word all stay.

    Rows are told by a 64-bit hash of id and text. Rows equal in both share it and are always in one group, of which one
    row stays; they are put together on the map side first, so that many copies do not meet in one task.
    """
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    key = unused(docs, "_key")
    keyed = docs.where(worded).withColumn(key, F.xxhash64("doc_id", "text"))
    classes = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "key")
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").alias("id")).distinct()
    first = ids.join(classes, "key").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("m")).select(F.col("m.key").alias("key"))
    rows = keyed.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    kept = rows.join(first, "key", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(~worded))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the spans of personal data replaced by their kinds."""
    text = docs.withColumn("text", pii.redacted("text"))
    return text.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix of sources takes, as often as it takes them."""
    return mixing.mixed_pieces(docs, BLOCK)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text as ids, the N best and their scores, and the check of their round trips."""
    found = docs.select("doc_id", "source", pieces.encoded("text", pieces.load_vocabulary()).alias("e"))
    return found.select("doc_id", "source", F.get("e.ranked", F.lit(0)).alias("ids"), F.col("e.scores").alias("scores"), F.col("e.ranked").alias("ranked"), F.col("e.whole").alias("round_trip"))


STAGES = [
    ("quality_rules", reject_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot state the later stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
