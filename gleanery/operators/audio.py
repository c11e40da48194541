"""Audio metadata: transcripts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.urls import extension
from gleanery.operators.tfidf import score_paragraphs

DEFAULT_SCORE = 0.5


def merge_transcripts(items: DataFrame) -> DataFrame:
    """Audio items with `transcript`: the context, and for speech the recognised text after it."""
    heard = (F.col("classification") == "speech") & (F.coalesce("stt_text", F.lit("")) != "")
    both = T.strip(F.concat_ws(" ", "context_transcript", "stt_text"))
    return items.where("audio_url is not null").withColumns({"transcript": F.when(heard, both).otherwise(F.col("context_transcript")), "ext": extension(F.col("audio_url"))})


def audio_scores(items: DataFrame, topic: str, default: float = DEFAULT_SCORE) -> DataFrame:
    """Audio items with `score`; items without a score get the default. Of a repeated address the lowest score counts."""
    asked = items.where(F.length(T.strip(F.coalesce("transcript", F.lit("")))) > 0).withColumn("text", F.col("transcript"))
    best = score_paragraphs(asked, topic).groupBy("audio_url").agg(F.min("score").alias("score"))
    met = items.where("audio_url is not null").join(best, "audio_url", "left")
    return met.withColumn("score", F.when(F.col("score") > 0, F.col("score")).otherwise(F.lit(default)))
