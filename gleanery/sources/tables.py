"""Scans: pages, search hits, text items and captions from tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls
from gleanery.operators.clean import first_of

# What each modality adds to a search.
SUFFIXES = {
    "text": "",
    "image_cnn": "high resolution images gallery photos",
    "audio": "audio clips sound wav mp3 download",
    "graph_gnn": "categories hierarchy taxonomy relationships",
    "network": "data statistics table csv numerical",
}
FORMATS = ("csv", "json", "zip")


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked for; bounds are checked when it is made."""

    topic: str
    format: str = "csv"
    num_sources: int = 20
    modality: str = "text"

    def __post_init__(self) -> None:
        if not 2 <= len(self.topic) <= 500:
            raise ValueError("topic must have 2 to 500 characters")
        if self.format not in FORMATS or self.modality not in SUFFIXES:
            raise ValueError("unknown format or modality")
        if not 10 <= self.num_sources <= 50:
            raise ValueError("num_sources must be 10 to 50")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_items(docs: DataFrame) -> DataFrame:
    """(source_url, item_idx, text): the lines of documents (doc_id, text)."""
    return docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"), F.posexplode(F.split("text", "\n")).alias("item_idx", "text"))


def whole_items(docs: DataFrame) -> DataFrame:
    """(source_url, item_idx, text): each document as one item."""
    return docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"), F.lit(0).alias("item_idx"), "text")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per address: the one with the largest page_id."""
    return first_of(pages, F.col("url"), F.struct(F.col("page_id").isNull(), -F.col("page_id")))


def selected(sources: DataFrame) -> DataFrame:
    """The sources that are chosen; a missing flag counts as chosen."""
    return sources.where(F.coalesce("selected", F.lit(True)))


def rank_sources(hits: DataFrame, most: int = 20, topic_col: str | None = None) -> DataFrame:
    """Sources of hits (position, title, href): redirects unwrapped, advertisements dropped, scored by rank among the kept.

    With a topic column every topic is ranked for itself; without, the first hits are taken before they are ranked.
    """
    url = urls.unwrap_redirect(F.col("href"))
    kept = hits.withColumn("url", url).where(urls.is_result(F.col("url"), F.col("title")))
    kept = kept if topic_col else kept.orderBy("position").limit(most)
    order = Window.partitionBy(topic_col).orderBy("position") if topic_col else Window.orderBy("position")  # at most `most` rows in the latter
    ranked = kept.withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") < most)
    score = F.greatest(F.round(F.lit(1.0) - F.lit(0.02) * F.col("_k"), 3), F.lit(0.1))
    names = [topic_col] if topic_col else []
    return ranked.select(*names, "title", "url", urls.domain_compatible(F.col("url")).alias("domain"), score.alias("relevance_score"), F.lit(True).alias("selected"))


def modality_query(topic: Column, modality: Column) -> Column:
    """The topic with the words that a modality adds to a search."""
    words = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.concat_ws(" ", topic, F.nullif(F.try_element_at(words, modality), F.lit("")))


def fetch_outcome(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count("*").alias("pages"))
