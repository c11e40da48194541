"""Caption enrichment: relevance, entities, tags, category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stopwords import ENGLISH
from gleanery.operators.tfidf import cosine_to_topic

# Keywords of the categories in order, and the words that are no tags.
CATEGORIES = {
    "footwear": ("shoe", "sneaker", "boot", "footwear", "trainers", "heels"),
    "apparel": ("shirt", "jacket", "pants", "clothing", "apparel"),
    "nature": ("landscape", "mountain", "river", "forest", "tree", "ocean", "nature", "climate"),
    "technology": ("computer", "phone", "electronics", "circuit", "robot", "ai", "tech"),
    "person": ("man", "woman", "person", "crowd", "people", "child", "portrait"),
    "vehicle": ("car", "truck", "bike", "vehicle", "plane", "boat"),
}
NO_TAGS = ("the", "a", "an", "and", "or", "but", "is", "on", "in", "to", "for", "with", "of", "at", "by", "from", "as", "stock", "photo", "image", "picture", "royalty-free", "premium", "high-res")
# What counts as an entity and as a tag. The letter is looked for before the word's bound, which is slow to test.
ENTITY = r"(?U)(?=[A-Z])\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b"
TAG = r"(?U)(?=[a-zA-Z_-])\b[a-zA-Z_-]+\b"


def entities(text: Column, longer_than: int = 3, stop: tuple[str, ...] = NO_TAGS) -> Column:
    """Distinct runs of capitalised words, in order of their first occurrence."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.filter(found, lambda e: (F.length(e) > longer_than) & (~F.lower(e).isin(*stop) if stop else F.lit(True)))


def tags(text: Column, most: int = 5) -> Column:
    """The first distinct lower-case words that say something."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TAG), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*NO_TAGS))), 1, most)


def category(found: Column, categories: Mapping[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """The first category with a keyword among the tags."""
    return F.coalesce(*[F.when(F.arrays_overlap(found, F.array([F.lit(k) for k in keys])), F.lit(name)) for name, keys in categories.items()], F.lit("general"))


def enrich_captions(items: DataFrame, topic: str, categories: Mapping[str, tuple[str, ...]] = CATEGORIES, stop: tuple[str, ...] = ENGLISH) -> DataFrame:
    """Image items with tags, entities, category and a score that is at least 0.4 where a topic word occurs."""
    scored = cosine_to_topic(items.where("caption <> ''"), topic, "caption", max_features=5_000, bigrams=False, sublinear=False, stop=stop, when_empty=1.0)
    hit = F.lit(False)
    for word in topic.lower().split():
        if len(word) > 3:
            hit = hit | F.lower("caption").contains(word)
    score = F.when(hit, F.greatest("cosine", F.lit(0.4))).otherwise(F.col("cosine"))
    named = scored.withColumns({"tags": tags(F.col("caption")), "entities": entities(F.col("caption")), "score": F.round(score, 4)}).drop("cosine")
    return named.withColumn("category", category(F.col("tags"), categories))


def preprocess_manifest(configs: DataFrame) -> DataFrame:
    """Configurations (target_size, quality, output_format, grayscale, edge_enhance, equalize) with `format` and `steps`."""
    # The wording of the steps.
    size = F.concat_ws("x", F.transform("target_size", lambda x: x.cast("string")))
    steps = F.array(
        F.concat(F.lit("Resize to "), size, F.lit(" (Lanczos)")), F.lit("RGB channel normalization"), F.when(F.col("equalize"), "Histogram equalization"), F.when(F.col("edge_enhance"), "Edge enhancement"),
        F.when(F.col("grayscale"), "Grayscale conversion (3-ch)"), F.concat(F.lit("Export as "), F.upper("output_format"), F.lit(" (quality="), F.col("quality").cast("string"), F.lit(")")),
    )
    return configs.withColumns({"format": F.upper("output_format"), "steps": F.filter(steps, lambda s: s.isNotNull())})
