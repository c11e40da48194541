"""Cleaning of text items (source_url, item_idx, text) and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from gleanery.functions import text as T


def clean_paragraphs(items: DataFrame, native: bool = False) -> DataFrame:
    """Items with cleaned text, without short, navigation and symbol-laden ones."""
    return _once(items, "text", T.clean_text(F.col("text"), native)).where(T.is_paragraph(F.col("text")))


def clean_captions(items: DataFrame, native: bool = False) -> DataFrame:
    """Image items (…, caption) without stock-photo junk, cleaned."""
    kept = items.where((F.coalesce("caption", F.lit("")) != "") & ~T.is_junk_caption(F.col("caption")))
    tailed = F.contains(F.lower("caption"), F.lit("stock p")) | F.contains(F.lower("caption"), F.lit("royalty-free")) | F.contains(F.lower("caption"), F.lit("high-res"))
    whole = _once(kept, "caption", F.when(tailed, F.regexp_replace("caption", T.CAPTION_TAIL, "")).otherwise(F.col("caption")))  # clean_text strips both ends
    return _once(whole, "caption", T.clean_text(F.col("caption"), native)).where(F.length("caption") > 3)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column replaced by a value that is worked out once: Spark puts a plain column's expression in each place that
    reads it, conditions too, but leaves what it generates."""
    return rows.select(*[F.explode(F.array(value)).alias(c) if c == name else F.col(f"`{c}`") for c in rows.columns])


def exact_dedup(items: DataFrame) -> DataFrame:
    """The best-scored copy of each text: score, then source and place decide."""
    return first_of(items, T.content_hash(F.col("text")), F.struct(F.col("score").isNull(), -F.col("score"), "source_url", "item_idx"))


def first_of(rows: DataFrame, group: Column, order: Column) -> DataFrame:
    """The first row of each group. Copies meet on the map side first, so that a frequent group does not fill one task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(group.alias("group")).agg(F.min_by(whole, order).alias("row"))
    return best.select(*[F.col("row").getField(c).alias(c) for c in rows.columns])
