"""The unified record and its selections, summaries and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TYPES = {"image_cnn": "image", "audio": "audio", "graph_gnn": "graph", "network": "network"}
PREVIEW = 50


def type_name(modality: str) -> str:
    return TYPES.get(modality, "text")


def record_id(kind: Column, url: Column, idx: Column, content: Column) -> Column:
    """A stable id: type and the start of a hash of the item's place and content."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(F.concat_ws("\u0001", url, idx.cast("string"), content).cast("binary"), 256), 1, 16))


def merge_metadata(base: Column, item: Column) -> Column:
    """base with the item's keys over it, without caption and transcript."""
    own = F.map_filter(item, lambda k, _: ~k.isin("caption", "transcript"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def build_records(items: DataFrame, modality: str, run_ts: str, content: Column, extra: Column | None = None) -> DataFrame:
    """Records of items (source_url, item_idx, score and optionally tags, entities, category); `extra` is the item's own map."""
    kind, empty = F.lit(type_name(modality)), F.array().cast("array<string>")
    of = lambda name, other: F.coalesce(F.col(name), other) if name in items.columns else other
    base = F.create_map(F.lit("source_url"), F.col("source_url"), F.lit("timestamp"), F.lit(run_ts), F.lit("relevance_score"), F.col("score").cast("string"))
    return items.select(
        record_id(kind, F.col("source_url"), F.col("item_idx"), content).alias("id"), kind.alias("type"), content.alias("content"), of("tags", empty).alias("tags"), of("entities", empty).alias("entities"),
        of("category", F.lit("general")).alias("category"), (merge_metadata(base, extra) if extra is not None else base).alias("metadata"), "source_url", "item_idx", "score",
    )


def content_of(modality: str) -> Column:
    """What a record of a modality holds as its content, from the item's columns."""
    if modality == "graph_gnn":
        return edge_content(F.col("source_node"), F.col("target_node"))
    return F.lit("") if modality == "network" else F.col({"image_cnn": "caption", "audio": "transcript"}.get(modality, "text"))


def passed_through(items: DataFrame) -> DataFrame:
    """Structured items as they are, with the full score."""
    return items.withColumn("score", F.lit(1.0))


def edge_content(source: Column, target: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("")), F.lit(" -> "), F.coalesce(target, F.lit("")))


def select_ids(records: DataFrame, ids: DataFrame | str | None) -> DataFrame:
    """The records with the listed ids: a table with `id`, or text with commas; none or empty keeps all."""
    if ids is None or isinstance(ids, str) and not ids.strip(","):
        return records
    if isinstance(ids, str):
        return records.where(F.array_contains(F.split(F.lit(ids), ","), F.col("id")))
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def toggled(chosen: DataFrame, changed: DataFrame) -> DataFrame:
    """Symmetric difference of two id tables."""
    return chosen.exceptAll(changed).unionByName(changed.exceptAll(chosen))


def edited(chosen: DataFrame, every: DataFrame, how: str) -> DataFrame:
    """The chosen ids after a choice of all or none of the ids shown."""
    if how not in ("all", "none"):
        raise ValueError("how must be all or none")
    return chosen.unionByName(every).distinct() if how == "all" else chosen.exceptAll(every)


def preview(records: DataFrame, most: int = PREVIEW) -> DataFrame:
    """The best records as rows for display."""
    host = F.try_parse_url(F.element_at("metadata", "source_url"), F.lit("HOST"))
    top = records.orderBy(F.desc("score"), "source_url", "item_idx").limit(most)
    percent = F.when(F.coalesce("score", F.lit(0.0)) == 0, F.lit("100")).otherwise(F.round(F.col("score") * 100, 0).cast("int").cast("string"))
    return top.select("id", F.coalesce(F.nullif("content", F.lit("")), F.substring(F.to_json(F.struct("id", "type", "content", "tags", "entities", "category", "metadata")), 1, 100)).alias("content"), F.coalesce(host, F.nullif("source_url", F.lit("")), F.lit("Unknown")).alias("source"), percent.alias("percent"))


def run_summary(sources: DataFrame, records: DataFrame, topic: str, modality: str) -> DataFrame:
    """One row: sources chosen, records, and the first record's time."""
    chosen = sources.where(F.coalesce("selected", F.lit(True))).agg(F.count("*").alias("sources_used"))
    made = records.agg(F.count("*").alias("total_records"), F.min(F.element_at("metadata", "timestamp")).alias("created_at"))
    return chosen.crossJoin(made).select(F.lit(topic).alias("topic"), F.lit(modality).alias("modality"), "sources_used", "total_records", "created_at")  # one row by one row


def stage_funnel(rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(stage, rows_in, rows_out) of steps applied to rows one after the other.

    Rows are counted as they pass, so that the chain runs once; the counts, a row for each stage, come back to the driver.
    """
    seen = []

    def watched(df: DataFrame) -> DataFrame:
        seen.append(Observation(f"funnel-{uuid.uuid4().hex}"))
        return df.observe(seen[-1], F.count(F.lit(1)).alias("rows"))

    df = watched(rows)
    for _, step in steps:
        df = watched(step(df))
    df.write.format("noop").mode("overwrite").save()
    n = [o.get.get("rows", 0) for o in seen]
    return rows.sparkSession.createDataFrame([(name, n[i], n[i + 1]) for i, (name, _) in enumerate(steps)], "stage string, rows_in long, rows_out long")


def message_kind(message: Column) -> Column:
    """error, warn or info."""
    low = F.lower(message)
    return F.when(low.contains("failed") | low.contains("error"), "error").when(low.contains("retry") | low.contains("blocked"), "warn").otherwise("info")


def status_digest(log: DataFrame, newest: int = 30) -> DataFrame:
    """Per job the newest messages that differ from the one before, classed error, warn or info; log has (job, ts, seq, message)."""
    in_time = Window.partitionBy("job").orderBy("ts", "seq")
    changed = log.withColumn("_last", F.lag("message").over(in_time)).where("_last is null or message <> _last")
    ranked = changed.withColumn("_rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("seq"))))
    kept = ranked.where(F.col("_rank") <= newest).withColumn("kind", message_kind(F.col("message")))
    return kept.withColumn("errors", F.count_if(F.col("kind") == "error").over(Window.partitionBy("job"))).select("job", "ts", "seq", "message", "kind", "errors")


def progress(done: Column, total: Column) -> Column:
    """Shown percentage of the scraping stage, which runs from 30 to 60."""
    share = F.when(total > 0, F.floor(done / total * 100)).otherwise(F.lit(0))
    return (F.lit(30) + F.floor(share * F.lit(0.3))).cast("int")


def selection_counts(sources: DataFrame, seconds: float = 1.5) -> DataFrame:
    chosen = F.count_if(F.coalesce("selected", F.lit(True)))
    return sources.agg(chosen.alias("selected"), F.count("*").alias("available"), (chosen * seconds).alias("estimate_s"))
