"""Export frames and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import extension


def metadata_keys(records: DataFrame, order: list[str]) -> DataFrame:
    """(key, pos): the union of metadata keys by first occurrence, records in the given order of columns."""
    place = F.struct(*[F.col(c) for c in order])
    seen = records.select(place.alias("at"), F.posexplode(F.map_keys("metadata")).alias("n", "key"))
    return seen.groupBy("key").agg(F.min(F.struct("at", "n")).alias("pos"))


def flat_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """id, type, content and one column per metadata key; missing values are empty."""
    made = [F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(f"metadata.{k}") for k in keys]
    return records.select("id", "type", "content", *made)


def key_columns(records: DataFrame, order: list[str]) -> list[str]:
    """The metadata keys in the order of their first occurrence: the columns of the flat export, read by the driver."""
    return [r["key"] for r in metadata_keys(records, order).orderBy("pos").collect()]


def ranked_keys(records: DataFrame, order: list[str]) -> DataFrame:
    """(place, key): the metadata keys, numbered in the order of their first occurrence."""
    return numbered(metadata_keys(records, order), ["pos"], "place").select(F.col("place").cast("int").alias("place"), "key")


def csv_lines(records: DataFrame, keys: list[str]) -> DataFrame:
    """(value): the lines of the flat export, all fields quoted, each partition's first one the header.

    Lines are made row by row from the metadata map, so that there may be any number of keys; as columns of a frame, tens of
    thousands would not fit a plan.
    """
    names = ["id", "type", "content", *[f"metadata.{k}" for k in keys]]
    at = {k: i for i, k in enumerate(keys, 3)}
    quoted = lambda x: '"' + (x or "").replace('"', '""') + '"'

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = [",".join(map(quoted, names))] if first and batch.num_rows else []
            first = first and not batch.num_rows
            for row in batch.to_pylist():
                fields = [quoted(row["id"]), quoted(row["type"]), quoted(row["content"]), *['""'] * len(keys)]
                for k, v in row["metadata"] or ():
                    if k in at:
                        fields[at[k]] = quoted(v)
                out.append(",".join(fields))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return records.select("id", "type", "content", "metadata").mapInArrow(lines, "value string")


def write_csv(records: DataFrame, path: str, order: list[str]) -> None:
    """Flat CSV, all fields quoted."""
    csv_lines(records, key_columns(records, order)).write.mode("overwrite").text(path)


def typed_metadata(records: DataFrame, own: Column) -> DataFrame:
    """records with `variant`: the item's own JSON text as a VARIANT, whose values keep their types; null where it is no JSON."""
    return records.withColumn("variant", F.try_parse_json(own))


def metadata_schema(records: DataFrame) -> DataFrame:
    """(schema): one row, the schema that the VARIANTs of all records have together."""
    return records.agg(F.schema_of_variant_agg("variant").alias("schema"))


def write_json(records: DataFrame, path: str) -> None:
    records.select("id", "type", "content", "tags", "entities", "category", "metadata").write.mode("overwrite").json(path)


def write_records(records: DataFrame, path: str, fmt: str, order: list[str], selected: bool = False) -> str:
    """CSV for csv, JSON for anything else; `_selected` marks exports of chosen ids. Gives the path written."""
    target = f"{path}_selected" if selected else path
    if fmt == "csv":
        write_csv(records, target, order)
    else:
        write_json(records, target)
    return target


def numbered(records: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """records with their place from 0 in the order given, without bringing all rows to one task.

    Rows are dealt by range, sorted and numbered inside their partition as they are settled; the counts, a row per partition,
    give each partition's start. So the rows are shuffled once.
    """
    from pyspark.sql.window import Window

    from gleanery.operators.lineage import settle

    # The upper bits are the partition's number, the lower 33 the row's place in it.
    dealt = settle(records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def document_files(records: DataFrame, order: list[str]) -> DataFrame:
    """(path, content): one text file per record."""
    return numbered(records, order).select(F.format_string("documents/doc_%04d.txt", "n").alias("path"), F.coalesce(F.nullif("content", F.lit("")), F.lit("No content.")).alias("content"))


def media_manifest(records: DataFrame, order: list[str], modality: str) -> DataFrame:
    """(path, url): the files of a media export; records without an address leave a gap in the numbers.

    Modalities: image_cnn, audio, spectrogram (pictures of the audio), file_image and file_audio (the generic export). The
    address is the record's own column if it has one, else the metadata's.
    """
    key = "image_url" if modality in ("image_cnn", "file_image") else "audio_url"
    own = [F.nullif(F.col(key), F.lit(""))] if key in records.columns else []
    placed = numbered(records, order).withColumn("url", F.coalesce(*own, F.nullif(F.try_element_at("metadata", F.lit(key)), F.lit("")))).where("url is not null")
    # Folders, names and the extensions that a conversion settles.
    folder = {"image_cnn": "images/image", "audio": "audio/audio", "spectrogram": "spectrograms/audio", "file_image": "images/file", "file_audio": "audio/file"}[modality]
    kinds = {"image_cnn": extension(F.col("url"), "generic_image"), "audio": extension(F.col("url"), "download"), "spectrogram": F.lit("png"), "file_image": F.lit("jpg"), "file_audio": extension(F.col("url"), "generic_audio")}
    return placed.select(F.concat(F.format_string(f"{folder}_%04d.", "n"), kinds[modality]).alias("path"), "url")


def write_annotated(records: DataFrame, items: DataFrame, path: str, fmt: str, order: list[str]) -> None:
    """An export's items (path and content or address) with the records' annotations beside them, as CSV for csv, else JSON."""
    items.write.mode("overwrite").json(f"{path}/items")
    write_records(records, f"{path}/annotations", fmt, order)
