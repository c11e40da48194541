"""A data source that writes one file for each row (path, content), whole exports or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gleanery.operators.lineage import settle
from gleanery.sources import sinks

STAGED = "_temporary"
#: What opening a file costs, in bytes read meanwhile: Spark's own 4 MB would give a task to every 31 small files.
OPEN_COST = "65536"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: where its list of names lies, the number of files and of bytes."""

    names: str
    files: int
    size: int


class FileWriter(DataSourceArrowWriter):
    """Each task writes below a folder of its own attempt, then moves its files into place and lists them.

    A task that fails takes its files back. When the job fails, the files of the tasks that did not are removed by their
    lists, and so is all that lost attempts left. `_SUCCESS` marks a whole export and holds the counts.
    """

    def __init__(self, target: str, overwrite: bool) -> None:
        self.target, self.overwrite, self.job = target, overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        where, root = fs.FileSystem.from_uri(self.target)
        return where, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = self._at()
        staged = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        names, moved, made, size = [], [], set(), 0

        def folder_of(path: str) -> None:
            if (parent := path.rpartition("/")[0]) not in made:
                where.create_dir(parent, recursive=True)
                made.add(parent)

        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    if not path or path.startswith("/") or ".." in path.split("/") or path.split("/")[0] in (STAGED, "_SUCCESS"):
                        raise ValueError(f"not a path inside the export: {path!r}")
                    data = (content or "").encode()
                    folder_of(f"{staged}/{path}")
                    with where.open_output_stream(f"{staged}/{path}") as out:
                        out.write(data)
                    names.append(path)
                    size += len(data)
            for path in names:
                folder_of(f"{root}/{path}")
                where.move(f"{staged}/{path}", f"{root}/{path}")
                moved.append(path)
            with where.open_output_stream(f"{staged}.names") as out:
                out.write("\n".join(names).encode())
        except BaseException:
            self._remove(where, root, moved)
            raise
        finally:
            if where.get_file_info(staged).type != fs.FileType.NotFound:
                where.delete_dir(staged)
        return Written(f"{staged}.names", len(names), size)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = self._at()
        where.create_dir(root, recursive=True)
        self._unstage(where, root)
        done = [m for m in messages if m is not None]
        with where.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in done)} files, {sum(m.size for m in done)} bytes\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = self._at()
        for m in messages:
            if m is not None:
                with where.open_input_stream(m.names) as names:
                    self._remove(where, root, names.read().decode().split("\n"))
        self._unstage(where, root)

    def _unstage(self, where: fs.FileSystem, root: str) -> None:
        mine, every = f"{root}/{STAGED}/{self.job}", f"{root}/{STAGED}"
        for path in (mine, every):
            here = where.get_file_info(path).type != fs.FileType.NotFound
            if here and (path == mine or not where.get_file_info(fs.FileSelector(path))):
                where.delete_dir(path)

    @staticmethod
    def _remove(where: fs.FileSystem, root: str, names: list[str]) -> None:
        """Delete the files named and the folders that are empty without them."""
        for path in filter(None, names):
            if where.get_file_info(f"{root}/{path}").type == fs.FileType.File:
                where.delete_file(f"{root}/{path}")
        for folder in sorted({p.rpartition("/")[0] for p in names if "/" in p}, key=len, reverse=True):
            if where.get_file_info(f"{root}/{folder}").type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                where.delete_dir(f"{root}/{folder}")


class RecordFiles(DataSource):
    """df.write.format("record_files").mode("append").save(folder), for a frame (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("record_files writes to a new folder or adds to one: use mode('append')")
        return FileWriter(self.options["path"], overwrite)


def write_files(spark: SparkSession, files: DataFrame, target: str) -> None:
    """Write (path, content) rows as files below target."""
    spark.dataSource.register(RecordFiles)
    files.select("path", "content").write.format("record_files").mode("append").save(target)


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """(path, content) of the files below target, paths relative to it, content binary; empty files, hidden ones and annotations are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    plain = target.rstrip("/").split("://")[-1].removeprefix("file:")
    inside = F.substring_index("path", f"{plain}/", -1)
    return found.select(inside.alias("path"), "content").where(~inside.startswith("annotations/"))


def file_digests(spark: SparkSession, target: str) -> DataFrame:
    """(path, sha) of the files of read_files(), settled; tasks read as many files as OPEN_COST allows."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_COST)
    try:
        return settle(read_files(spark, target).select("path", F.sha1("content").alias("sha")))
    finally:
        spark.conf.set(name, before)


def write_export(spark: SparkSession, records: DataFrame, files: DataFrame, target: str, fmt: str, order: list[str]) -> None:
    """One file for each record, and the records' annotations in a folder beside them."""
    write_files(spark, files, target)
    sinks.write_records(records, f"{target}/annotations", fmt, order)
