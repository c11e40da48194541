"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without, in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def fixed_parts(spark: SparkSession, parts: int) -> Iterator[None]:
    """Plans made inside deal rows over `parts` and tell how these lie. Adaptive ones do not tell it of what they settled, so
    that each join would deal settled frames anew."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """As settle(), with the rows dealt by key over `parts` and in its order, which joins and sums by the key take as given."""
    with fixed_parts(df.sparkSession, parts):
        return settle(df.repartition(parts, key).sortWithinPartitions(key))


def written(df: DataFrame) -> DataFrame:
    """As settle(), as a compressed table: for texts and arrays, whose rows a checkpoint holds as they are in memory."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
