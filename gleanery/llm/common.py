"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with value evaluated once per row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none. Splitting is cheaper than matching each word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case: name, or name with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As settle, as a compressed table: smaller for rows of a few numbers."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def among(rows: DataFrame, counts: DataFrame, keys: list[str], share: float = 1e-4, salts: int = 64) -> DataFrame:
    """The rows whose keys are in counts, a written table (keys…, count) with the number of rows of each key.

    Keys with `share` of all these rows or more, which are at most its inverse in number, are dealt over several tasks: their
    rows get a salt, and their line in counts is repeated for each salt. The list of them is broadcast.
    """
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("count") >= max(1_000, int(share * total))).select(*keys, F.lit(True).alias("_hot")))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    marked = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    repeated = counts.join(hot, keys, "left").select(*keys, F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))).alias("_salt"))
    return marked.join(repeated, [*keys, "_salt"], "left_semi").drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without, in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents with a column `label`, chosen by a hash of the id."""
    chosen = labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    return docs.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
