"""De-duplication against earlier runs: a persisted Bloom filter first, an exact look-up for what it lets through."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Bits of a block of the filter, as Spark's bitmaps have them, and the bits that a key sets in its block.
BITS, SET = 32_768, 4


def _key(text: Column) -> Column:
    """The content hash; rows without a text are copies of each other."""
    return F.coalesce(T.content_hash(text), F.lit("-"))


class Seen:
    """The texts of earlier runs in a folder: `hashes` (key) by run and `filter` (block, bits) by run.

    A key has SET bits in one block, so that a look-up meets one row of the filter. `blocks` is part of the folder's layout:
    about one for 3,000 keys gives less than one false hit in 100; with more keys there are more hits to look up, and the
    result stays exact.
    """

    def __init__(self, spark: SparkSession, folder: str, blocks: int = 1_024) -> None:
        self.spark, self.folder, self.blocks = spark, folder, blocks

    def _placed(self, keys: DataFrame) -> DataFrame:
        """keys with their block and the places of their bits."""
        places = F.array(*[F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(BITS)) for i in range(1, SET + 1)])
        return keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(self.blocks))).withColumn("places", places)

    def _read(self, part: str, schema: str) -> DataFrame:
        """A part of the store; empty before the first run."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def remember(self, items: DataFrame) -> None:
        """Add the texts of a run. Hashes are written before the filter, so that a run cut short is repeated, never half known."""
        keys = items.select(_key(F.col("text")).alias("key")).distinct()
        run = uuid.uuid4().hex
        keys.write.parquet(f"{self.folder}/hashes/run={run}")
        kept = self.spark.read.parquet(f"{self.folder}/hashes/run={run}")
        bits = self._placed(kept).select("block", F.explode("places").alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits.write.parquet(f"{self.folder}/filter/run={run}")

    def may_hold(self, items: DataFrame) -> DataFrame:
        """items with `hit`: False is certain, True must be looked up."""
        bits = self._read("filter", "block long, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        placed = self._placed(items.withColumn("key", _key(F.col("text")))).join(bits, "block", "left")
        return placed.withColumn("hit", F.coalesce(F.forall("places", lambda p: _bit(F.col("bits"), p)), F.lit(False))).drop("block", "places", "bits")

    def unseen(self, items: DataFrame) -> DataFrame:
        """The items (with `text`) that no earlier run had."""
        met = self.may_hold(items)
        known = self._read("hashes", "key string")
        certain, asked = met.where(~F.col("hit")), met.where("hit")
        return certain.unionByName(asked.join(known, "key", "left_anti")).select(*items.columns)


def _bit(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), place % 8)), F.lit(2)) == 1
