"""The stateless operators over streams, and de-duplication within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.functions import text as T
from gleanery.operators.clean import clean_paragraphs
from gleanery.operators.records import message_kind

#: Where the state of a digest must be kept: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clean_stream(items: DataFrame) -> DataFrame:
    """clean_paragraphs holds for streams as it is."""
    return clean_paragraphs(items, native=True)


def dedup_stream(items: DataFrame, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """The first copy of each text within the watermark; state is dropped as the watermark passes."""
    hashed = items.withColumn("_hash", T.content_hash(F.col("text"))).withWatermark(time_col, delay)
    return hashed.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


class _Digest(StatefulProcessor):
    """State of a job: its last message, the number of digests given and its newest messages, as one value: each call to the store
    costs a round trip from Python to the JVM, far more than what it carries."""

    def __init__(self, newest: int, ttl_ms: int | None) -> None:
        self.newest, self.ttl_ms = newest, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "message string, given long, kept array<struct<ts timestamp, seq long, message string, kind string>>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        message, given, kept = self.job.get() or (None, 0, ())
        kept = [tuple(x) for x in kept]
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            if message is None or r.message is not None and r.message != message:
                kept.append((r.ts, r.seq, r.message, r.kind))
            message = r.message
        kept = kept[-self.newest :]
        self.job.update((message, given + 1, kept))
        errors = sum(k == "error" for *_, k in kept)
        for ts, seq, said, kind in kept:
            yield Row(job=key[0], given=given + 1, ts=ts, seq=seq, message=said, kind=kind, errors=errors)

    def close(self) -> None:
        pass


def digest_stream(log: DataFrame, newest: int = 30, ttl_ms: int | None = None) -> DataFrame:
    """status_digest over a stream (job, ts, seq, message) that comes in order: whenever a job has news, its whole digest.

    `given` numbers a job's digests; the one with the largest number holds. State is at most `newest` messages for a job, and
    is dropped when nothing came for ttl_ms (a stream with such a limit goes on by the clock: stop it, it does not end by itself). A batch's rows of one job are sorted in memory: bound batches by the source's
    options. The session must keep state in STATE_STORE.
    """
    classed = log.select("job", "ts", F.col("seq").cast("long").alias("seq"), "message", message_kind(F.col("message")).alias("kind"))
    schema = classed.select("job", F.lit(0).cast("long").alias("given"), "ts", "seq", "message", "kind", F.lit(0).cast("long").alias("errors")).schema
    return classed.groupBy("job").transformWithState(_Digest(newest, ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime")


def latest_digests(given: DataFrame) -> DataFrame:
    """Each job's last digest of all that digest_stream() gave."""
    last = given.groupBy("job").agg(F.max("given").alias("given"))
    return given.join(last, ["job", "given"]).drop("given")
