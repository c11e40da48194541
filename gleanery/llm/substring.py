"""Substring de-duplication by seed and extend.

Every window of LENGTH words has an anchor: its K-gram of words with the least hash (winnowing), which depends on the
window's words only. Anchors that occur once in the corpus cannot lie in a repeat and go. Documents are joined with the
repeated anchors found in them, and each seed is extended both ways, to the stretch of all windows that it anchors. Equal
stretches meet by their hashes and are repeats as a whole; stretches that differ although their anchor is the same, as at the
ends of a repeat, are taken apart into windows that meet by theirs. The union of what is found in a document is its maximal
repeats.

A seed is not extended against each of its partners, since a passage shared by many documents would make as many pairs as
the square of its places. It is extended once, and equal extensions meet by their hashes: rows are in proportion to places.
Anchors, stretches and windows are counted with map-side sums; those that a large share of all rows has are dealt over
several tasks when they meet their counts.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; rows equal in id and text
are repeats of each other; a word counts as covered once however many windows cover it; an empty table gives an empty
result; other columns are not returned; ids may be null or shared, since rows are told apart by 96 bits of hashes of id and
text. Word hashes have 64 bits, those of
windows and of stretches with their anchor 128, so the result is exact up to collisions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import WORD, among, settle, table, word_hashes, written

LENGTH = 35
K = 10
#: Words handled at once in a task; a longer document is handled whole.
CHUNK = 500_000
#: Windows that one place can anchor, at most.
WIDTH = LENGTH - K + 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_WORD = re.compile(WORD)
#: What comes before id and text in the second of their hashes.
KEY_SEED = 7


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all runs of k elements of h."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    return _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def windows(h: np.ndarray, lengths: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, places of the anchors) of the windows inside documents laid end to end in h."""
    if len(h) < length:
        return (np.zeros(0, np.int64),) * 3
    grams = gram_hashes(h, k, _BASES[0])
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.arange(len(h) - length + 1)
    starts = starts[starts + length <= ends[: len(starts)]]
    width = length - k + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 100_000):
        part = starts[i : i + 100_000]
        at[i : i + 100_000] = part + view[part].argmin(axis=1)
    return starts, grams[at].view(np.int64), at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes end to end, lengths) for runs of rows with about CHUNK words."""
    for batch in batches:
        lists = batch.column("h")
        lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        group = np.cumsum(lengths) // CHUNK
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lengths)] if len(lengths) else []
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            yield part, np.asarray(part.column("h").flatten()).view(np.uint64), lengths[a:b]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, h, lengths in _chunks(batches):
        _, anchors, at = windows(h, lengths)
        at, first = np.unique(at, return_index=True)
        doc = np.repeat(np.arange(len(lengths)), lengths)[at] if len(at) else at
        take = pa.array(doc)
        begin = np.cumsum(lengths) - lengths
        yield pa.RecordBatch.from_arrays([pa.array(anchors[first]), rows.column("row").take(take), rows.column("tag").take(take), pa.array((at - begin[doc]).astype(np.int32))], ["anchor", "row", "tag", "at"])


def run_hashes(h: np.ndarray, begin: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """Hashes of runs of h, each with its own size."""
    up, down = _powers(base, len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return _mixed((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64) * np.uint64(_BASES[0]))


def stretches(h: np.ndarray, lengths: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, further windows, anchor, its place) of the runs of windows that have one anchor at one place."""
    starts, anchors, at = windows(h, lengths, length, k)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    more = np.diff(np.append(first, len(at))) - 1
    return starts[first], more, anchors[first], at[first]


def _beside(rows: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    """The keys of each document named by its place in rows."""
    take = pa.array(doc)
    return [rows.column("row").take(take), rows.column("tag").take(take)]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed grown both ways over all windows that it anchors: its anchor, a hash of all their words, and their place."""
    for rows, h, lengths in _chunks(batches):
        start, more, anchor, at = stretches(h, lengths)
        begin = np.cumsum(lengths) - lengths
        seeds = rows.column("seeds")
        seeded = np.zeros(len(h) + 1, bool)
        seeded[np.asarray(seeds.flatten(), np.int64) + np.repeat(begin, np.asarray(seeds.value_lengths(), np.int64))] = True
        start, more, anchor = (x[seeded[at]] for x in (start, more, anchor))
        doc = np.repeat(np.arange(len(lengths)), lengths)[start] if len(start) else start
        whole = run_hashes(h, start, more + LENGTH, _BASES[1]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(whole), *_beside(rows, doc), pa.array((start - begin[doc]) * WIDTH + more)], ["anchor", "whole", "row", "tag", "at"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the stretches of each document, with their 128-bit hashes."""
    for rows, h, lengths in _chunks(batches):
        begin = np.cumsum(lengths) - lengths
        lists = rows.column("stretches")
        doc = np.repeat(np.arange(len(lengths)), np.asarray(lists.value_lengths(), np.int64))
        packed = np.asarray(lists.flatten(), np.int64)
        size = packed % WIDTH + 1
        doc = np.repeat(doc, size)
        start = np.repeat(packed // WIDTH, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hashes = [pa.array(gram_hashes(h, LENGTH, b)[begin[doc] + start].view(np.int64) if len(start) else np.zeros(0, np.int64)) for b in _BASES[1:]]
        yield pa.RecordBatch.from_arrays([*hashes, *_beside(rows, doc), pa.array(start * WIDTH)], ["h1", "h2", "row", "tag", "at"])


def cut(text: str | None, found: np.ndarray | None, copied: bool = False, length: int = LENGTH) -> tuple[int, int, str]:
    """(words, words removed, kept words joined by single spaces) when the windows found go, or all if the text is copied.

    An element of found is WIDTH times the place of a window plus the number of windows that follow it.
    """
    every = _WORD.findall(text or "")
    if copied and len(every) >= length:
        return len(every), len(every), ""
    if found is None or not len(found):
        return len(every), 0, " ".join(every)
    edge = np.zeros(len(every) + 1, np.int64)
    start, more = np.divmod(np.asarray(found, np.int64), WIDTH)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + more + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(every), int(gone.sum()), " ".join([w for w, g in zip(every, gone.tolist()) if not g])


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, tag, doc_id, text): row and tag, 96 bits of hashes of id and text, tell rows apart; rows equal in both share them."""
    text = F.col(text_col).alias("text")
    return docs.select(F.xxhash64("doc_id", text_col).alias("row"), F.hash(F.lit(KEY_SEED), "doc_id", text_col).alias("tag"), "doc_id", text)


def _meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right on (row, tag)."""
    return left.join(right, ["row", "tag"], how)


def copies(docs: DataFrame) -> DataFrame:
    """(row, tag, stands) for the rows of keyed() whose text occurs in other rows too; one row of each text stands for it."""
    light = docs.select("row", "tag", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    groups = light.groupBy("m").agg(F.min(F.struct("row", "tag")).alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "first")
    return light.join(groups, "m").groupBy("row", "tag").agg(F.max(F.struct("row", "tag") == F.col("first")).alias("stands"))


def repeated_windows(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(row, tag, found): the windows whose words also start elsewhere, for the rows of keyed(); found as cut() takes it.

    Of equal texts only the one that stands for them is extended: every window of a copied text is a repeat anyhow.
    Stretches with equal words are repeats as a whole. Only where an anchor has different stretches, at the ends of
    repeats, one of each kind is taken apart into its windows.
    """
    hashed = docs.select("row", "tag", word_hashes(F.col("text")).alias("h"))
    anchors = hashed.mapInArrow(_anchors, "anchor long, row long, tag int, at int")
    often = written(anchors.groupBy("anchor").count().where("count > 1"))
    seeds = among(anchors, often, ["anchor"]).groupBy("row", "tag").agg(F.collect_set("at").alias("seeds"))
    others = copied.where("not stands")
    seeds = settle(_meet(seeds, others.select("row", "tag"), "left_anti"))
    words = lambda chosen, name: _meet(docs, chosen, "inner").select("row", "tag", word_hashes(F.col("text")).alias("h"), name)
    grown = written(words(seeds, "seeds").mapInArrow(_extended, "anchor long, whole long, row long, tag int, at long"))
    kinds = written(grown.groupBy("anchor", "whole").agg(F.count("*").alias("count"), F.min(F.struct("row", "tag", "at")).alias("first")))
    covered = among(grown, kinds.where("count > 1").select("anchor", "whole", "count"), ["anchor", "whole"]).select("row", "tag", "at")
    mixed = written(kinds.groupBy("anchor").count().where("count > 1"))
    apart = among(kinds.select("anchor", "first"), mixed, ["anchor"]).select("first.*").groupBy("row", "tag").agg(F.collect_list("at").alias("stretches"))
    single = words(settle(apart), "stretches").mapInArrow(_spread, "h1 long, h2 long, row long, tag int, at long")
    twice = written(single.groupBy("h1", "h2").count().where("count > 1"))
    return covered.unionByName(among(single, twice, ["h1", "h2"]).select("row", "tag", "at")).groupBy("row", "tag").agg(F.collect_list("at").alias("found"))


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the words of repeated windows."""
    rows = keyed(docs, text_col)
    copied = settle(copies(rows))
    found = repeated_windows(rows, copied)

    def removed(texts: pd.Series, at: pd.Series, everything: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, a, e) for t, a, e in zip(texts, at, everything)], columns=["n_words", "n_removed", "kept"])

    met = _meet(_meet(rows, found, "left"), copied, "left")
    cleaned = pandas_udf(removed, "n_words long, n_removed long, kept string")("text", "found", F.col("stands").isNotNull())
    return met.select("doc_id", cleaned.alias("r")).select("doc_id", "r.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
