"""Hard negatives by Fagin's threshold algorithm.

Vectors become integers, floor(SCALE * x), and a row's score for an anchor is their integer inner product. Rows are dealt by
a hash over blocks; a block keeps, for every dimension, its rows sorted by that dimension: the candidate lists. An anchor
reads each list from the end that its component's sign points to. Rows met there are scored whole (random access), and what
an unseen row can still score is at most the sum of the anchor's components times the values where its lists stand, the
threshold. An anchor is done in a block once the threshold lies strictly below the k-th score of each of its windows, or
below the window's lower end where it holds fewer than k; being strict, this keeps ties.

The first pass has one window for each anchor, its best rows of the same label, out of the lists of that label's rows. The
second has a window for each of these positives: rows of other labels whose score lies between `low` percent of the
positive's and the positive's. Each pass gives at most k rows for an anchor's window in a block, and the k best of all
blocks are kept. Anchors of a block go in groups, and a row that one of a group reaches is scored for all of the group that
aren't done, by one matrix product; so an anchor may see more rows than it asked for, never fewer.

Blocks do not depend on labels, so a label or a vector with most of the rows is spread over all blocks. Anchors are sent to
every block, and blocks are met by groups of at most GROUP anchors: no task holds more than a block and a group.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; missing components of
shorter vectors count as 0; null ids are no anchors and come last among ties; rows of one id are rows of their own, each an
anchor if the id says so; anchors without a positive, or positives without a row in their window, give no row; a positive
with a score below 0 has an empty window; scores beyond 64 bits are given as the nearest that fits; an empty table gives an
empty result; columns beyond the three named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import table, written

SCALE = 256.0
K = 5
#: Percent of a positive's score from which on a negative is hard.
LOW = 80
#: Rows of a block, anchors that meet a block in one task, and anchors that are scored by one product.
BLOCK, GROUP, TOGETHER = 65_536, 65_536, 128
#: How deep the lists are read before the first comparison; the depth doubles from there.
FIRST_DEPTH = 16
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1

ROWS = "vec_id long, label long, v array<double>"


def integers(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """One row for each vector: its components times SCALE, rounded down, with zeros to the width given."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(out * SCALE)


class Lists:
    """Rows with a candidate list for every dimension. Scores are exact: in doubles where they fit 53 bits, else in Python's integers."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.n = x, len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.most = np.abs(x).max(initial=0.0)

    def whole(self, a: np.ndarray) -> bool:
        """Whether all scores and their partial sums are integers that a double holds."""
        return self.most * np.abs(a).max(initial=0.0) * max(1, self.x.shape[1]) < _EXACT

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.whole(a):
            return self.x[rows] @ a.T
        exact = [[int(v) for v in r] for r in a]
        return np.array([[sum(int(p) * q for p, q in zip(x, r)) for r in exact] for x in self.x[rows]], object).reshape(len(rows), len(a))

    def threshold(self, a: np.ndarray, depth: int) -> np.ndarray:
        """The most that a row can score which no list has shown down to depth; a little more where sums are not exact."""
        high, low = self.sorted[self.n - depth], self.sorted[depth - 1]
        bound = np.maximum(a, 0) @ high + np.minimum(a, 0) @ low
        return bound if self.whole(a) else bound + np.abs(bound) * 1e-9 + np.abs(a) @ np.maximum(np.abs(high), np.abs(low)) * 1e-9


def kth(scores: np.ndarray, k: int, otherwise: float) -> float:
    return otherwise if len(scores) < k else np.partition(scores, len(scores) - k)[len(scores) - k]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= kth(scores, k, 0))
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def search(lists: Lists, ids: np.ndarray, own: np.ndarray, a: np.ndarray, allowed: np.ndarray, windows: list[list[tuple[float, float]]], k: int = K) -> list[list[np.ndarray]]:
    """For each anchor (row of a) and each of its windows (low, high), the places of the k best rows allowed.

    allowed[i, j] says whether row i may serve anchor j. Also gives, in `own`, how deep each anchor had to read.
    """
    found = np.full((lists.n, len(a)), -np.inf, object if not lists.whole(a) else float)
    seen, active, depth, before = np.zeros(lists.n, bool), np.arange(len(a)), min(FIRST_DEPTH, lists.n), 0
    ends = [min((lo for lo, _ in w), default=np.inf) for w in windows]
    while depth and len(active):
        reached = np.unique(np.concatenate([lists.order[before:depth].ravel(), lists.order[lists.n - depth : lists.n - before].ravel()]))
        new = reached[~seen[reached]]
        seen[new] = True
        if len(new):
            found[np.ix_(new, active)] = np.where(allowed[np.ix_(new, active)], lists.scores(new, a[active]), -np.inf)
        own[active] = depth
        if depth == lists.n:
            break
        bound, open_ = lists.threshold(a[active], depth), []
        for j, t in zip(active, bound):
            if t < ends[j] or not windows[j]:
                continue
            column = found[:, j]
            column = column[column >= ends[j]]
            if any(t >= kth(column[(column >= lo) & (column <= hi)], k, lo) for lo, hi in windows[j]):
                open_.append(j)
        active, before, depth = np.array(open_, int), depth, min(2 * depth, lists.n)
    out = []
    for j, w in enumerate(windows):
        at = np.flatnonzero((found[:, j] >= ends[j]) & (found[:, j] > -np.inf)) if w else np.zeros(0, int)
        column = found[at, j]
        out.append([at[inside[best(ids[at[inside]], column[inside], k)]] for lo, hi in w for inside in [np.flatnonzero((column >= lo) & (column <= hi))]])
    return out


def _columns(batch: pa.Table, width: int, name: str = "v") -> np.ndarray:
    lists = batch.column(name).combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return np.floor(flat.reshape(len(sizes), width) * SCALE)
    ends = np.cumsum(sizes)
    return integers([flat[e - n : e] for e, n in zip(ends, sizes)], width)


def _width(*tables: pa.Table) -> int:
    return max([0, *(int(n) for t in tables for n in np.unique(np.asarray(t.column("v").combine_chunks().value_lengths(), np.int64)))])


def _ids(t: pa.Table) -> np.ndarray:
    """Ids by which ties go, null last."""
    return np.asarray(t.column("vec_id").fill_null(_LONG).combine_chunks(), np.int64)


def _clipped(score: float) -> int:
    return max(-_LONG - 1, min(_LONG, int(score)))


FOUND = "anchor_row long, at int, vec_id long, score long"


def _made(out: list[tuple]) -> pa.Table:
    names, kinds = ("anchor_row", "at", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(list(c), t) for n, t, c in zip(names, kinds, zip(*out) if out else ((),) * 4)})


def _same_label(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best other rows of a block with each anchor's label."""
    width = _width(rows, anchors)
    x, a, ids = _columns(rows, width), _columns(anchors, width), _ids(rows)
    labels, wanted = np.asarray(rows.column("label").combine_chunks()), np.asarray(anchors.column("label").combine_chunks())
    number, mine = np.asarray(rows.column("row").combine_chunks()), np.asarray(anchors.column("row").combine_chunks())
    out = []
    for label in np.unique(wanted):
        here, asked = np.flatnonzero(labels == label), np.flatnonzero(wanted == label)
        lists = Lists(x[here]) if len(here) else None
        for part in np.array_split(asked, -(-len(asked) // TOGETHER)) if lists else ():
            allowed = number[here][:, None] != mine[part][None, :]
            met = search(lists, ids[here], np.zeros(len(part)), a[part], allowed, [[(-np.inf, np.inf)]] * len(part))
            for j, (at,) in zip(part, met):
                score = lists.scores(at, a[j : j + 1])[:, 0]
                out += [(int(mine[j]), 0, rows.column("vec_id")[int(here[i])].as_py(), _clipped(s)) for i, s in zip(at, score)]
    return _made(out)


def _between(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of a block with another label than the anchor's, for the window of each distinct score of its positives."""
    width = _width(rows, anchors)
    x, a, ids = _columns(rows, width), _columns(anchors, width), _ids(rows)
    labels, wanted = np.asarray(rows.column("label").combine_chunks()), np.asarray(anchors.column("label").combine_chunks())
    mine = np.asarray(anchors.column("row").combine_chunks())
    scores = [list(dict.fromkeys(s)) for s in anchors.column("scores").to_pylist()]
    lists, out = Lists(x), []
    for part in np.array_split(np.arange(len(a)), -(-len(a) // TOGETHER)) if len(a) else ():
        windows = [[(-(-LOW * s // 100), s) for s in scores[j] if s >= 0] for j in part]
        met = search(lists, ids, np.zeros(len(part)), a[part], labels[:, None] != wanted[part][None, :], windows)
        for j, w, places in zip(part, windows, met):
            for (_, high), at in zip(w, places):
                score, slot = lists.scores(at, a[j : j + 1])[:, 0], scores[j].index(high)
                out += [(int(mine[j]), slot, rows.column("vec_id")[int(i)].as_py(), _clipped(s)) for i, s in zip(at, score)]
    return _made(out)


def _in_cells(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, task) -> DataFrame:
    """task over every block of rows and every group of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own, as anchors are some of the rows
    left = rows.withColumn("group", every(groups)).groupBy("block", "group")
    right = anchors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("block", every(blocks)).groupBy("block", "group")
    return left.cogroup(right).applyInArrow(lambda a, b: task(a, b) if len(a) and len(b) else _made([]), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's window, with their rank; each task drops what it can before rows meet."""
    order = Window.partitionBy("anchor_row", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def taking_part(vectors: DataFrame, label: Column) -> DataFrame:
    """(row, vec_id, label, v, block?) of the rows that take part, written once; row tells them apart."""
    v = F.col("embedding").cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fit, F.lit(False)))
    return written(kept.withColumn("row", F.monotonically_increasing_id()))


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = K) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows as taking_part() gives them."""
    n, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(-(-n // BLOCK), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-asked // GROUP))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    positives = written(_first(_in_cells(dealt, anchors, blocks, groups, _same_label), k).select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")))
    lists = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("s"))  # at most k
    wanted = anchors.join(lists.select(F.col("anchor_row").alias("row"), F.col("s.positive_score").alias("scores")), "row")
    wanted = wanted.withColumn("scores", F.array_distinct("scores"))
    # A window is told by its positive's score; positives of one score share it.
    negatives = _first(_in_cells(dealt, wanted, blocks, groups, _between), k)
    named = wanted.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.posexplode("scores").alias("at", "positive_score"))
    met = positives.join(named, ["anchor_row", "positive_score"]).join(negatives.select("anchor_row", "at", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor_row", "at"])
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(taking_part(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = f"""with e as materialized (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.k as ak, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.k <> b.k),
p as (select ak, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by ak order by score desc, vec_id) as pr from s where same qualify pr <= {K}),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.ak, pr order by s.score desc, s.vec_id) as rank
  from p join s on s.ak = p.ak and not s.same and {LOW} * positive_score <= 100 * s.score and s.score <= positive_score qualify rank <= {K})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n"""
