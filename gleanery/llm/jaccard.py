"""N-gram Jaccard join with a MinHash LSH forest.

A document's set is the set of its five-word shingles. Documents with equal sets form one class, told by a hash of the
set; one of them stands for the class. Each class gets, in each of TREES prefix tries, a label of DEPTH MinHash values of 16
bits, kept as two sortable numbers. Classes under one node, that is with equal prefixes of their labels, are candidates.

A class starts with whole labels and shortens them level by level (LEVELS). A level down to length k adds -log(1 - t^k) to
the chance to meet a class at threshold t, and the classes that the shorter prefix matches to the work. Each class
shortens where recall costs least, until its chance to miss a partner is below 1 - RECALL: trees in which it is alone
are free, so classes in crowded nodes keep long prefixes there and short ones elsewhere. A node that any member shortens
to is compared with all its members, so each class meets its target by its own choices.

Nodes are never expanded into pairs. In each node every member is compared with the node's first member, so that
copies gather in components by verified links; then members of one node that lie in different components are compared
with each other: as pairs in nodes of up to FEW members, by blocks in larger ones. All comparisons are exact, on the sets
themselves. Links are counted afterwards inside components, by blocks of bounded size against each other in one task
each, which return counts and not pairs.

Defined cases: words are runs without white space; a text of one to four words has one shingle, all its words; a null or
empty text has no shingle, no link, and a class of its own row; rows equal in id and text count as documents of their own;
rows are told by 128 bits of hashes of id and text, so rows that share an id but not the text are kept apart, and null ids
are ids like others; ties take the smallest id (null if the class has no other); an empty table gives an empty result; other
columns are not returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import settle, table, word_hashes
from gleanery.llm.substring import _chunks, gram_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
#: Lengths to which labels are shortened, one after the other.
LEVELS = (8, 6, 4, 3)
RECALL = 0.9999
#: Members and set elements of a block, at most; a set with more elements is a block of its own.
BLOCK, BLOCK_ELEMENTS = 1_024, 400_000
#: Sets with this share of all rows or more are broadcast when rows look up their class: at most its inverse in number.
HOT = 1e-4
#: Members up to which a bucket's pairs are compared as rows; larger buckets are compared by blocks. Both are exact.
FEW = 8
_BASE = 0xA24BAED4963EE407


def shortened(nodes: list[tuple[int, list[int]]], threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> list[tuple[int, int]]:
    """(tree, level) that a class shortens to in its crowded trees, given (tree, members of its node at each of LEVELS).

    Trees that are not listed hold no other class at the shortest prefix, so there it is shortened for nothing.
    """
    gain = [-math.log1p(-(threshold**k)) for k in LEVELS]
    at = [0] * len(nodes)
    reached = gain[0] * len(nodes) + gain[-1] * (trees - len(nodes))
    cost = lambda i: (nodes[i][1][at[i] + 1] - nodes[i][1][at[i]]) / (gain[at[i] + 1] - gain[at[i]])
    queue = [(cost(i), i) for i in range(len(nodes))]
    heapq.heapify(queue)
    while queue and reached < -math.log(1 - recall):
        _, i = heapq.heappop(queue)
        reached += gain[at[i] + 1] - gain[at[i]]
        at[i] += 1
        if at[i] + 1 < len(LEVELS):
            heapq.heappush(queue, (cost(i), i))
    return [(tree, level) for (tree, sizes), level in zip(nodes, at) if sizes[level] > 1]


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one document's word hashes."""
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(SHINGLE, len(h)), _BASE))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, h, lengths in _chunks(batches):
        ends = np.cumsum(lengths)
        yield rows, [shingle_set(h[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit key of each set, null for an empty one."""
    for rows, sets in _sets(batches):
        k1 = [int(_fold(s, 0)) if len(s) else None for s in sets]
        k2 = [int(_fold(s, 1)) if len(s) else None for s in sets]
        told = [rows.column(c) for c in ("key", "tag", "doc_id")]
        yield pa.RecordBatch.from_arrays([*told, pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["key", "tag", "doc_id", "k1", "k2"])


def _fold(s: np.ndarray, which: int) -> np.int64:
    """A hash of a sorted set."""
    x = gram_hashes(s, len(s), (0x9FB21C651E98DF25, 0xD1342543DE82EF95)[which])
    return x.view(np.int64)[0]


def _signer(trees: int):
    """A function that gives each set's label in each tree: DEPTH MinHash values of 16 bits, first to last, as two numbers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(20_240_501)
        times = random.integers(1, 1 << 63, (trees, DEPTH), dtype=np.uint64) | np.uint64(1)
        for rows, sets in _sets(batches):
            filled = [i for i, s in enumerate(sets) if len(s)]
            if not filled:
                continue
            flat = np.concatenate([sets[i] for i in filled])
            begin = np.cumsum([0, *(len(sets[i]) for i in filled)])[:-1]
            ids = rows.column("id").take(pa.array(filled))
            for t in range(trees):
                halves = []
                for half in range(2):
                    label = np.zeros(len(filled), np.uint64)
                    for j in range(4):
                        values = flat * times[t, 4 * half + j]
                        least = np.minimum.reduceat(values ^ (values >> np.uint64(29)), begin)
                        mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                        label = (label << np.uint64(16)) | (mixed >> np.uint64(48))
                    halves.append(pa.array(label.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(filled), t, np.int8)), *halves], ["id", "tree", "hi", "lo"])

    return sign


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "s"])


def keyed(docs: DataFrame) -> DataFrame:
    """(key, tag, doc_id, text): key and tag, 128 bits of hashes of id and text, tell rows apart; rows equal in both share them."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(_BASE >> 1), "text", "doc_id").alias("tag"), "doc_id", "text")


def set_classes(rows: DataFrame) -> DataFrame:
    """(row, key, tag, doc_id, id, n, empty): every row with a number of its own, the number of the row that stands for its set,
    and how many rows have that set."""
    hashed = rows.select("key", "tag", "doc_id", word_hashes(F.col("text")).alias("h"))
    # Rows are numbered before they are written, so that a number stays with its row.
    keys = settle(hashed.mapInArrow(_keys, "key long, tag long, doc_id long, k1 long, k2 long").withColumn("row", F.monotonically_increasing_id()))
    least = max(1_000, int(keys.count() * HOT))
    some = keys.where("k1 is not null")
    first = settle(some.groupBy("k1", "k2").agg(F.min("row").alias("id"), F.count("*").alias("n")).where("n > 1"))
    # Rows with a very frequent set look it up in a small broadcast table, so that they do not meet in one task.
    hot = first.where(F.col("n") >= least)  # at most 1 / HOT rows
    met = some.join(F.broadcast(hot), ["k1", "k2"], "left")
    rest = met.where("id is null").drop("id", "n").join(first.where(F.col("n") < least), ["k1", "k2"], "left")
    shape = lambda df, empty: df.select("row", "key", "tag", "doc_id", F.coalesce("id", "row").alias("id"), F.coalesce("n", F.lit(1)).alias("n"), F.lit(empty).alias("empty"))
    alone = keys.where("k1 is null").withColumns({"id": F.col("row"), "n": F.lit(1).cast("long")})
    return settle(shape(met.where("id is not null"), False).unionByName(shape(rest, False)).unionByName(shape(alone, True)))


def standing(rows: DataFrame, classes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, h): the word hashes of the row that stands for each class that has words, or for those in ids alone; repeated rows
    give one."""
    those = classes.where("not empty and row = id").select("id", "key", "tag")
    if ids is not None:
        those = those.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.join(those, ["key", "tag"]).dropDuplicates(["key", "tag"]).select("id", word_hashes(F.col("text")).alias("h"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(both >= F.lit(threshold) * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each linked id reaches. Large-star and small-star steps until nothing changes."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.where("u <> v").distinct().groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("u <> v").distinct().join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = settle(small.where("u <> v").distinct())
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            return following.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(following.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
        edges = following


def nodes_of(labels: DataFrame) -> DataFrame:
    """(id, tree, level, node): the trie nodes of labels (id, tree, hi, lo) at each of LEVELS."""
    made = []
    for level, k in enumerate(LEVELS):
        values = [F.lit(level).cast("byte"), "tree", F.shiftright("hi", 16 * max(0, 4 - k)), *([F.shiftright("lo", 16 * (8 - k))] if k > 4 else [])]
        made.append(F.struct(F.lit(level).cast("byte").alias("level"), F.xxhash64(*values).alias("node")))
    return labels.select("id", "tree", F.explode(F.array(*made)).alias("at")).select("id", "tree", "at.level", "at.node")


def _choose(threshold: float, trees: int, recall: float):
    def choose(crowded: pd.Series) -> pd.Series:
        out = []
        for rows in crowded:
            nodes = [(r["tree"], list(r["sizes"])) for r in rows]
            out.append([{"tree": t, "level": k} for t, k in shortened(nodes, threshold, trees, recall)])
        return pd.Series(out)

    return choose


def candidate_nodes(labels: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(bucket, id): the members of the nodes that some class shortens to; of nested nodes only the outermost."""
    shortest = F.xxhash64("tree", F.shiftright("hi", 16 * (4 - LEVELS[-1])))
    roots = labels.withColumn("root", shortest)
    shared = roots.groupBy("root").agg(F.count("*").alias("members")).where("members > 1").select("root")
    crowded = settle(roots.join(shared, "root").select("id", "tree", "hi", "lo"))
    nodes = nodes_of(crowded)
    sizes = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    sized = settle(nodes.join(sizes, "node"))
    # A node's size at a level where the class is alone is 1.
    per_tree = sized.groupBy("id", "tree").agg(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col("members"))), F.lit(1)).alias(f"n{k}") for k in range(len(LEVELS))])
    trees_of = per_tree.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tree", F.array(*[f"n{k}" for k in range(len(LEVELS))]).alias("sizes")))).alias("crowded"))  # at most `trees`
    chosen = trees_of.select("id", F.explode(pandas_udf(_choose(threshold, trees, recall), "array<struct<tree:byte,level:byte>>")("crowded")).alias("c")).select("id", "c.tree", "c.level")
    active = sized.join(chosen, ["id", "tree", "level"], "left_semi").select("node").distinct()
    outermost = sized.join(active, "node").groupBy("id", "tree").agg(F.max_by("node", "level").alias("bucket"))
    return outermost.select("bucket", "id")


def linked_classes(rows: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(components, sets): the component of every class that has a link, and the sets of the candidates."""
    labels = standing(rows, classes).mapInArrow(_signer(trees), "id long, tree byte, hi long, lo long")
    members = settle(candidate_nodes(settle(labels), threshold, trees, recall))
    firsts = members.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    placed = settle(members.join(firsts, "bucket"))
    sets = settle(standing(rows, classes, placed).mapInArrow(_set_rows, "id long, s array<long>"))
    stars = verified(placed.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), sets, threshold)
    stars = settle(stars)
    found = settle(components(stars))
    located = placed.join(found, "id", "left").select("bucket", "id", F.coalesce("class", "id").alias("class"))
    mixed = located.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("bucket", "members")
    rest = settle(located.join(mixed, "bucket"))
    few = rest.where(F.col("members") <= FEW)
    across = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") < F.col("y.class")))
    pairs = verified(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), sets, threshold)
    more = settle(pairs.unionByName(bridges(rest.where(F.col("members") > FEW), sets, threshold)))
    if not more.isEmpty():
        found = settle(components(stars.unionByName(more)))
    return found, sets


def in_blocks(members: DataFrame, group: str, block: int, elements: int) -> DataFrame:
    """members (group, id, s, …) with block numbers i <= j: each member once for every block of its group, so that (group, i, j)
    holds two blocks. Blocks have about `block` members and `elements` set elements at most."""
    count = members.groupBy(group).agg(F.count("*").alias("_m"), F.sum(F.size("s")).alias("_e"))
    parts = F.greatest(F.ceil(F.col("_m") / block), F.ceil(F.col("_e") / elements), F.lit(1)).cast("int")
    placed = members.join(count.select(group, parts.alias("parts")), group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


def _bridge(threshold: float):
    def bridge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        a, b = rows[rows["part"] == i], rows[rows["part"] == j]
        la, lb = a["id"].to_numpy().copy(), b["id"].to_numpy().copy()
        if len(la) and len(lb):
            linked = count_links(list(a["s"]), list(b["s"]), threshold)
            far = np.iinfo(np.int64).max
            while True:  # the smallest id that verified links reach inside the two blocks
                na = np.minimum(la, np.where(linked, lb[None, :], far).min(axis=1))
                nb = np.minimum(lb, np.where(linked, na[:, None], far).min(axis=0))
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
        out = pd.DataFrame({"a": [*la, *lb], "b": [*a["id"], *b["id"]]})
        return out[out["a"] != out["b"]].drop_duplicates()

    return bridge


def bridges(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(a, b): ids that verified links connect inside large buckets, each with the smallest it reaches; a row per member and block."""
    dealt = in_blocks(members.select("bucket", "id").join(sets, "id"), "bucket", block, elements)
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_bridge(threshold), "a long, b long").distinct()


def count_links(left: list[np.ndarray], right: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each set on the left and each on the right have the similarity, as a Boolean matrix.

    Only shingles that occur twice or more add to an intersection; with those as columns, a matrix product counts them.
    """
    every, number = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    often = np.bincount(number, minlength=len(every)) > 1
    column = np.cumsum(often) - 1
    sizes = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = often[number]
    row, number = row[keep], column[number[keep]]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), 4096):  # so many columns at once, for bounded memory
        inside = (number >= at) & (number < at + 4096)
        part = np.zeros((len(sizes), min(4096, int(often.sum()) - at)), np.float32)
        part[row[inside], number[inside] - at] = 1
        total += part[: len(left)] @ part[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - total
    return total >= threshold * union - 1e-9


def _block_counts(threshold: float):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        a, b = rows[rows["part"] == i], rows[rows["part"] == j]
        linked = count_links(list(a["s"]), list(b["s"]), threshold)
        if i == j:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"id": a["id"], "links": linked @ a["n"].to_numpy()})
        return pd.DataFrame({"id": [*a["id"], *b["id"]], "links": [*(linked @ b["n"].to_numpy()), *(linked.T @ a["n"].to_numpy())]})

    return count


def link_counts(found: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(id, links): the documents outside a class that its set is linked with, by blocks inside each component."""
    dealt = in_blocks(found.join(sets, "id").join(sizes, "id"), "class", block, elements)
    counted = dealt.groupBy("class", "i", "j").applyInPandas(_block_counts(threshold), "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def looked_up(rows: DataFrame, found: DataFrame, key: str, size: str, least: int) -> DataFrame:
    """rows with the columns of found, which holds each of their keys once and says in `size` how many rows have it.

    Keys of `least` rows or more are few, at most the number of rows divided by it; they are broadcast, so that their rows
    do not meet in one task.
    """
    hot = F.broadcast(found.where(F.col(size) >= least))
    others = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col(size) < least), key)
    return rows.join(hot, key).unionByName(others)


def per_document(classes: DataFrame, found: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id, n, empty, links) for each row of classes; class_id is the smallest doc_id of the rows in a component."""
    least = max(1_000, int(classes.count() * HOT))
    ids = classes.groupBy("id").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.max("empty").alias("empty"))
    placed = settle(ids.join(found, "id", "left").withColumn("class", F.coalesce("class", "id")))
    several = placed.groupBy("class").agg(F.min("least_id").alias("class_id"), F.count("*").alias("sets"))
    told = looked_up(placed, settle(several), "class", "sets", least).select("id", "class_id", "n", "empty")
    told = told.join(links, "id", "left") if links is not None else told.withColumn("links", F.lit(None).cast("long"))
    return looked_up(classes.select("id", "doc_id"), settle(told), "id", "n", least).drop("id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): one row per row of docs; rows that links connect share a class, the smallest id in it."""
    rows = keyed(docs)
    classes = set_classes(rows)
    found, _ = linked_classes(rows, classes, threshold)
    return per_document(classes, found).select("doc_id", "class_id")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): n_links is the number of other documents with the similarity, copies counted."""
    rows = keyed(docs)
    classes = set_classes(rows)
    found, sets = linked_classes(rows, classes, threshold)
    sizes = classes.where("not empty").groupBy("id").agg(F.max("n").alias("n"))
    met = per_document(classes, found, link_counts(found, sets, sizes, threshold))
    return met.select("doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.when(F.col("empty"), 0).otherwise(F.col("n") - 1)).cast("long").alias("n_links"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
