"""A Merkle manifest of a table, by nested-interval labels.

Each row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a part (a language) stand in the order of
their ids; every FAN consecutive nodes make the node above, up to the part's subroot, and the subroots in the order of their
parts likewise make the root. A node carries the interval of leaf ranks that it covers. Going down, each level's nodes meet
their ancestors' paths in a join on (tree, bucket of the level) in which the one interval contains the other; inside a
parent's interval, what a child's own interval leaves on its left and right are its siblings.

Ranks come from range partitions and the number of rows in each, so neither a part with most of the rows nor many equal ids
meet in one task. A group holds at most FAN nodes. Every level is written once to the shared folder.

Defined cases: nulls are `-` in a leaf; a null part is a part of its own and comes first; null ids come first in their part,
equal ids go by their leaves, and rows equal in all fields are interchangeable; a run of one node has no siblings, yet makes
a node above it; a part of one leaf has this leaf as its subroot, a table of one part has its subroot as the root; an empty
table has no leaf and no root; very long texts are hashed whole; columns beyond the fields named take no part, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import table, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a generated row number that count inside a partition.
_INSIDE = 33


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields as hex text: `-` for null, else the number of bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def positioned(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written, with their place from 0 in the order given. The number of rows by partition, a row each, is broadcast."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _INSIDE).alias("_p")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    met = dealt.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return met.withColumn(name, F.col("_s") + F.col("_m") - F.shiftleft("_p", _INSIDE)).drop("_m", "_p", "_s")


def above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes (tree, size, bucket, lo, hi, digest, kids) of a level, from those below (tree, size, lo, hi, digest, carried).

    size is the number of leaves of the tree; a tree that has come down to one node below keeps that node's digest.
    """
    below = FAN ** (level - 1)
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "carried")))  # at most FAN
    runs = nodes.groupBy("tree", "size", F.expr(f"lo div {below * FAN}").alias("bucket")).agg(kids.alias("kids"))
    made = F.unhex(F.sha2(_hex(_all(F.col("kids"))), 256))
    first, last = F.element_at("kids", 1), F.element_at("kids", -1)
    return runs.select("tree", "size", "bucket", first["lo"].alias("lo"), last["hi"].alias("hi"), F.when(F.col("size") > below, made).otherwise(first["digest"]).alias("digest"), "kids")


def _all(kids: Column) -> Column:
    """The digests of nodes, one after the other."""
    return F.aggregate(kids, F.lit(b""), lambda a, k: F.concat(a, k["digest"]))


def grown(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The levels of trees of at most `largest` leaves, from the first above the leaves to the one with a node for each tree."""
    levels, empty = [], F.lit(None).cast("boolean")
    while not levels or FAN ** len(levels) < largest:
        levels.append(written(above(nodes, len(levels) + 1)))
        nodes = levels[-1].select("tree", "size", "lo", "hi", "digest", empty.alias("carried"))
    return levels


def descended(levels: list[DataFrame], tops: DataFrame, *kept: str) -> DataFrame:
    """(tree, lo, digest, carried, path, kept…) of the leaves, from the paths (tree, lo, hi, path, kept…) of the trees' tops.

    A path holds for each level, from the leaf up, the digests to the left and to the right inside the parent's interval.
    """
    paths = tops
    for level in range(len(levels), 0, -1):
        width, nodes = FAN**level, levels[level - 1]
        up = paths.select(F.col("tree").alias("_tree"), F.expr(f"lo div {width}").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "path", *kept)
        inside = (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        met = nodes.select("tree", "size", "bucket", "lo", "hi", "kids").join(up, inside).select("tree", "size", "kids", "path", *kept, F.explode("kids").alias("own"))
        left = _all(F.filter("kids", lambda k: k["hi"] <= F.col("own.lo")))
        right = _all(F.filter("kids", lambda k: k["lo"] >= F.col("own.hi")))
        path = F.when(F.col("size") > width // FAN, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path")).otherwise(F.col("path"))
        paths = met.select("tree", "own.lo", "own.hi", "own.digest", "own.carried", path.alias("path"), *kept)
    return paths


def proof(path: Column) -> Column:
    """The siblings on a path as hex text, level by level from the leaf up, each from left to right."""
    return F.array_join(F.transform(path, lambda p: _hex(F.concat(p["left"], p["right"]))), "")


def folded(start: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and the siblings on its path give."""
    return F.aggregate(path, start, lambda a, p: F.sha2(F.concat(_hex(p["left"]), a, _hex(p["right"])), 256))


@dataclass(frozen=True)
class Manifest:
    """The trees of a table: `parts` (tree, part, size), the levels of the parts' trees and those of the tree over them."""

    parts: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]

    def nodes(self) -> DataFrame:
        """(part, level, lo, hi, digest): all nodes with the leaf ranks that they cover; level 0 is the leaves."""
        out = self.levels[0].select("tree", F.lit(0).alias("level"), F.explode("kids").alias("k")).select("tree", "level", "k.lo", "k.hi", _hex(F.col("k.digest")).alias("digest"))
        for level, nodes in enumerate(self.levels, 1):
            out = out.unionByName(nodes.where(F.col("size") > FAN ** (level - 1)).select("tree", F.lit(level).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest")))
        return out.join(self.parts.select("tree", "part"), "tree").drop("tree")

    def root(self) -> DataFrame:
        """(digest): one row, none for an empty table."""
        return self.upper[-1].select(_hex(F.col("digest")).alias("digest"))

    def paths(self) -> DataFrame:
        """(carried, leaf, subroot, root, path) of every leaf."""
        none = F.array().cast("array<struct<left:binary,right:binary>>")
        top = self.upper[-1].select("tree", "lo", "hi", none.alias("path"), F.col("digest").alias("root"))
        subs = descended(self.upper, top, "root").select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "path", "root")
        tops = self.levels[-1].select("tree", "lo", "hi").join(subs, "tree")
        found = descended(self.levels, tops, "subroot", "root")
        return found.select("carried", *[_hex(F.col(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))], "path")


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (part, place, digest, carried): digests are binary, carried comes back with the paths."""
    leaves = written(leaves.select("part", "place", "digest", "carried").withColumn("_at", F.monotonically_increasing_id()))
    placed = positioned(leaves, ["part", "place", "digest", "_at"], "at")
    # One row for each part: written, so that Spark knows its size when it chooses how to join it with the leaves.
    parts = written(positioned(placed.groupBy("part").agg(F.min("at").alias("start"), F.count("*").alias("size")), ["part"], "tree"))
    largest, n_parts = parts.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    other = parts.withColumnRenamed("part", "_part")
    ranked = placed.join(other, F.col("part").eqNullSafe(F.col("_part"))).withColumn("lo", F.col("at") - F.col("start"))
    levels = grown(ranked.select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest", "carried"), largest)
    subroots = levels[-1].select(F.lit(0).alias("tree"), F.lit(n_parts).alias("size"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest", F.lit(None).cast("boolean").alias("carried"))
    return Manifest(parts.select("tree", "part", "size"), levels, grown(subroots, n_parts))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    edited = F.when(hit, F.unhex(leaf([*fields[:-1], lowered(F.col("text"))])))  # null where tampering changes nothing
    leaves = docs.select(F.col("lang").alias("part"), F.col("doc_id").alias("place"), F.unhex(leaf(fields)).alias("digest"), F.struct("doc_id", edited.alias("edited")).alias("carried"))
    met = manifest(leaves).paths()
    back = folded(F.coalesce(_hex(F.col("carried.edited")), F.col("leaf")), F.col("path"))
    done = met.select("carried.doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


_PART = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0} end"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in FIELDS) + ")"
_EDITED = _LEAF.replace("{0}", "text").replace(_PART.format("text"), _PART.format(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"))
_BIT = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, b: {_BIT}), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """CTEs with the nodes (t, l, i, h, c) of trees over leaves, and their runs."""
    return f"""{name} as (select t, 0 as l, i, h, c from {leaves} union all
  select t, any_value(l) + 1, i // {FAN}, sha256(string_agg(h, '' order by i)), (c + {FAN - 1}) // {FAN} from {name} where c > 1 group by t, c, i // {FAN}),
{name}_runs as materialized (select t, l, i // {FAN} as p, list(h order by i) as hs from {name} where c > 1 group by t, l, i // {FAN})"""


def _walk(name: str, start: str, tree: str) -> str:
    """CTE that goes up from start (k, t, i, proof, fold), a level at a time."""
    own = f"(w.i % {FAN})"
    left, right = f"array_to_string(r.hs[1:{own}], '')", f"array_to_string(r.hs[{own} + 2:], '')"
    return f"""{name} as (select k, t, 0 as l, i, proof, fold from {start} union all
  select w.k, w.t, w.l + 1, w.i // {FAN}, w.proof || {left} || {right}, sha256({left} || w.fold || {right}) from {name} w join {tree}_runs r on r.t = w.t and r.l = w.l and r.p = w.i // {FAN})"""


ORACLE_SQL = f"""with recursive f as materialized (select doc_id, lang, {_LEAF} as leaf, case when {_CRC} % 3 = 0 then {_EDITED} end as edited from documents),
lv as materialized (select *, row_number() over () as k, dense_rank() over (order by lang nulls first) - 1 as t, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as c from f),
ll as (select t, i, leaf as h, c from lv),
{_tree("nd", "ll")},
sub as materialized (select t as i, h, 0 as t, count(*) over () as c from nd where c = 1),
{_tree("un", "sub")},
st as (select k, t, i, '' as proof, coalesce(edited, leaf) as fold from lv),
{_walk("w1", "st", "nd")},
e1 as materialized (select k, t, arg_max(proof, l) as proof, arg_max(fold, l) as fold from w1 group by k, t),
s2 as (select k, 0 as t, t as i, proof, fold from e1),
{_walk("w2", "s2", "un")},
e2 as (select k, arg_max(proof, l) as proof, arg_max(fold, l) as fold from w2 group by k),
rt as (select h as root from un where c = 1)
select doc_id, leaf, sub.h as subroot, root, sha256(e2.proof) as proof_sha256, e2.fold as folded_root, e2.fold = root as verified
from lv join e2 using (k) join sub on sub.i = lv.t, rt"""
