"""Mix sources to target weights.

Words are packed into blocks of fixed length, source by source. The output is a row of block slots cut into shards.
Each shard draws its source counts from the multinomial of the target shares: every slot draws a source by a hash. The
draws are then settled against the quota of each source, so that the totals meet the targets and not only come near on
average: slots beyond a source's quota are dealt to the sources that are short. A source's j-th slot takes the block
at j's place in a pseudorandom permutation of the source's block numbers, a new one for each pass, and blocks and slots
are joined by (source, block number).

Only built-in functions are used. Positions come from two-level sums (bucket totals, then within the bucket), so no
task holds a whole source, and slot ranks are found within shards. What is ordered in one task is one row per bucket of
BUCKET_DOCS documents of a source, or per shard of SHARD slots.

Targets: sources sorted by code point, null last, weigh as given, in turn. They share the words of all documents; a
target stops at `most` times the source's words, and the excess goes to the others by weight until none is above. Whole
passes over a source take all its words; of the last, partial pass the slots take blocks, and the last of them only so
many words of its block as the target still needs, so that a source misses its target by less than a word.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own; repeated
rows are documents of their own; an empty table gives an empty result; input columns may have any names, since a row is
carried as one struct; reruns over equal rows agree, except that of rows equal in id and text any may bear the other's
count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import let, settle, table, words

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD = 65_536
BUCKET_DOCS = 2_048
#: Multipliers of the index permutations; a prime that does not divide n gives a permutation of 0..n-1.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563)


#: Sources up to which the table of targets, a row each, is broadcast.
FEW_SOURCES = 100_000


def sized(docs: DataFrame, keep: Sequence[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, text, size, _s, _t): the kept columns as a struct, and a source key `_s` that is never null."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "doc_id", F.col(text_col).alias("text"), F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("_s"), F.xxhash64(text_col).alias("_t"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per source from (_s, source_size): its rank, weight, target, number of blocks and quota of slots.

    Sources are few (a row each); the level is the solution of sum(min(most * size, level * weight)) = all words.
    """
    by_name = Window.orderBy((F.col("_s") == "n").cast("int"), "_s")
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumns({"cap": cap, "total": F.sum("source_size").over(everything)}).withColumn("level", level)
    fits = F.col("level") <= F.col("cap") / F.col("weight")  # the first source in this order that stays below its cap sets the level
    settled = F.min_by("level", F.when(fits, F.col("_at"))).over(everything)
    filled = filled.withColumn("_at", F.row_number().over(full))
    out = filled.withColumn("level", F.coalesce(settled, F.lit(0.0))).withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    rest = F.floor(F.col("target") - passes * F.col("source_size")).cast("long")
    out = out.withColumns({"passes": passes, "rest": rest})
    # A block more than the rest needs, since the source's last block, which may be short, may be among them.
    quota = F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, F.least(F.ceil(F.col("rest") / block) + 1, F.col("n_blocks"))).otherwise(0).cast("long")
    return out.select("_s", "rank", "weight", "source_size", "target", "n_blocks", "passes", "rest", F.when(F.col("target") > 0, quota).otherwise(0).cast("long").alias("quota"))


def block_pieces(docs: DataFrame, n_docs: int, block: int = BLOCK) -> DataFrame:
    """docs of sized() with `start`, the place of their first word within their source.

    Documents lie in buckets by a hash of id and text; a bucket's start is the sum of the buckets before it.
    """
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    placed = docs.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_t"), F.lit(buckets)))
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_s", "_b").agg(F.sum("size").alias("w")).select("_s", "_b", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_s", "_b").orderBy("doc_id", "_t", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inside.join(starts, ["_s", "_b"]).withColumn("start", F.col("_from") + F.col("_in")).drop("_from", "_in", "_b")


def _ranges(rows: list[tuple[str, int, int]]) -> Column:
    """(source, length, extra) laid end to end as an array of (lo, hi, source, extra)."""
    out, lo = [], 0
    for name, n, extra in rows:
        out.append(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(lo + n).cast("long").alias("hi"), F.lit(name).alias("s"), F.lit(extra).cast("long").alias("extra")))
        lo += n
    return F.array(*out) if out else F.array().cast("array<struct<lo:long,hi:long,s:string,extra:long>>")


def _owner(x: Column, ranges: Column) -> Column:
    return let(x, lambda at: F.get(F.filter(ranges, lambda e: (e["lo"] <= at) & (at < e["hi"])), F.lit(0)))


def draw_slots(spark: SparkSession, quotas: list[tuple[str, int]], seed: int = 1, shard: int = SHARD) -> DataFrame:
    """(slot, shard, _s, j): each slot's source and its number within the source; the totals are the quotas.

    quotas: a (source, slots) pair for each source, in order.
    """
    n_slots = sum(n for _, n in quotas)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).cast("long").alias("shard"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("slot")), F.lit(max(n_slots, 1)))
    drawn = slots.withColumn("_s", _owner(draw, _ranges([(s, n, 0) for s, n in quotas]))["s"])
    counts = settle(drawn.groupBy("shard", "_s").count())
    got = {r[0]: r[1] for r in counts.groupBy("_s").agg(F.sum("count")).collect()}  # a row per source
    earlier = Window.partitionBy("_s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("shard", "_s", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_s").orderBy("slot")
    quota = F.element_at(F.map_from_arrays(F.array([F.lit(s) for s, _ in quotas]), F.array([F.lit(n) for _, n in quotas])), F.col("_s")) if quotas else F.lit(0)
    numbered = drawn.withColumn("_in", F.row_number().over(within) - 1).join(begun, ["shard", "_s"])
    numbered = numbered.withColumn("j", F.col("_from") + F.col("_in"))
    numbered = numbered.withColumn("over", F.col("j") >= quota)
    # The slots over a quota, numbered over all shards, go to the places that other sources are short of, laid end to end.
    over = numbered.where("over").groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # at most a shard's slots
    firsts = over.select("shard", F.size("slots").alias("n")).withColumn("_k", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    again = over.join(firsts.select("shard", "_k"), "shard").select("shard", "_k", F.posexplode("slots").alias("at", "slot"))
    holes = _ranges([(s, n - got.get(s, 0), got.get(s, 0)) for s, n in quotas if n > got.get(s, 0)])
    dealt = again.withColumn("k", F.col("_k") + F.col("at")).withColumn("h", _owner(F.col("k"), holes))
    dealt = dealt.select("slot", "shard", F.col("h.s").alias("_s"), (F.col("h.extra") + F.col("k") - F.col("h.lo")).alias("j"))
    return numbered.where("not over").select("slot", "shard", "_s", "j").unionByName(dealt)


def permuted(j: Column, n: Column, key: Column, seed: int = 1) -> Column:
    """The block number of a source's j-th slot: j's place in the permutation of its pass over n blocks."""
    epoch, k = F.floor(j / n).cast("long"), F.pmod(j, n)
    first = F.pmod(F.xxhash64(F.lit(seed), key, epoch, F.lit("p")), F.lit(len(PRIMES))).cast("int")
    primes = F.array([F.lit(p) for p in PRIMES])
    turn = lambda i: F.get(primes, F.pmod(first + i, F.lit(len(PRIMES))).cast("int"))
    multiplier = F.coalesce(*[F.when(n % turn(i) != 0, turn(i)) for i in range(len(PRIMES))], F.lit(1))
    shift = F.pmod(F.xxhash64(F.lit(seed), key, epoch, F.lit("c")), n)
    return F.pmod(F.pmod(multiplier, n) * k + shift, n)


def with_takes(slots: DataFrame, few: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """slots (with j, block and their source's targets) plus `take`, the words they take from the start of their block.

    All that the block holds, but for slots of the last pass that reach over the rest. Before the k-th slot of that pass lie k
    blocks, less what the source's last block lacks if it is among them; its place is found first, at most one row per source, which `few` broadcasts where sources are few, so
    that the slots of a source stay where they are.
    """
    last = F.col("block") == F.col("n_blocks") - 1
    lacks = F.col("n_blocks") * block - F.col("source_size")
    k = F.col("j") - F.col("passes") * F.col("n_blocks")
    where = slots.where(last & (k >= 0)).select(F.col("_s").alias("_p"), k.alias("place"))
    placed = slots.join(few(where), F.col("_s") == F.col("_p"), "left").drop("_p")
    holds = F.lit(block) - F.when(last, lacks).otherwise(0)
    before = k * block - F.when(F.col("place") < k, lacks).otherwise(0)
    return placed.withColumn("take", F.when(k < 0, holds).otherwise(F.greatest(F.least(holds, F.col("rest") - before), F.lit(0)))).where("take > 0")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 1, keep: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, targets) of a mix; documents and slots meet on (_s, block).

    documents: sized() with start, source_size and target; a document of size n at start covers the blocks start div block to
    (start + n - 1) div block of its source. slots: (slot, shard, _s, block, take).
    """
    counted = sized(docs, ["doc_id"] if keep is None else keep)
    sizes = settle(counted.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    n_docs, n_sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    targets = settle(source_targets(sizes.select("_s", "source_size"), weights, most, block))
    few = F.broadcast if n_sources <= FEW_SOURCES else lambda df: df
    quotas = [(r["_s"], r["quota"]) for r in targets.where("quota > 0").orderBy("rank").collect()]  # a row per source
    slots = draw_slots(docs.sparkSession, quotas, seed).join(few(targets.select("_s", "n_blocks", "source_size", "passes", "rest")), "_s")
    slots = with_takes(slots.withColumn("block", permuted(F.col("j"), F.col("n_blocks"), F.col("_s"), seed)), few, block)
    placed = block_pieces(counted, n_docs, block).join(few(targets.select("_s", "source_size", "target")), "_s")
    return placed, slots.select("slot", "shard", "_s", "block", "take"), targets


def covered_blocks(block: int = BLOCK) -> Column:
    """The numbers of the blocks that a document of sized() covers; none if it is empty."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    return F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block).cast("long"), last)).otherwise(F.array().cast("array<long>"))


def taken_words(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed with `taken`, the words of each document that the slots take, repeats counted.

    Rows with words differ in (_s, start); rows without words may be equal in every column and get a number of their own.
    """
    times = slots.groupBy("_s", "block", "take").agg(F.count("*").alias("times"))
    numbered = placed.withColumn("_n", F.when(F.col("size") == 0, F.monotonically_increasing_id()))
    keyed = numbered.withColumn("block", F.explode_outer(covered_blocks(block)))
    ends = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    overlap = F.greatest(ends - F.greatest(F.col("start"), F.col("block") * block), F.lit(0))
    met = keyed.join(times, ["_s", "block"], "left").withColumn("_w", F.coalesce(overlap * F.col("times"), F.lit(0)))
    kept = [c for c in placed.columns if c not in ("_s", "start")]
    return met.groupBy("_s", "start", "_n").agg(*[F.first(c).alias(c) for c in kept], F.sum("_w").cast("long").alias("taken")).drop("_n")


def mixed_pieces(docs: DataFrame, block: int, seed: int = 1) -> DataFrame:
    """The mix itself: one row per slot and document in its block, with docs' columns, the text cut to the words taken."""
    columns = docs.columns
    keep = [c for c in columns if c not in ("text", "n_chars")]
    placed, slots, _ = mix(docs, block=block, seed=seed, keep=keep)
    parts = lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def cut(found: Column) -> Column:
        at = lambda b: F.greatest(b * block - F.col("start"), F.lit(0))
        piece = lambda b: F.concat_ws("", F.slice(found, (at(b) + 1).cast("int"), (F.least((b + 1) * block - F.col("start"), F.col("size")) - at(b)).cast("int")))
        return F.transform(covered_blocks(block), lambda b: F.struct(b.alias("block"), piece(b).alias("piece")))

    pieces = placed.select("_s", "row", "start", F.explode(let(parts(F.col("text")), cut)).alias("p"))
    pieces = pieces.select("_s", "row", "p.block", "p.piece", F.greatest(F.col("start") - F.col("p.block") * block, F.lit(0)).alias("ahead"))
    times = slots.groupBy("_s", "block", "take").agg(F.count("*").alias("times"))
    taken = pieces.join(times, ["_s", "block"]).where("ahead < take").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    some = F.concat_ws("", F.slice(parts(F.col("piece")), F.lit(1), (F.col("take") - F.col("ahead")).cast("int")))
    text = F.when(F.col("take") < block, some).otherwise(F.col("piece"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return taken.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slots, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken_words(placed.drop("text", "row"), slots).select("doc_id", "size", "source_size", "target", "taken")
