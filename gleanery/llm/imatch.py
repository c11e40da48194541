"""Document fingerprints by I-Match.

Terms whose inverse document frequency lies in a band are kept, sorted and hashed (64 bits): once for the whole lexicon,
once for each of LEFT_OUT lexicons that leave out a random part of it, and once for each of several small random
subsets of it. Subsets of one scale are drawn by bits of the term's hash that no other scale uses, so subsets of different
scales overlap at random. The lexicons that leave out an eighth survive small edits; the small subsets, of 1/8 to 1/2048
of the lexicon, tell how much of a short or a long text an edit has left. The likeness of two fingerprints is the share
of equal components among those that are not empty in either.

The lexicon is exact: document frequency is counted for each term (a 64-bit hash) over all documents, and only terms in
the band are kept. The least share bounds their number by the average number of distinct words of a document divided by
it, whatever the vocabulary. They lie in a table of short lists by bucket, in which a term is looked up by its full hash.

Only built-in functions are used.

Defined cases: null and empty texts have no terms, and equal fingerprints; a text without a term in the band is
fingerprinted by all its terms; documents follow each other by falling doc_id (null last), then by a hash of the text;
the last is followed by the first, a single one by itself; repeated rows follow each other; an empty table gives an
empty result; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import let, settle, table, words

#: Terms of the band in a list of the lexicon, about.
PER_LIST = 4
#: Lexicons that leave out one class of as many, and subsets used of each scale; (first bit, bits) of the hash for each.
LEFT_OUT = CLASSES = 8
LEFT_OUT_BITS, SCALES = (8, 3), ((11, 3), (14, 5), (19, 7), (26, 9), (35, 11))
LEAST_SHARE, MOST_SHARE = 0.0002, 0.05
#: Bounds of id ranges in a group; a row is placed by the groups' first bounds, then within its group.
GROUP = 128


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text, in order of the hash."""
    return F.sort_array(F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))))


def band(texts: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(h): the terms whose share of documents lies in the band."""
    n = texts.count()
    seen = texts.select(F.explode(term_hashes(F.col(text_col))).alias("h"))
    found = seen.groupBy("h").count().where((F.col("count") >= max(2.0, least * n)) & (F.col("count") <= max(2.0, most * n)))
    return settle(found.select("h"))


def lexicon(texts: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row with `_lists`: at place h mod its size, the terms h of the band; about PER_LIST in each list."""
    terms = band(texts, text_col, least, most)
    size = 1 << max(0, (terms.count() // PER_LIST).bit_length())
    lists = terms.groupBy(F.pmod("h", F.lit(size)).alias("at")).agg(F.collect_list("h").alias("list"))
    every = texts.sparkSession.range(size).select(F.col("id").alias("at")).join(lists, "at", "left")
    whole = F.collect_list(F.struct("at", F.coalesce("list", F.array().cast("array<bigint>")).alias("list")))
    return settle(every.agg(F.transform(F.array_sort(whole), lambda x: x["list"]).alias("_lists")))


def _class(h: Column, bits: tuple[int, int]) -> Column:
    """The class of a term by some bits of its hash."""
    return F.shiftrightunsigned(h, bits[0]).bitwiseAND(F.lit((1 << bits[1]) - 1))


def _components(terms: Column, lists: Column) -> Column:
    """The hash of the kept terms, then of each lexicon without a part, then of each subset; null where one is empty."""
    in_band = lambda h: F.array_contains(F.get(lists, F.pmod(h, F.size(lists)).cast("int")), h)
    digest = lambda x: F.when(F.size(x) > 0, F.xxhash64(x))
    numbers = F.sequence(F.lit(0), F.lit(CLASSES - 1)).cast("array<bigint>")

    def scale(kept: Column, bits: tuple[int, int]) -> Column:
        few = F.filter(kept, lambda h: _class(h, bits) < CLASSES)
        return let(few, lambda x: F.transform(numbers, lambda c: digest(F.filter(x, lambda h: _class(h, bits) == c))))

    def subsets(kept: Column) -> Column:
        whole = F.array(F.when(F.size(kept) > 0, F.xxhash64(kept)).otherwise(F.xxhash64(terms, F.lit("all"))))
        without = F.transform(numbers, lambda c: digest(F.filter(kept, lambda h: _class(h, LEFT_OUT_BITS) != c)))
        return F.concat(whole, without, *[scale(kept, bits) for bits in SCALES])

    return let(F.filter(terms, in_band), subsets)


def with_components(df: DataFrame, text_col: str, out: str, lists: DataFrame) -> DataFrame:
    """df plus the array of components of a text column. The lexicon's one row is a scalar, which the optimizer puts into the
    expression that reads it (once, through a struct), so that it is not copied into every row."""
    terms = term_hashes(F.coalesce(F.col(text_col), F.lit("")))
    made = let(F.struct(terms.alias("t"), F.col("_lists").alias("l")), lambda x: _components(x["t"], x["l"]))
    return df.withColumn("_lists", lists.scalar()).select(*[F.col(c) for c in df.columns], made.alias(out))


def fingerprint(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda c: F.coalesce(F.lower(F.hex(c)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that are not empty in either."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    return let(pairs, lambda z: F.size(F.filter(z, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))) / F.greatest(F.size(z), F.lit(1)))


def _place(df: DataFrame) -> DataFrame:
    """df plus `_o`, its place in the order: falling doc_id (null last), then rising hash `th`; a struct that compares so."""
    return df.withColumn("_o", F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("k"), F.col("th").alias("h")))


def _literals(places: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in places])


def _bucket(places: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The number of the last of the sorted places that is not after `_o` (-1: none), and that place."""
    groups = [places[i : i + GROUP] for i in range(0, len(places), GROUP)]
    heads, inside = _literals([g[0] for g in groups]), F.array(*[_literals(g) for g in groups])
    reached = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("_o"))) - 1
    found = let(reached(heads), lambda g: let(reached(F.get(inside, g)), lambda i: F.struct((g * GROUP + i).alias("p"), F.get(F.get(inside, g), i).alias("b"))))
    return found["p"], found["b"]


def range_starts(rows: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """Places of rows (doc_id, th) that begin about `buckets` ranges of as many rows, in order.

    Quantiles of the ids cut the ranges; an id with more rows than two ranges hold, at most buckets / 2 of them, is cut
    again by the hash, which spreads different texts evenly. Quantiles are doubles and may be no row's id, so each range
    is told by its first row; ids that a double does not tell apart, at most 1,024 neighbours beyond 2^53, share a range. Rows
    equal in id and text do too. At most 3 * buckets pairs of numbers come to the driver.
    """
    placed = _place(rows)
    n = placed.count()
    share = max(1, n // buckets)
    first = -(1 << 63)
    cuts = {(first, first)}
    if buckets > 1:
        ids = F.percentile_approx("_o.k", [i / buckets for i in range(1, buckets)], 10 * buckets)
        cuts |= {(k, first) for k in placed.agg(ids).first()[0] or ()}
        for k, count in placed.groupBy("_o.k").count().where(F.col("count") > 2 * share).collect():
            parts = -(-count // share)
            cuts |= {(k, first + -(-i * (1 << 64) // parts)) for i in range(parts)}
            if k < (1 << 63) - 1:
                cuts.add((k + 1, first))
    at, _ = _bucket(sorted(cuts))
    begun = placed.groupBy(at.alias("p")).agg(F.min("_o").alias("o")).collect()
    return sorted((r.o.k, r.o.h) for r in begun)


def in_order(rows: DataFrame, starts: list[tuple[int, int]]) -> DataFrame:
    """rows plus place `_o`, bucket `_p` and `_guest`, ready for windows over each bucket.

    Each bucket also gets, as guests at its end, the rows that begin the following bucket, and the last bucket those that
    begin the first, so that every row finds its follower in its own bucket.
    """
    at, begin = _bucket(starts)
    own = lambda p, guest: F.struct(p.alias("p"), F.lit(guest).alias("g"))
    placed = _place(rows).withColumns({"_p": at, "_b": begin})
    places = F.when(F.col("_b") == F.col("_o"), F.array(own(F.col("_p"), False), own(F.pmod(F.col("_p") - 1, F.lit(max(1, len(starts)))), True)))
    dealt = placed.withColumn("_to", F.explode(places.otherwise(F.array(own(F.col("_p"), False)))))
    return dealt.withColumns({"_p": F.col("_to.p"), "_guest": F.col("_to.g")}).drop("_to", "_b")


def edited_fingerprints(docs: DataFrame, docs_per_bucket: int = 512, most_buckets: int = 16_384) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose second half is the start of the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    lists = lexicon(texts)
    starts = range_starts(texts.select("doc_id", "th"), max(1, min(most_buckets, docs.count() // docs_per_bucket))) or [(-(1 << 63), -(1 << 63))]
    ordered = in_order(with_components(texts, "text", "c", lists), starts)
    down = Window.partitionBy("_p").orderBy("_guest", "_o.k", "_o.h")
    led = ordered.withColumns({"next_text": F.lead("text").over(down), "next_c": F.lead("c").over(down)}).where("not _guest")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = with_components(led.select("doc_id", size.cast("long").alias("n_chars"), "c", "next_c", text.alias("edited")), "edited", "e", lists)
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("c")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("c"), F.col("e")).alias("near_edited"), likeness(F.col("c"), F.col("next_c")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
