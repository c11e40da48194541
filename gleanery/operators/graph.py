"""Entity co-occurrence graphs and PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import text as T
from gleanery.operators.captions import entities
from gleanery.operators.lineage import dealt, fixed_parts, settle

# The kinds of entities that make nodes.
KINDS = ("ORG", "PERSON", "PRODUCT", "GPE", "WORK_OF_ART", "EVENT")
#: Links in a partition of a round.
LINKS = 400_000


def mentions(paragraphs: DataFrame, extract=None) -> DataFrame:
    """(source_url, item_idx, node): distinct entities of each paragraph; `extract` maps the text column to an array.

    Items without text, such as the maps of other modalities, take no part.
    """
    found = (extract or (lambda c: entities(c, longer_than=2, stop=())))(F.col("text"))
    nodes = F.array_distinct(F.transform(found, lambda e: F.replace(e, F.lit("\n"), F.lit(" "))))
    return paragraphs.where(F.col("text").isNotNull()).select("source_url", "item_idx", F.explode(nodes).alias("node"))


def of_kinds(paragraphs: DataFrame, found: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(source_url, item_idx, node, kind): distinct entities of the kinds that count, from an array of (text, kind) that a model or a dictionary gives."""
    named = paragraphs.where(F.col("text").isNotNull()).select("source_url", "item_idx", F.explode(found).alias("e")).where(F.col("e.kind").isin(*kinds))
    node = F.replace(T.strip(F.col("e.text")), F.lit("\n"), F.lit(" "))
    return named.select("source_url", "item_idx", node.alias("node"), F.col("e.kind").alias("kind")).where(F.length("node") > 2).distinct()


def from_dictionary(paragraphs: DataFrame, names: DataFrame, longest: int = 4, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """As of_kinds(), by a dictionary (name, kind): every run of up to `longest` words that is a name, without punctuation at its ends.

    Runs are made in the row and met with the names by a join, so that the dictionary may be of any size; a name that a large
    share of all rows has is split by the join's own handling of skew. Only names are made distinct, not the many other runs.
    """
    words = F.filter(F.split("text", T.SPACES), lambda w: w != "")
    kept = paragraphs.where(F.col("text").isNotNull()).select("source_url", "item_idx", words.alias("w"))
    starts = kept.select("source_url", "item_idx", F.posexplode("w").alias("at", "first"), "w")
    runs = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.col("at") + n <= F.size("w"), F.array_join(F.slice("w", F.col("at") + 1, n), " ")))
    asked = starts.select("source_url", "item_idx", F.explode(runs).alias("run")).where("run is not null")
    bare = asked.select("source_url", "item_idx", F.regexp_replace("run", r"^[\p{P}&&[^#]]+|[\p{P}&&[^#]]+$", "").alias("node"))
    wanted = names.where(F.col("kind").isin(*kinds) & (F.length("name") > 2)).select(F.col("name").alias("node"), "kind").distinct()
    return bare.join(wanted, "node").select("source_url", "item_idx", "node", "kind").distinct()


def node_weights(found: DataFrame) -> DataFrame:
    return found.groupBy("node").agg(F.count("*").alias("weight"))


def edge_weights(found: DataFrame) -> DataFrame:
    """(src, dst, weight) with src < dst: paragraphs that name both."""
    grouped = found.groupBy("source_url", "item_idx").agg(F.sort_array(F.collect_set("node")).alias("n"))  # a paragraph's entities
    ahead = grouped.select("n", F.posexplode("n").alias("at", "src"))
    pairs = ahead.select("src", F.explode(F.slice("n", F.col("at") + 2, F.greatest(F.size("n") - F.col("at") - 1, F.lit(0)))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _links(edges: DataFrame, parts: int) -> DataFrame:
    """(src, dst, share), both ways, settled and dealt by src over `parts`, in its order: the share of src's rank that goes to dst."""
    ways = F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = F.sum("weight").over(Window.partitionBy("src"))
    return dealt(edges.select(F.inline(ways)).repartition(parts, "src").select("src", "dst", (F.col("weight") / degree).alias("share")), parts, "src")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, skip: float | None = None) -> DataFrame:
    """(node, pagerank) of an undirected weighted graph; without `tol` it takes exactly max_iter rounds.

    The mass of nodes without an edge is spread evenly: these all have one rank, a number that is worked out beside the
    rounds. So a round reads the ranks before it once and shuffles what the links pass on, and nothing else. If `tol` is not
    met in time, all ranks are 0.
    """
    names = settle(nodes.select("node").distinct())
    n = names.count()
    if not n:
        return names.withColumn("pagerank", F.lit(0.0))
    parts = max(names.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // LINKS))
    links = _links(edges, parts)
    if tol is not None:
        found, _ = pushed_ranks(names, n, links, parts, damping, max_iter, tol, tol * 1e-4 if skip is None else skip)
        return names.withColumn("pagerank", F.lit(0.0)) if found is None else found
    linked = _linked(names, links, parts)
    lonely = n - linked.count()
    rank = linked.withColumn("pagerank", F.lit(1.0 / n))
    with fixed_parts(names.sparkSession, parts):
        rank, alone = _rounds(rank, linked, links, n, lonely, damping, max_iter)
    return names.join(rank, "node", "left").select("node", F.coalesce("pagerank", F.lit(alone)).alias("pagerank"))


def _rounds(rank: DataFrame, linked: DataFrame, links: DataFrame, n: int, lonely: int, damping: float, max_iter: int) -> tuple[DataFrame, float]:
    """(settled ranks of the nodes with links, the rank of each other node) after max_iter rounds."""
    alone = 1.0 / n
    for turn in range(max_iter):
        given = damping * lonely * alone / n + (1 - damping) / n  # what every node gets in this round
        into = links.join(rank, links["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        met = linked.join(into, linked["node"] == into["dst"], "left")
        new = met.select("node", (F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.lit(given)).alias("pagerank"))
        rank = new if turn % 5 < 4 and turn + 1 < max_iter else settle(new)
        alone = given
    return rank, alone


def _linked(names: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """(node): the nodes with a link, settled and dealt as the links are."""
    linked = names.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return dealt(linked, parts, "node")


def pushed_ranks(names: DataFrame, n: int, links: DataFrame, parts: int, damping: float, max_iter: int, tol: float, skip: float) -> tuple[DataFrame | None, list[tuple[int, float]]]:
    """(ranks, rounds): rank by pushing changes; None if the change stays at n * tol or more. A round is (nodes that push, change).

    The rounds are those of the power iteration, told by differences: what changed a node's rank is passed on to its
    neighbours. A change of at most `skip` waits in its node until more has come together, so that ever fewer nodes push and
    ever less is shuffled. Nodes and links are dealt by the same keys once; a round shuffles what is pushed and nothing else.
    Nodes without a link have one rank, a number.
    """
    state = _linked(names, links, parts).withColumns({"pagerank": F.lit(1.0 / n), "waits": F.lit(1.0 / n)})
    lonely, alone, even = n - state.count(), 1.0 / n, None
    rounds: list[tuple[int, float]] = []
    for _ in range(max_iter):
        given = damping * lonely * alone / n + (1 - damping) / n  # what every node gets in this round
        pushing = F.abs(F.col("waits")) > (skip if even is not None else -1.0)
        active = state.where(pushing).select(F.col("node").alias("src"), F.col("waits").alias("push"))
        into = links.join(active, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("push") * F.col("share")).alias("got"))
        came = F.lit(damping) * F.coalesce("got", F.lit(0.0))
        delta = came + F.lit(given) - F.col("pagerank") if even is None else came + F.lit(given - even)
        left = F.lit(0.0) if even is None else F.when(pushing, F.lit(0.0)).otherwise(F.col("waits"))
        met = state.join(into, "node", "left").select("node", "pagerank", left.alias("left"), delta.alias("delta"))
        with fixed_parts(names.sparkSession, parts):
            state = settle(met.select("node", (F.col("pagerank") + F.col("delta")).alias("pagerank"), (F.col("left") + F.col("delta")).alias("waits"), "delta"))
        moved, will = state.agg(F.coalesce(F.sum(F.abs("delta")), F.lit(0.0)), F.count_if(F.abs("waits") > skip)).first()
        change = moved + lonely * abs(given - alone)
        rounds.append((will, change))
        alone, even = given, given
        state = state.drop("delta")
        if change < n * tol:
            ranked = names.join(state.select("node", "pagerank"), "node", "left")
            return ranked.select("node", F.coalesce("pagerank", F.lit(alone)).alias("pagerank")), rounds
    return None, rounds


def edge_dataset(edges: DataFrame, ranks: DataFrame, min_weight: int = 1) -> DataFrame:
    """Edge records with both ranks, and a score of a hundred times their mean."""
    a = ranks.select(F.col("node").alias("src"), F.col("pagerank").alias("pa"))
    b = ranks.select(F.col("node").alias("dst"), F.col("pagerank").alias("pb"))
    met = edges.where(F.col("weight") >= min_weight).join(a, "src", "left").join(b, "dst", "left").na.fill(0.0, ["pa", "pb"])
    return met.select(
        F.lit("Synthesized Graph").alias("source_url"), F.col("src").alias("source_node"), F.col("dst").alias("target_node"), F.lit("semantic_co_occurrence").alias("relationship_type"), F.col("weight").alias("edge_weight"),
        F.round("pa", 4).alias("source_pagerank"), F.round("pb", 4).alias("target_pagerank"), F.round((F.col("pa") + F.col("pb")) / 2 * 100, 3).alias("score"),
    )


def edge_view(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of edge records (seq, source_node, target_node): sources are group 1, targets 2, the last write wins."""
    named = records.where("source_node <> '' and target_node <> ''")
    ends = named.select(F.col("source_node").alias("id"), F.lit(1).alias("group"), (F.col("seq") * 2).alias("at")).unionByName(named.select(F.col("target_node").alias("id"), F.lit(2).alias("group"), (F.col("seq") * 2 + 1).alias("at")))
    nodes = ends.groupBy("id").agg(F.max_by("group", "at").alias("group"))
    return nodes, named.select(F.col("source_node").alias("source"), F.col("target_node").alias("target"), F.lit(1).alias("value"))


def concept_links(records: DataFrame) -> DataFrame:
    """(source, target, value): image to tag with value 1, image to entity with value 2."""
    to_tags = records.select(F.col("id").alias("source"), F.explode("tags").alias("target"), F.lit(1).alias("value"))
    return to_tags.unionByName(records.select(F.col("id").alias("source"), F.explode("entities").alias("target"), F.lit(2).alias("value")))


def source_star(sources: DataFrame, hub: str) -> DataFrame:
    """(id, name, val): one hub and a node for each source; star_links gives the links."""
    nodes = sources.select(F.col("url").alias("id"), F.col("domain").alias("name"), (F.col("relevance_score") * 10).alias("val"))
    return nodes.unionByName(sources.sparkSession.range(1).select(F.lit("hub").alias("id"), F.lit(hub).alias("name"), F.lit(20.0).alias("val")))


def star_links(sources: DataFrame) -> DataFrame:
    """(source, target): the hub's link to each source."""
    return sources.select(F.lit("hub").alias("source"), F.col("url").alias("target"))
