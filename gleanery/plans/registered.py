"""Queries of the curation operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls
from gleanery.operators import audio, captions, clean, dedup, graph, records, seen, tfidf
from gleanery.operators.lineage import new_folder, settle, written
from gleanery.plans.sql import TOPIC, oracle_sql  # noqa: F401  (part of this module's interface)
from gleanery.sources import files, hits, html, sinks, tables
from gleanery.streaming import stream

RUN_TS = "2026-01-01T00:00:00+00:00"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return tables.text_items(tables.read(spark, sf, "documents"))


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of documents as captions."""
    address = F.concat(F.lit("https://img.example.com/"), "source_url", F.lit("/"), "item_idx", F.lit(".png"))
    return _items(spark, sf).select("source_url", "item_idx", address.alias("image_url"), F.col("text").alias("caption"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as search hits, every third behind a redirect."""
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    pages = tables.read(spark, sf, "pages")
    return pages.select(F.col("page_id").alias("position"), F.concat(F.lit("Page "), "page_id").alias("title"), F.when(F.col("page_id") % 3 == 0, wrapped).otherwise(F.col("url")).alias("href"))


def _result_pages(spark, sf):
    """Stored result pages (query, html) of ten pages each: every third address behind a redirect, every fifth in the second link alone, every seventh without a title."""
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1"))
    link = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 3 == 0, wrapped).otherwise(F.col("url"))
    title = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("<h2><a class='result__a' href='"), link, F.lit("'> <b>Page</b> "), "page_id", F.lit(" </a></h2>")))
    body = F.concat(F.lit("<div class='links result__body'>"), title, F.lit("<a class='result__url' href='"), F.col("url"), F.lit("'>x</a></div>"))
    rows = tables.read(spark, sf, "pages").select(F.expr("page_id div 10").alias("query"), "page_id", body.alias("body"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "body"))), lambda x: x["body"]), "")  # ten rows
    return rows.groupBy("query").agg(F.concat(F.lit("<html><body>"), page, F.lit("</body></html>")).alias("html"))


def stored_hits(spark, sf):
    return hits.stored_hits(_result_pages(spark, sf))


def stored_sources(spark, sf):
    """The ranked sources of every stored result page."""
    return tables.rank_sources(hits.stored_hits(_result_pages(spark, sf)), 5, "query").select("query", "title", "url", "domain", "relevance_score")


def page_domains(spark, sf):
    return tables.latest_pages(tables.read(spark, sf, "pages")).select("url", urls.domain_compatible(F.col("url")).alias("domain_compatible"), urls.domain(F.col("url")).alias("domain"))


def rank_sources(spark, sf):
    return tables.rank_sources(_hits(spark, sf), 50)


def modality_query(spark, sf):
    topics = tables.read(spark, sf, "benchmark").select("item_id", F.explode(F.array(*[F.lit(m) for m in tables.SUFFIXES])).alias("modality"), F.col("text").alias("topic"))
    return topics.select("item_id", "modality", tables.modality_query(F.col("topic"), F.col("modality")).alias("query"))


def clean_paragraphs(spark, sf):
    return clean.clean_paragraphs(tables.whole_items(tables.read(spark, sf, "documents"))).select("source_url", F.sha1(F.col("text").cast("binary")).alias("sha"), F.length("text").alias("n"))


def boilerplate_flags(spark, sf):
    cleaned = _items(spark, sf).withColumn("c", T.clean_text(F.col("text")))
    return cleaned.select("source_url", "item_idx", T.is_navigation(F.col("c")).alias("navigation"), (F.length("c") < T.MIN_LENGTH).alias("short"))


def special_ratio(spark, sf):
    cleaned = _items(spark, sf).withColumn("c", T.clean_text(F.col("text")))
    return cleaned.select("source_url", "item_idx", F.round(T.special_share(F.col("c")), 6).alias("share"))


def exact_dedup(spark, sf):
    items = tables.whole_items(tables.read(spark, sf, "documents")).withColumn("score", F.lit(0.0))
    return clean.exact_dedup(items).select("source_url")


def tokens(spark, sf):
    return _items(spark, sf).select("source_url", "item_idx", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


def bigrams(spark, sf):
    grams = _items(spark, sf).select(T.tokens(F.col("text")).alias("tokens")).select(F.explode(T.with_bigrams(F.col("tokens"))).alias("term"))
    return grams.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")


def tfidf_idf(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    counts = tfidf.term_counts(docs, ["doc_id"])
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return df.select("term", "df", "total", F.round(F.log((F.lit(docs.count()) + 1.0) / (F.col("df") + 1.0)) + 1.0, 6).alias("idf"))


def vocab_topk(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    counts = settle(tfidf.term_counts(docs, ["doc_id"]))
    return tfidf.frequent_vocabulary(counts, F.lit(float(docs.count())), 5000).select("term", "total", "df")


def _scored(spark, sf):
    return tfidf.score_paragraphs(clean.clean_paragraphs(_items(spark, sf)), TOPIC)


def score_paragraphs(spark, sf):
    return _scored(spark, sf).select("source_url", "item_idx", "score")


def score_topics(spark, sf):
    topics = tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"), F.col("text").alias("topic"))
    return tfidf.score_topics(tables.whole_items(tables.read(spark, sf, "documents")), topics, 0.2)


def _unique_docs(spark, sf):
    return clean.exact_dedup(tables.whole_items(tables.read(spark, sf, "documents")).withColumn("score", F.lit(0.0)))


def similar_pairs(spark, sf):
    docs = _unique_docs(spark, sf).select(F.substring("source_url", 5, 20).cast("long").alias("id"), "text")
    return dedup.similar_pairs(docs).select("a", "b", F.round("sim", 4).alias("sim"))


def fuzzy_dedup(spark, sf):
    items = tables.whole_items(tables.read(spark, sf, "documents")).withColumn("score", F.lit(0.0))
    return dedup.fuzzy_dedup(items).select("source_url")


def clean_captions(spark, sf):
    return clean.clean_captions(_captions(spark, sf))


def caption_entities(spark, sf):
    return _captions(spark, sf).select("source_url", "item_idx", F.array_join(captions.entities(F.col("caption")), "|").alias("entities"))


def caption_tags(spark, sf):
    return _captions(spark, sf).select("source_url", "item_idx", F.array_join(captions.tags(F.col("caption")), "|").alias("tags"))


#: Categories over words that the synthetic captions hold.
CATEGORIES = {"first": ("thth", "thon", "that"), "second": ("ering", "anre", "with"), "third": ("and", "this", "are")}


def caption_category(spark, sf):
    return _captions(spark, sf).select("source_url", "item_idx", captions.category(captions.tags(F.col("caption")), CATEGORIES).alias("category"))


def _enriched(spark, sf):
    return captions.enrich_captions(clean.clean_captions(_captions(spark, sf)), TOPIC, CATEGORIES)


def enrich_captions(spark, sf):
    return _enriched(spark, sf).select("source_url", "item_idx", "score", "category", F.array_join("tags", "|").alias("tags"), F.array_join("entities", "|").alias("entities"))


def preprocess_manifest(spark, sf):
    pages = tables.read(spark, sf, "pages")
    configs = pages.select("page_id", F.array(F.lit(224), (F.col("page_id") % 5 + 100).cast("int")).alias("target_size"), F.lit(95).alias("quality"), F.lit("jpeg").alias("output_format"), (F.col("page_id") % 2 == 0).alias("grayscale"), (F.col("page_id") % 3 == 0).alias("edge_enhance"), (F.col("page_id") % 5 == 0).alias("equalize"))
    return captions.preprocess_manifest(configs).select("page_id", "format", F.array_join("steps", "; ").alias("steps"))


def _mentions(spark, sf):
    return graph.mentions(_items(spark, sf))


def dictionary_entities(spark, sf):
    """Customers, nations and segments that sentences name, by kind; regions are of a kind that makes no nodes."""
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    rows = tables.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("Then "), "c_name", F.lit(", of "), "n_name", F.lit(" ("), "r_name", F.lit("), asks for\n"), "c_mktsegment", F.lit("."))
    sentences = rows.select(F.concat(F.lit("c:"), "c_custkey").alias("source_url"), F.lit(0).alias("item_idx"), text.alias("text"))
    named = lambda df, c, kind: df.select(F.col(c).alias("name"), F.lit(kind).alias("kind"))
    names = named(rows, "c_name", "PERSON").unionByName(named(nation, "n_name", "GPE")).unionByName(named(region, "r_name", "LOC")).unionByName(named(rows, "c_mktsegment", "PRODUCT"))
    return graph.from_dictionary(sentences, names).groupBy("node", "kind").agg(F.count("*").alias("weight"))


def entity_nodes(spark, sf):
    return graph.node_weights(_mentions(spark, sf))


def entity_edges(spark, sf):
    return graph.edge_weights(_mentions(spark, sf))


def _graph(spark, sf):
    """(nodes, edges) for the ranks. Both are read several times, so that mentions and edges are written once."""
    found = written(_mentions(spark, sf))
    return graph.node_weights(found), written(graph.edge_weights(found))


def _ranks(spark, sf):
    nodes, edges = _graph(spark, sf)
    return edges, graph.pagerank(nodes, edges, max_iter=10, tol=None)


def pagerank(spark, sf):
    return _ranks(spark, sf)[1].select("node", F.round(F.col("pagerank") * 1e6, 2).alias("pagerank"))


def pagerank_converged(spark, sf):
    """Ranks when the change of a round is below a millionth for each node."""
    ranks = graph.pagerank(*_graph(spark, sf))
    return ranks.select("node", F.round(F.col("pagerank") * 1e6, 1).alias("pagerank"))


def _edges(spark, sf):
    return graph.edge_dataset(*_ranks(spark, sf))


def edge_dataset(spark, sf):
    return _edges(spark, sf)


def edge_view(spark, sf):
    return graph.edge_view(_edge_records(spark, sf))[0]


def _edge_records(spark, sf):
    """Edges in the order of their nodes' names, numbered without bringing all to one task."""
    edges = graph.edge_weights(_mentions(spark, sf)).select(F.col("src").alias("source_node"), F.col("dst").alias("target_node"))
    return sinks.numbered(edges, ["source_node", "target_node"], "seq")


def edge_view_links(spark, sf):
    return graph.edge_view(_edge_records(spark, sf))[1]


def concept_graph(spark, sf):
    named = _captions(spark, sf).select(F.concat_ws("/", "source_url", "item_idx").alias("id"), captions.tags(F.col("caption")).alias("tags"), captions.entities(F.col("caption")).alias("entities"))
    return graph.concept_links(named)


def source_star(spark, sf):
    return graph.source_star(tables.rank_sources(_hits(spark, sf), 50), "topic")


def source_star_links(spark, sf):
    return graph.star_links(tables.rank_sources(_hits(spark, sf), 50))


def selected_sources(spark, sf):
    flags = tables.read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 4 == 1).alias("selected"))
    return tables.selected(flags).select("page_id")


def select_all_ids(spark, sf):
    labels = tables.read(spark, sf, "labels")
    return records.edited(labels.where("quality = 1").select("doc_id").distinct(), tables.read(spark, sf, "documents").select("doc_id").distinct(), "all")


def select_no_ids(spark, sf):
    labels = tables.read(spark, sf, "labels")
    return records.edited(labels.where("quality = 1").select("doc_id").distinct(), labels.where("toxic = 1").select("doc_id").distinct(), "none")


def network_records(spark, sf):
    """Rows of supplier as structured items that pass without cleaning."""
    items = tables.read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("source_url"), F.lit(0).alias("item_idx"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("m"))
    made = records.build_records(records.passed_through(items), "network", RUN_TS, records.content_of("network"), F.col("m"))
    of = lambda k: F.element_at("metadata", k)
    return made.select("type", "content", "score", of("source_url").alias("source_url"), of("name").alias("name"), of("nation").alias("nation"), of("relevance_score").alias("relevance_score"))


def graph_records(spark, sf):
    """Edges as records, their content the two ends."""
    edges = graph.edge_weights(_mentions(spark, sf)).select(F.col("src").alias("source_node"), F.col("dst").alias("target_node"), F.lit("Synthesized Graph").alias("source_url"), F.lit(0).alias("item_idx"), F.col("weight").cast("double").alias("score"))
    return records.build_records(edges, "graph_gnn", RUN_TS, records.content_of("graph_gnn")).select("id", "type", "content", "score")


def _escaped(text):
    """A text as the text of an element."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _composed(rows, url, *parts):
    """Pages (url, html) composed from columns of a table."""
    return rows.select(url.alias("url"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("html"))


def composed_paragraphs(spark, sf):
    """Lines of documents as paragraphs of a page for each document; every seventh document lies in a footer."""
    docs = tables.read(spark, sf, "documents").where("text is not null")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "")
    holder = F.when(F.col("doc_id") % 7 == 0, "footer").otherwise("div")
    pages = _composed(docs, F.concat(F.lit("https://doc.example.com/"), "doc_id"), "<script>var p = '<p>';</script><", holder, ">", lines, "</", holder, ">")
    return html.extract(pages, "text").select("source_url", F.sha1(F.col("text").cast("binary")).alias("sha"), F.length("text").alias("n"))


def composed_images(spark, sf):
    """Parts as pictures: with an alternative text that is padded, blank, or of five letters, or in figures with the name and brand."""
    part, key = tables.read(spark, sf, "part"), F.col("p_partkey").cast("string")
    alone = lambda alt: F.concat(F.lit('<div>around<img src="/img/'), key, F.lit('.png" alt="'), alt, F.lit('"></div>'))
    figure = F.concat(F.lit("<figure><b> "), F.col("p_name"), F.lit("</b> <i>"), F.col("p_brand"), F.lit("</i><img src='"), key, F.lit(".jpg'></figure>"))
    kind = (F.col("p_partkey") % 7).cast("int")
    alt = F.element_at(F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")), *map(F.lit, ("   ", "      ", "abcde", " abcd ", ""))), F.least(kind, F.lit(5)) + 1)
    pages = _composed(part, F.concat(F.lit("https://shop.example.com/p/"), key, F.lit(".html")), F.when(kind == 6, figure).otherwise(alone(alt)))
    return html.extract(pages, "image_cnn")


def composed_audio(spark, sf):
    """Turns of conversations with a recording: named in lower case, behind a question mark, or in upper case (which is none)."""
    talks = tables.read(spark, sf, "conversations").where("text is not null")
    name = F.concat_ws("-", "conv_id", "turn")
    link = F.concat(F.lit("a/"), name, F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".wav?x=1", ".MP3")]), (F.col("turn") % 3 + 1).cast("int")))
    pages = _composed(talks, F.concat(F.lit("https://talk.example.com/"), name, F.lit("/index.html")), "<div>", _escaped(F.col("text")), "<audio src='", link, "'></audio></div>")
    return html.extract(pages, "audio")


def composed_headings(spark, sf):
    """Customers as headings over a list of their segment and nation; every fifth has a paragraph between."""
    rows = tables.read(spark, sf, "customer")
    between = F.when(F.col("c_custkey") % 5 == 0, "<p>none</p>").otherwise("")
    pages = _composed(rows, F.concat(F.lit("https://c.example.com/"), "c_custkey"), "<h3> ", F.col("c_name"), " </h3>", between, "<div></div><ul><li>", F.col("c_mktsegment"), "</li><li>nation ", F.col("c_nationkey").cast("string"), "</li></ul>")
    return html.extract(pages, "header_edges")


def composed_tables(spark, sf):
    """Suppliers as a table with a header for two of three columns; every fourth row is short."""
    rows = tables.read(spark, sf, "supplier")
    cells = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("<td> "), F.col("s_nationkey").cast("string"), F.lit("</td><td>x</td>")))
    pages = _composed(rows, F.concat(F.lit("https://s.example.com/"), "s_suppkey"), "<table><tr><th>name</th><th>nation</th><th></th></tr><tr><td>", F.col("s_name"), "</td>", cells, "</tr></table>")
    of = lambda k: F.coalesce(F.try_element_at("row", F.lit(k)), F.lit("-"))
    return html.extract(pages, "network").select("source_url", "item_idx", of("name").alias("name"), of("nation").alias("nation"), of("feature_2").alias("third"))


def approximate_recall(spark, sf):
    """How many of the similar pairs the approximate operator finds, and whether it finds any other."""
    docs = _unique_docs(spark, sf).select(F.substring("source_url", 5, 20).cast("long").alias("id"), "text")
    rows = dedup.stored_vectors(docs)
    exact, near = dedup.block_pairs(rows).select("a", "b"), dedup.hashed_pairs(rows).select("a", "b", F.lit(1).alias("found"))
    met = exact.withColumn("true", F.lit(1)).join(near, ["a", "b"], "full")
    return met.agg((F.sum(F.col("true") * F.col("found")) >= 0.9 * F.sum("true")).alias("recall_reached"), F.count_if(F.col("true").isNull()).alias("wrong"))


def audio_ext(spark, sf):
    kinds = ("process", "download", "generic_image", "generic_audio")
    made = tables.read(spark, sf, "pages").select("page_id", F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".WAV?x=1", ".ogg", ".png", "")]), (F.col("page_id") % 5 + 1).cast("int"))).alias("u"))
    return made.select("page_id", *[urls.extension(F.col("u"), k).alias(k) for k in kinds])


def _audio_items(spark, sf):
    talks = tables.read(spark, sf, "conversations")
    items = talks.select(F.concat(F.lit("conv:"), "conv_id").alias("source_url"), F.col("turn").cast("int").alias("item_idx"), F.concat(F.lit("https://a.example.com/"), "conv_id", F.lit(".mp3")).alias("audio_url"), F.col("text").alias("context_transcript"), F.when(F.col("turn") % 2 == 0, "speech").otherwise("music").alias("classification"), F.col("role").alias("stt_text"))
    return audio.merge_transcripts(items)


def audio_scores(spark, sf):
    return audio.audio_scores(_audio_items(spark, sf), TOPIC).select("source_url", "item_idx", "transcript", "ext", "score")


def build_records(spark, sf):
    kept = clean.exact_dedup(_scored(spark, sf))
    return records.build_records(kept, "text", RUN_TS, F.col("text")).select("id", "type", "content", "category", F.array_join("tags", "|").alias("tags"), F.element_at("metadata", "source_url").alias("source_url"), F.element_at("metadata", "timestamp").alias("ts"), "score")


def _event_records(spark, sf):
    """Events as records: their JSON properties are the item's own metadata."""
    items = tables.read(spark, sf, "events").select(F.concat(F.lit("user:"), "user_id").alias("source_url"), F.col("event_id").alias("item_idx"), F.round("value", 2).alias("score"), F.from_json("props", "map<string,string>").alias("m"), F.col("event_type").alias("kind"))
    return records.build_records(items, "network", RUN_TS, F.lit(""), F.coalesce("m", F.create_map().cast("map<string,string>")))


def metadata_keys(spark, sf):
    """Keys with their place in the order of first occurrence."""
    return sinks.ranked_keys(_event_records(spark, sf), ["item_idx"])


def typed_metadata(spark, sf):
    """Properties of events as VARIANTs: a value by its type, and the schema that all have together."""
    made = sinks.typed_metadata(tables.read(spark, sf, "events"), F.col("props"))
    value = made.select("event_id", F.try_variant_get("variant", "$.k", "string").alias("k"), F.try_variant_get("variant", "$.k", "int").alias("number"))
    return value.crossJoin(F.broadcast(sinks.metadata_schema(made)))  # one row


def flat_csv(spark, sf):
    made = _event_records(spark, sf)
    flat = sinks.flat_rows(made, sinks.key_columns(made, ["item_idx"]))
    return flat.withColumn("metadata.relevance_score", F.col("`metadata.relevance_score`").cast("double"))


def select_by_id(spark, sf):
    docs = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "source")
    return records.select_ids(docs, tables.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id")))


def select_by_url(spark, sf):
    pages = tables.read(spark, sf, "pages").select("url", "page_id")
    return pages.join(tables.rank_sources(_hits(spark, sf), 20).select("url"), "url", "left_semi")


def id_set_ops(spark, sf):
    labels = tables.read(spark, sf, "labels")
    good, bad = labels.where("quality = 1").select("doc_id").distinct(), labels.where("toxic = 1").select("doc_id").distinct()
    return records.toggled(good, bad)


def preview_top50(spark, sf):
    kept = clean.exact_dedup(_scored(spark, sf))
    return records.preview(records.build_records(kept, "text", RUN_TS, F.col("text"))).select("content", "source", "percent")


def run_summary(spark, sf):
    kept = clean.exact_dedup(_scored(spark, sf))
    return records.run_summary(tables.rank_sources(_hits(spark, sf), 20), records.build_records(kept, "text", RUN_TS, F.col("text")), TOPIC, "text")


def stage_funnel(spark, sf):
    return records.stage_funnel(_items(spark, sf), [("clean", clean.clean_paragraphs), ("score", lambda x: tfidf.score_paragraphs(x, TOPIC)), ("exact", clean.exact_dedup)])


def status_log_digest(spark, sf):
    log = tables.read(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("message"))
    return records.status_digest(log).select("job", "seq", "message", "kind", "errors")


def status_log_stream(spark, sf):
    """The digest of status_log_digest, from a stream that replays the events in four parts by time."""
    log = tables.read(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("message"))
    cuts = log.agg(*[F.percentile_approx("ts", q) for q in (0.25, 0.5, 0.75)]).first()
    folder, low, files_of_part = new_folder(spark, "log"), None, spark.sparkContext.defaultParallelism
    for high in (*cuts, None):
        part = log.where(F.lit(True) if low is None else F.col("ts") > low).where(F.lit(True) if high is None else F.col("ts") <= high)
        part.repartition(files_of_part, "job").write.mode("append").parquet(f"{folder}/in")  # a job's rows of a part are in one file, so they come in order however files fall to batches
        low = high
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        given = stream.digest_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_of_part).parquet(f"{folder}/in"))
        spark.createDataFrame([], given.schema).write.parquet(f"{folder}/out")  # there may be no news at all
        collect = lambda rows, _: rows.write.mode("append").parquet(f"{folder}/out")
        given.writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)
    return stream.latest_digests(spark.read.parquet(f"{folder}/out")).select("job", "seq", "message", "kind", "errors")


def progress_scale(spark, sf):
    done = tables.read(spark, sf, "pages").select("page_id", records.progress(F.col("page_id") % 41, F.lit(40)).alias("shown"))
    return done


def selection_counts(spark, sf):
    flags = tables.read(spark, sf, "pages").select(F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 4 == 1).alias("selected"))
    return records.selection_counts(flags)


def document_files(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return sinks.document_files(docs, ["doc_id"]).select("path", F.sha1(F.col("content").cast("binary")).alias("sha"))


def document_files_written(spark, sf):
    """The files of document_files written one by one, and read back."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    target = new_folder(spark, "export")
    files.write_files(spark, sinks.document_files(docs, ["doc_id"]), target)
    return files.file_digests(spark, target)


def exports_reread(spark, sf):
    """Records and their annotations in each format, chosen ids and all, read back from what was written."""
    items = tables.read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("source_url"), F.lit(0).alias("item_idx"), F.create_map(F.lit("name"), F.col("s_name")).alias("m"), F.col("s_name").alias("text"))
    made = settle(records.build_records(records.passed_through(items), "text", RUN_TS, F.col("text"), F.col("m")))
    out = None
    for fmt in tables.FORMATS:
        for chosen in (False, True):
            rows = records.select_ids(made, made.where(F.col("metadata.name").endswith("1")).select("id")) if chosen else made
            path = sinks.write_records(rows, new_folder(spark, "records"), fmt, ["source_url"], chosen)
            back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if fmt == "csv" else spark.read.json(path)
            name = F.col("`metadata.name`") if fmt == "csv" else F.col("metadata.name")
            part = back.select(F.lit(fmt).alias("format"), F.lit(path.endswith("_selected")).alias("selected"), name.alias("name"), "type", "content")
            out = part if out is None else out.unionByName(part)
    return out


def incremental_dedup(spark, sf):
    """Exact copies removed in two runs, the second against what the first has remembered."""
    items = tables.whole_items(tables.read(spark, sf, "documents")).withColumn("score", F.lit(0.0))
    late = F.substring("source_url", 5, 20).cast("long") % 2 == 1
    store = seen.Seen(spark, new_folder(spark, "seen"))
    first = settle(clean.exact_dedup(items.where(~late)))
    store.remember(first)
    second = store.unseen(clean.exact_dedup(items.where(late)))
    return first.select("source_url").unionByName(second.select("source_url"))


def media_manifest(spark, sf):
    pages = tables.read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 7 != 0, F.create_map(F.lit("image_url"), F.concat("url", F.lit(".webp")))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    return sinks.media_manifest(pages, ["page_id"], "image_cnn")


def media_manifest_audio(spark, sf):
    return _recordings(spark, sf, "audio")


def media_manifest_spectrograms(spark, sf):
    return _recordings(spark, sf, "spectrogram")


def media_manifest_files(spark, sf):
    return _recordings(spark, sf, "file_audio")


def _recordings(spark, sf, modality):
    """Pages as recordings: the address is a column for even pages, metadata for the others but every seventh."""
    ends = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".WAV", ".ogg")]), (F.col("page_id") % 3 + 1).cast("int")))
    kept = F.when(F.col("page_id") % 7 != 0, F.create_map(F.lit("audio_url"), ends)).otherwise(F.create_map().cast("map<string,string>"))
    pages = tables.read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, ends).alias("audio_url"), kept.alias("metadata"))
    return sinks.media_manifest(pages, ["page_id"], modality)


def _extracted(modality: str):
    def query(spark, sf):
        return html.extract(tables.latest_pages(tables.read(spark, sf, "pages")), modality)

    return query


def page_tables(spark, sf):
    return _extracted("network")(spark, sf).select("source_url", "item_idx", F.to_json("row").alias("row"))


def fetch_outcome(spark, sf):
    """Pages by how their fetch went: errors without a paragraph, every eleventh out of time, some never tried."""
    pages = tables.read(spark, sf, "pages")
    status = F.when(F.col("page_id") % 11 == 0, "timeout").when(F.col("page_id") % 13 == 0, F.lit(None)).when(F.col("html").contains("<p"), "ok").otherwise("error")
    return tables.fetch_outcome(pages.withColumn("status", status))


def prominent_edges(spark, sf):
    """Edges that two paragraphs or more make, with ranks of all edges."""
    return graph.edge_dataset(*_ranks(spark, sf), min_weight=2)


def preview_without_content(spark, sf):
    """Rows of suppliers without content, some without a score or a host: the record itself stands in."""
    items = tables.read(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://s.example.com/"), "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("supplier "), "s_suppkey")).alias("source_url"), F.col("s_suppkey").cast("int").alias("item_idx"), F.when(F.col("s_suppkey") % 4 == 0, 0.0).when(F.col("s_suppkey") % 4 == 1, F.lit(None)).otherwise(F.col("s_suppkey") % 100 / 100).alias("score"))
    made = records.build_records(items, "network", RUN_TS, records.content_of("network"))
    return records.preview(made).select("content", "source", "percent")


def queries() -> dict:
    """Every curation query by name."""
    named = (
        page_domains, rank_sources, modality_query, clean_paragraphs, boilerplate_flags, special_ratio, exact_dedup, tokens, bigrams, tfidf_idf, vocab_topk, score_paragraphs, score_topics, similar_pairs, fuzzy_dedup,
        clean_captions, caption_entities, caption_tags, caption_category, enrich_captions, preprocess_manifest, dictionary_entities, entity_nodes, entity_edges, pagerank, pagerank_converged, edge_dataset, edge_view, concept_graph, source_star, source_star_links, edge_view_links, selected_sources, select_all_ids, select_no_ids, network_records, graph_records, stored_hits, stored_sources, prominent_edges, preview_without_content, typed_metadata, document_files_written, exports_reread, incremental_dedup,
        composed_paragraphs, composed_images, composed_audio, composed_headings, composed_tables, approximate_recall, media_manifest_audio, media_manifest_spectrograms, media_manifest_files, audio_ext, audio_scores,
        build_records, metadata_keys, flat_csv, select_by_id, select_by_url, id_set_ops, preview_top50, run_summary, stage_funnel, status_log_digest, status_log_stream, progress_scale, selection_counts, document_files, media_manifest, page_tables, fetch_outcome,
    )
    return {f.__name__: f for f in named} | {"page_paragraphs": _extracted("text"), "page_images": _extracted("image_cnn"), "page_audio": _extracted("audio"), "header_edges": _extracted("header_edges")}
