"""Operators on small cases worked out by hand, and properties."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls
from gleanery.operators import audio, captions, clean, dedup, graph, records, tfidf
from gleanery.sources import sinks, tables


def one(spark, column, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_clean_text(spark):
    got = one(spark, T.clean_text(F.col("t")), "a&amp;b <i>ﬁn</i>", "a \t\x1cb", "１２", "&lt;b&gt;x", "")
    assert got == ["a&b fin", "a b", "12", "x", ""]


def test_navigation_has_no_word_end(spark):
    assert one(spark, T.is_navigation(F.col("t")), "Homeland x", "2019–2020 x", "CONTACT us", "A plain one") == [True, True, True, False]


def test_redirects(spark):
    got = one(spark, urls.unwrap_redirect(F.col("t")), "//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa%2Bb+c&rut=1", "https://x.org/")
    assert got == ["https://x.org/a+b+c", "https://x.org/"]


def test_rank_floor_and_filter(spark):
    hits = spark.createDataFrame([(i, "t" if i else None, f"https://www.w{i}.org/") for i in range(60)], "position int, title string, href string")
    got = tables.rank_sources(hits, 59).orderBy(F.desc("relevance_score"), "url").collect()
    assert len(got) == 59 and got[0].relevance_score == 1.0 and min(r.relevance_score for r in got) == 0.1
    assert got[0].domain == "1.org"


def test_config_bounds():
    with pytest.raises(ValueError):
        tables.RunConfig("x")
    assert tables.RunConfig("topic").num_sources == 20


def test_greedy_keeps_chain_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    order = spark.createDataFrame([(1, 0.9, "u", 1), (2, 0.8, "u", 2), (3, 0.7, "u", 3)], "id int, score double, source_url string, item_idx int")
    assert [r.id for r in dedup.greedy_removed(pairs, order).collect()] == [2]


def test_caption_tags_and_category(spark):
    text = "Nike Air Max shoe on the red stock photo and a b"
    assert one(spark, captions.entities(F.col("t")), text) == [["Nike Air Max"]]
    assert one(spark, captions.tags(F.col("t")), text) == [["nike", "air", "max", "shoe", "red"]]
    assert one(spark, captions.category(captions.tags(F.col("t"))), text, "nothing here") == ["footwear", "general"]


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "src string, dst string, weight long")
    ranks = {r.node: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["b"] == max(ranks.values()) and ranks["d"] == min(ranks.values())


def test_audio_transcripts_and_default(spark):
    rows = [("u", 0, "a.WAV", "speech", "ctx", "heard"), ("u", 1, "b.ogg", "music", "ctx", "heard"), ("u", 2, None, "speech", "x", "y"), ("u", 3, "c", "speech", " ", "")]
    items = audio.merge_transcripts(spark.createDataFrame(rows, "source_url string, item_idx int, audio_url string, classification string, context_transcript string, stt_text string"))
    got = {r.audio_url: (r.transcript, r.ext) for r in items.collect()}
    assert got == {"a.WAV": ("ctx heard", "wav"), "b.ogg": ("ctx", "ogg"), "c": (" ", "mp3")}
    scores = {r.audio_url: r.score for r in audio.audio_scores(items, "heard music").collect()}
    assert scores["b.ogg"] == 0.5 and scores["a.WAV"] > 0.05


def test_item_keys_overwrite_base(spark):
    df = spark.createDataFrame([("u", 0, 0.5, {"timestamp": "x", "caption": "c", "k": "v"})], "source_url string, item_idx int, score double, m map<string,string>")
    row = records.build_records(df, "image_cnn", "now", F.lit("c"), F.col("m")).first()
    assert row.metadata == {"source_url": "u", "relevance_score": "0.5", "timestamp": "x", "k": "v"} and row.type == "image"


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("u", 0, 0.5, 'a"b', {"k": "v"}), ("u", 1, 0.4, "é", {"z": "1"})], "source_url string, item_idx int, score double, t string, m map<string,string>")
    made = records.build_records(df, "text", "now", F.col("t"), F.col("m"))
    path = sinks.write_records(made, str(tmp_path / "o"), "csv", ["source_url", "item_idx"], selected=True)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert path.endswith("_selected") and back.columns == ["id", "type", "content", "metadata.source_url", "metadata.timestamp", "metadata.relevance_score", "metadata.k", "metadata.z"]
    assert sorted(r["content"] for r in back.collect()) == ['a"b', "é"]
    assert spark.read.json(sinks.write_records(made, str(tmp_path / "j"), "zip", ["source_url"])).count() == 2


def test_select_ids(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert records.select_ids(df, None).count() == 2 and records.select_ids(df, "b,c").count() == 1


def test_stream(spark, tmp_path):
    from gleanery.streaming import stream

    text = "A long enough paragraph of plain words that says nothing at all, twice."
    rows = [("u", 0, text, "2026-01-01 00:00:00"), ("u", 1, text.upper(), "2026-01-01 00:00:01"), ("u", 2, "short", "2026-01-01 00:00:02")]
    spark.createDataFrame(rows, "source_url string, item_idx int, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("source_url string, item_idx int, text string, ts timestamp").parquet(str(tmp_path / "in"))
    made = stream.dedup_stream(stream.clean_stream(source), "ts")
    query = made.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 1


ITEM = "source_url string, item_idx int, text string, score double"


def test_no_vocabulary_gives_no_paragraph(spark):
    items = spark.createDataFrame([("u", 0, "the and of", 0.0), ("u", 1, "is was", 0.0)], ITEM).drop("score")
    assert tfidf.score_paragraphs(items, "the").count() == 0
    shown = items.select("source_url", "item_idx", F.col("text").alias("caption"))
    assert [r.score for r in captions.enrich_captions(shown, "of").collect()] == [1.0, 1.0]


def test_first_copy_wins(spark):
    rows = [("b", 0, "Same  Text", 0.5), ("a", 1, " same  text ", 0.5), ("c", 0, "same  text", 0.4), ("d", 0, "other", None), ("e", 0, "other", 0.1), ("f", 0, None, 0.0), ("g", 0, None, 0.0)]
    kept = clean.exact_dedup(spark.createDataFrame(rows, ITEM).repartition(3))
    assert kept.columns == ["source_url", "item_idx", "text", "score"] and {r.source_url for r in kept.collect()} == {"a", "e", "f"}


def test_latest_page(spark):
    pages = spark.createDataFrame([(1, "u", "old"), (2, "u", "new"), (None, "v", "x")], "page_id long, url string, html string")
    assert {(r.url, r.html) for r in tables.latest_pages(pages).collect()} == {("u", "new"), ("v", "x")}


def test_equal_vectors_are_removed_with_their_first(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    base = " ".join(words)
    rows = [(f"u{i}", 0, f"{base}{'!' * i}", 1.0 - i / 10) for i in range(5)] + [("v", 0, " ".join(words[:-1]) + " other", 2.0), ("w", 0, "nothing alike here", 0.0), ("x", 0, "the of", 0.0)]
    items = spark.createDataFrame(rows, ITEM)
    kept = {r.source_url for r in dedup.fuzzy_dedup(items).collect()}
    full = dedup.similar_pairs(items.select(F.struct("source_url", "item_idx").alias("id"), "text"))
    gone = {r.id.source_url for r in dedup.greedy_removed(full, items.select(F.struct("source_url", "item_idx").alias("id"), "score", "source_url", "item_idx")).collect()}
    assert kept == {r[0] for r in rows} - gone and {"v", "w", "x"} <= kept and len(kept & {f"u{i}" for i in range(5)}) <= 1


def test_annotations_lie_beside_the_items(spark, tmp_path):
    df = spark.createDataFrame([("u", 0, 0.5, "text", {"image_url": "https://x.org/a.PNG"}), ("u", 1, 0.4, "", {"z": "1"})], "source_url string, item_idx int, score double, t string, m map<string,string>")
    made = records.build_records(df, "image_cnn", "now", F.col("t"), F.col("m"))
    files = sinks.media_manifest(made, ["source_url", "item_idx"], "image_cnn")
    for fmt, read in (("csv", lambda p: spark.read.option("header", True).csv(p)), ("json", spark.read.json)):
        sinks.write_annotated(made, files, str(tmp_path / fmt), fmt, ["source_url", "item_idx"])
        assert [tuple(r) for r in spark.read.json(str(tmp_path / fmt / "items")).select("path", "url").collect()] == [("images/image_0000.png", "https://x.org/a.PNG")]
        assert read(str(tmp_path / fmt / "annotations")).count() == 2


def test_ranked_per_topic(spark):
    hits = spark.createDataFrame([(t, i, "x", f"https://{t}{i}.org/") for t in "ab" for i in range(4)], "topic string, position int, title string, href string")
    got = tables.rank_sources(hits, 3, "topic").collect()
    assert sorted((r.topic, r.relevance_score) for r in got) == [(t, s) for t in "ab" for s in (0.96, 0.98, 1.0)]
