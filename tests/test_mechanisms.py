"""Pruning, summaries, state, residuals, sinks and stores: each against a plain computation, and what it saves."""

import gc
import math
import os
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import clean, dedup, graph, records, tfidf
from gleanery.operators.seen import Seen
from gleanery.plans import registered
from gleanery.sources import files, hits, html, sinks
from gleanery.streaming import stream

ITEM = "source_url string, item_idx int, text string, score double"


def near_copies(n, others, seed=1):
    """n texts of 100 words that differ in two frequent words each, and other texts."""
    r = random.Random(seed)
    base, often = [f"b{i}" for i in range(100)], [f"o{i}" for i in range(4)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(100), 2):
            words[at] = r.choice(often)
        rows.append((f"u{i:06}", 0, " ".join(words), r.random()))
    rows += [(f"v{i:06}", 0, " ".join(r.choices([f"w{k}" for k in range(900)], k=30)), r.random()) for i in range(others)]
    return rows


def greedy(rows, threshold=dedup.THRESHOLD):
    """The kept addresses, by the loop over all rows in the order of score."""
    n, counts = len(rows), [Counter(t.split()) for _, _, t, _ in rows]
    df, total = Counter(w for c in counts for w in c), sum(counts, Counter())
    top = set(sorted(total, key=lambda w: (-total[w], w))[:5_000])
    vectors = []
    for c in counts:
        v = {w: (1 + math.log(k)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in c.items() if w in top}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    kept = []
    for i in sorted(range(n), key=lambda i: (-rows[i][3], rows[i][0])):
        if all(sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()) < threshold for j in kept):
            kept.append(i)
    return {rows[i][0] for i in kept}


def test_near_copies_are_settled_by_leaders(spark):
    rows = near_copies(400, 30)
    items = spark.createDataFrame(rows, ITEM)
    assert {r.source_url for r in dedup.fuzzy_dedup(items).collect()} == greedy(rows)
    order = clean.exact_dedup(items).withColumn("id", F.struct("source_url", "item_idx"))
    vectors = dedup.settle(dedup.unit_vectors(order.select("id", "text")))
    rest, gone = dedup.settled_by_leaders(dedup.packed(vectors, order))
    assert gone.count() > 300 and rest.count() <= 100  # so that pairs are made of a few rows


def test_blocks_give_the_pairs_of_the_join(spark):
    rows = near_copies(40, 50, seed=2)
    docs = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "id long, text string")
    vectors = dedup.settle(dedup.unit_vectors(docs))
    pairs = lambda df: {(r.a, r.b, round(r.sim, 9)) for r in df.collect()}
    joined = pairs(dedup.pairs_of(vectors, crowd=10**9))
    assert joined and joined == pairs(dedup.in_blocks(vectors, dedup.THRESHOLD, block=37)) == pairs(dedup.pairs_of(vectors, crowd=20))


def test_blocks_meet_without_copies(spark):
    rows = near_copies(60, 90, seed=5)
    docs = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "id long, text string")
    packed = dedup.stored_vectors(docs)
    met = dedup.block_pairs(packed, block=20)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    pairs = lambda df: {(r.a, r.b, round(r.sim, 9)) for r in df.collect()}
    joined = pairs(dedup.pairs_of(dedup.settle(dedup.unit_vectors(docs)), crowd=10**9))
    assert joined and pairs(met) == joined == pairs(dedup.similar_pairs(docs))
    assert pairs(dedup.block_pairs(packed, 0.3, block=20)) == {p for p in pairs(dedup.block_pairs(packed, 1e-6)) if p[2] >= 0.3}
    assert dedup.similar_pairs(docs.limit(0)).isEmpty()


def test_vectors_are_made_where_the_texts_lie(spark):
    docs = spark.createDataFrame([(i, r[2]) for i, r in enumerate(near_copies(20, 30, seed=3))] + [(98, ""), (99, None)], "id long, text string")
    packed = dedup.packed_vectors(docs)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    whole = lambda df: {(r.id, tuple(r.terms), tuple(round(w, 9) for w in r.weights)) for r in df.collect()}
    assert whole(packed) == whole(dedup.pack(dedup.settle(dedup.unit_vectors(docs)))) and packed.count() == 50


def test_blocks_of_other_sizes_do_not_meet(spark, monkeypatch):
    """Rows of like size share blocks; blocks with far more or fewer terms are left out, and no pair is lost."""
    r = random.Random(8)
    rows = []
    for size in (6, 7, 12, 40, 120):
        for _ in range(25):
            base = r.sample(range(700), size)
            rows += [base, [*base[1:], r.randrange(700)]]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in x)) for i, x in enumerate(rows)], "id long, text string")
    packed = dedup.stored_vectors(docs)
    exact = {x.id: dict(zip(x.terms, x.weights)) for x in packed.collect()}
    cosine = lambda a, b: sum(w * exact[b].get(t, 0.0) for t, w in exact[a].items())
    for threshold in (0.5, dedup.THRESHOLD):
        expected = {(a, b) for a in exact for b in exact if a < b and cosine(a, b) >= threshold}
        assert len(expected) > 50 and {(x.a, x.b) for x in dedup.block_pairs(packed, threshold, block=20).collect()} == expected
    monkeypatch.setattr(dedup, "_like", lambda threshold: lambda batches: (pa.RecordBatch.from_arrays([b.column("block_a").cast("int64"), b.column("block_b").cast("int64"), pa.array([0.0] * b.num_rows)], ["a", "b", "sim"]) for b in batches))
    met = {(x.a, x.b) for x in dedup.block_pairs(packed, block=20).collect()}
    n = max(b for _, b in met) + 1
    assert n >= 10 and {(k, k) for k in range(n)} <= met and (0, n - 1) not in met and len(met) < 0.7 * n * (n + 1) / 2


def test_partitions_of_blocks_grow_slower_than_blocks():
    assert [dedup.block_parts(n) for n in (1, 12, 13, 64, 200, 256, 700)] == [1, 12, 12, 16, 50, 64, 64]


def test_bands_leave_out_rows_that_share_frequent_terms(spark):
    r = random.Random(6)
    rare = [f"r{i}" for i in range(900)]
    rows = [(f"often common usual {' '.join(r.sample(rare, 27))}",) for _ in range(300)]
    rows += [(" ".join([*base, f"odd{k}"]),) for base in (r.sample(rare, 40) for _ in range(30)) for k in range(2)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "id long, text string")
    packed = dedup.stored_vectors(docs)
    pairs = lambda df: {(x.a, x.b, round(x.sim, 9)) for x in df.collect()}
    exact, near = pairs(dedup.similar_pairs(docs)), pairs(dedup.approximate_pairs(docs))
    assert near <= exact and len(exact) >= 30 and len(near) >= 0.9 * len(exact)
    assert dedup.band_candidates(packed).count() < 0.002 * 360 * 359 / 2 + len(exact)


def test_parts_of_term_counts_grow_with_the_text(spark, monkeypatch):
    docs = spark.range(400).select("id", F.lit("some words of a text").alias("text"))
    for bound in (1_000, 200):
        monkeypatch.setattr(tfidf, "TEXT", bound)
        assert tfidf.term_counts(docs, ["id"]).rdd.getNumPartitions() == 8_000 // bound
    only = spark.createDataFrame([("words",), ("other",)], "term string")
    assert {tuple(x) for x in tfidf.term_counts(docs, ["id"], only=only).collect()} == {(i, "words", 1) for i in range(400)}


def test_topic_scores_write_the_items_and_not_their_terms(spark, monkeypatch):
    """Terms are many times the text; only items and the vocabulary are kept."""
    kept = []
    keep = lambda how: lambda df: kept.append(df.columns) or how(df)
    monkeypatch.setattr(tfidf, "settle", keep(tfidf.settle))
    monkeypatch.setattr(tfidf, "written", keep(tfidf.written))
    items = spark.createDataFrame([("a", 0, "old red roses"), ("b", 0, "blue sea"), ("c", 0, None)], "source_url string, item_idx int, text string")
    got = {r.source_url: r.cosine for r in tfidf.cosine_to_topic(items, "red roses").collect()}
    assert got["a"] > 0.5 and got["b"] == got["c"] == 0.0
    assert kept == [["source_url", "item_idx", "text"], ["term", "idf", "wq"]]


@pytest.mark.parametrize("bigrams, sublinear", [(False, False), (True, True)])
def test_topic_scores_need_no_shuffle_and_no_join(spark, bigrams, sublinear):
    """Each item is scored where it lies; the scores are those of a plain computation."""
    texts = ["old red roses and red roses", "blue sea", None, "", "a b", "roses red", "sea sea sea old"]
    items = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "source_url string, item_idx int, text string").repartition(3)
    scored = tfidf.cosine_to_topic(items, "red roses", bigrams=bigrams, sublinear=sublinear, max_features=6, stop=("and",))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    def counted(text):
        words = [w for w in (text or "").split() if len(w) > 1 and w != "and"]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])] * bigrams)

    docs = [counted(t) for t in [*texts, "red roses"]]
    total, df = sum(docs, Counter()), Counter(w for c in docs for w in c)
    top = sorted(total, key=lambda w: (-total[w], w))[:6]
    vectors = [{w: (1 + math.log(c[w]) if sublinear else c[w]) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w in top if c[w]} for c in docs]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = [sum(x * vectors[-1].get(w, 0.0) for w, x in v.items()) / (norm(v) * norm(vectors[-1])) if v else 0.0 for v in vectors[:-1]]
    assert [r.cosine for r in scored.orderBy("item_idx").collect()] == pytest.approx(expected)


def test_only_names_are_made_distinct(spark):
    rows = spark.createDataFrame([("u", 0, "see Rome and Rome, and see Rome"), ("u", 0, "Rome again")], "source_url string, item_idx int, text string")
    names = spark.createDataFrame([("Rome", "GPE"), ("Rome", "GPE")], "name string, kind string")
    found = graph.from_dictionary(rows, names)
    assert [tuple(r) for r in found.collect()] == [("u", 0, "Rome", "GPE")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join")[0] and "item_idx" not in "".join(x for x in plan.split("Join")[1].split("\n") if "Aggregate" in x)


def test_texts_are_decoded_a_few_at_a_time(spark):
    texts = spark.createDataFrame([("a &amp; b <i>c</i>",), ("\uff21\u00e9",), ("plain <b>x",), (None,)], "text string")
    cleaned = texts.select(T.clean_text(F.col("text")).alias("c"))
    assert [r.c for r in cleaned.collect()] == ["a & b c", "A\u00e9", "plain x", None]
    assert "BatchEvalPython" in cleaned._jdf.queryExecution().executedPlan().toString()


def test_topic_candidates_are_few_and_hold_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("source_url"), F.lit(0).alias("item_idx"), "text")
    topics = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("topic_id"), F.col("text").alias("topic"))
    ours, asked = tfidf.topic_vectors(docs, topics)
    near = tfidf.topic_candidates(ours, asked, 0.2).distinct()
    full = ours.join(asked.select("topic_id", "term", F.col("w").alias("wq")), "term").cache()
    true = full.groupBy("topic_id", *tfidf.KEY).agg(F.sum(F.col("w") * F.col("wq")).alias("c")).where("c >= 0.2")
    assert true.join(near, ["topic_id", *tfidf.KEY], "left_anti").isEmpty() and not true.isEmpty()
    assert near.count() < 0.05 * full.count()


def test_summary_bounds_every_total():
    r = random.Random(3)
    summary, true = tfidf.Summary(50), Counter()
    for _ in range(40):
        terms = [f"t{int(r.paretovariate(0.7))}" for _ in range(300)]
        summary.add(pa.array(terms), pa.array([1] * 300))
        true.update(terms)
    kept = {x["term"]: x for x in summary.kept.to_pylist()}
    assert len(kept) <= 100 < len(true) and summary.floor > 0
    assert all(x["low"] <= true[t] <= x["low"] + x["lost"] for t, x in kept.items())
    assert all(n <= summary.floor for t, n in true.items() if t not in kept)


@pytest.mark.parametrize("capacity", [5, 40, 10_000])
def test_frequent_vocabulary_equals_the_whole_one(spark, sf, capacity):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = tfidf.settle(tfidf.term_counts(docs, ["doc_id"]))
    rows = lambda df: {tuple(r) for r in df.select("term", "total", "df").collect()}
    assert rows(tfidf.frequent_vocabulary(counts, F.lit(200.0), 30, capacity)) == rows(tfidf.vocabulary(counts, F.lit(200.0), 30))
    assert tfidf.frequent_vocabulary(counts.limit(0), F.lit(0.0), 30).count() == 0


def test_funnel_runs_each_stage_once(spark):
    passed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    rows = spark.range(1_000)
    steps = [("odd", lambda d: d.mapInArrow(seen, "id long").where("id % 2 = 1")), ("small", lambda d: d.where("id < 100")), ("none", lambda d: d.where("id < 0"))]
    assert [tuple(r) for r in records.stage_funnel(rows, steps).collect()] == [("odd", 1_000, 500), ("small", 500, 50), ("none", 50, 0)]
    assert passed.value == 1_000


def test_streamed_digest_equals_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"j{r.randrange(3)}", i, r.choice(["load", "failed x", "retry", None, "ERROR"])) for i in range(300)]
    log = spark.createDataFrame([(j, f"2026-01-01 00:{i // 60:02}:{i % 60:02}", i, m) for j, i, m in rows], "job string, t string, seq long, message string").select("job", F.col("t").cast("timestamp").alias("ts"), "seq", "message")
    for k in range(6):
        log.where(f"seq >= {k * 50} and seq < {k * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        given = stream.digest_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        save = lambda d, _: d.write.mode("append").parquet(str(tmp_path / "out"))
        given.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = stream.latest_digests(spark.read.parquet(str(tmp_path / "out")))
    cols = ["job", "seq", "message", "kind", "errors"]
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(map(tuple, records.status_digest(log).select(*cols).collect()))


def test_a_digest_calls_the_state_store_twice_for_each_job():
    calls = Counter()

    class Store:
        held = None

        def __getattr__(self, name):
            def call(*values):
                calls[name] += 1
                if name in ("update", "put"):
                    self.held = values[0]
                return {"get": self.held, "exists": self.held is not None}.get(name)

            return call

    handle = type("Handle", (), {"getValueState": lambda *_: Store(), "getListState": lambda *_: Store()})()
    digest = stream._Digest(2, None)
    digest.init(handle)
    said = lambda *messages: [Row(ts=k, seq=k, message=m, kind="error" if m == "bad" else "info") for k, m in messages]
    first = list(digest.handleInputRows(("j",), iter(said((2, "bad"), (1, "a"), (3, "bad"))), None))
    second = list(digest.handleInputRows(("j",), iter(said((4, "bad"), (5, "b"))), None))
    assert [(r.given, r.seq, r.errors) for r in first] == [(1, 1, 1), (1, 2, 1)]
    assert [(r.given, r.seq, r.errors) for r in second] == [(2, 2, 1), (2, 5, 1)]
    assert calls == {"get": 2, "update": 2}


def test_log_parts_are_written_by_more_than_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "new_folder", lambda *_: str(tmp_path / "log"))
    spark.range(400).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 40 as user_id", "concat('m', id % 3) as event_type").write.parquet(str(tmp_path / "events.parquet"))
    rows = registered.status_log_stream(spark, str(tmp_path))
    log = spark.read.parquet(str(tmp_path / "events.parquet")).selectExpr("user_id as job", "ts", "event_id as seq", "event_type as message")
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, records.status_digest(log).select("job", "seq", "message", "kind", "errors").collect()))
    assert len(list(tmp_path.glob("log/in/*.parquet"))) > 4  # of four parts


def test_pushed_ranks_equal_the_power_iteration(spark):
    r = random.Random(5)
    names = [f"n{i}" for i in range(80)]
    pairs = {tuple(sorted(r.sample(names[:70], 2))): r.randint(1, 4) for _ in range(150)}
    nodes, edges = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame([(*p, w) for p, w in pairs.items()], "src string, dst string, weight long")
    near, tol = {n: {} for n in names}, 2e-5
    for (a, b), w in pairs.items():
        near[a][b] = near[b][a] = w
    x, n = dict.fromkeys(names, 1 / 80), 80
    for _ in range(200):
        loose = sum(x[u] for u in names if not near[u])
        y = dict.fromkeys(names, 0.85 * loose / n + 0.15 / n)
        for u in names:
            for v, w in near[u].items():
                y[v] += 0.85 * x[u] * w / sum(near[u].values())
        change, x = sum(abs(y[u] - x[u]) for u in names), y
        if change < n * tol:
            break
    got = {q.node: q.pagerank for q in graph.pagerank(nodes, edges, max_iter=200, tol=tol).collect()}
    assert max(abs(got[u] - x[u]) for u in names) < 1e-7
    assert {q.pagerank for q in graph.pagerank(nodes, edges, max_iter=2, tol=1e-12).collect()} == {0.0}


def test_fewer_nodes_push_round_by_round(spark):
    """A long path beside a dense part: the dense part settles first."""
    path = [(f"p{i:03}", f"p{i + 1:03}", 1) for i in range(60)]
    dense = [(f"d{i:02}", f"d{j:02}", 1) for i in range(25) for j in range(i + 1, 25)]
    edges = spark.createDataFrame(path + dense, "src string, dst string, weight long")
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = names.count()
    _, rounds = graph.pushed_ranks(names, n, graph._links(edges, 4), 4, 0.85, 60, 2e-7, 1e-5)
    pushing = [k for k, _ in rounds]
    assert max(pushing) > 15 and pushing[-1] < 0.5 * max(pushing) and rounds[-1][1] < n * 2e-7


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("d/f_%03d.txt", "id").alias("path"), F.concat(F.lit("text "), "id").alias("content"))
    files.write_files(spark, rows, f"file://{tmp_path}/export")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    made = files.file_digests(spark, f"file://{tmp_path}/export")
    assert made.rdd.getNumPartitions() <= 6 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in rows.select("path", F.sha1(F.col("content").cast("binary"))).collect()}


def test_numbered_rows_are_shuffled_once(spark):
    r = random.Random(9)
    rows = [(r.choice([None, *range(50)]), f"t{i}") for i in range(500)]
    made = sinks.numbered(spark.createDataFrame(rows, "k int, t string").repartition(7), ["k", "t"])
    assert "row_number" not in made._jdf.queryExecution().toString()
    expected = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(q.k, q.t) for q in made.orderBy("n").collect()] == expected and sorted(q.n for q in made.collect()) == list(range(500))


def test_vectors_keep_the_terms_of_topics_alone(spark, monkeypatch):
    kept = []
    for name in ("settle", "written"):
        monkeypatch.setattr(tfidf, name, lambda df, f=getattr(tfidf, name): kept.append(f(df)) or kept[-1])
    items = spark.createDataFrame([(f"u{i}", 0, f"apple pear word{i} other{i} apple") for i in range(20)], "source_url string, item_idx int, text string")
    topics = spark.createDataFrame([(1, "apple plum"), (2, "pear pear"), (3, "")], "topic_id int, topic string")
    ours, asked = tfidf.topic_vectors(items, topics)
    vectors = [d for d in kept if "w" in d.columns]
    assert len(vectors) == 2 and all({r.term for r in d.collect()} == {"apple", "pear"} for d in vectors)
    rare, often = math.log(21 / 2) + 1, 1.0
    norm = math.sqrt((often * (1 + math.log(2))) ** 2 + often**2 + 2 * rare**2)
    assert {(r.term, round(r.w, 9)) for r in ours.collect()} == {("apple", round(often * (1 + math.log(2)) / norm, 9)), ("pear", round(often / norm, 9))}
    assert {(r.topic_id, r.term, round(r.w, 9)) for r in asked.collect()} == {(1, "apple", 1.0), (2, "pear", 1.0)}


def test_hits_of_a_stored_page(spark):
    page = (
        "<div class='result results_links result__body'><h2><a class='result__a' href='https://a.org/?x=1&amp;y=2'> One <b>two</b></a></h2></div><div class='result__bodyx'><a class='result__a' href='no'>x</a></div>"
        "<div class='result__body'><a class='result__url' href='https://b.org'>b</a></div><div class='result__body'><a class='result__a'>Three</a><a class='result__url' href='https://c.org'>c</a></div>"
    )
    expected = [(0, "Onetwo", "https://a.org/?x=1&y=2"), (2, "Three", "https://c.org")]
    assert list(hits.hits(page)) == expected
    pages = spark.createDataFrame([("q", page), ("none", ""), ("null", None)], "query string, html string")
    assert [tuple(r) for r in hits.stored_hits(pages).collect()] == [("q", *x) for x in expected]


def test_entities_by_kind(spark):
    rows = spark.createDataFrame([("u", 0, "Anna Bell met Acme Corp, in Rome. Anna  Bell!"), ("u", 1, None), ("v", 0, "an ox in (Rome)")], "source_url string, item_idx int, text string")
    names = spark.createDataFrame([("Anna Bell", "PERSON"), ("Acme Corp", "ORG"), ("Rome", "GPE"), ("ox", "PRODUCT"), ("in", "ORG"), ("Rome", "LOC")], "name string, kind string")
    expected = {("u", 0, "Anna Bell", "PERSON"), ("u", 0, "Acme Corp", "ORG"), ("u", 0, "Rome", "GPE"), ("v", 0, "Rome", "GPE")}
    got = [tuple(r) for r in graph.from_dictionary(rows, names).collect()]
    assert set(got) == expected and len(got) == len(expected)
    model = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("kind")) for t, k in ((" Big\nEvent ", "EVENT"), ("Big Event", "EVENT"), ("no", "ORG"), ("1 January", "DATE"))])
    assert {tuple(r) for r in graph.of_kinds(rows, model).collect()} == {("u", 0, "Big Event", "EVENT"), ("v", 0, "Big Event", "EVENT")}


def test_alt_is_taken_as_it_stands():
    page = "<div>around<img src='a.png' alt='   '><img src='b.png' alt=' abcde '><img src='c.png' alt=''><img src='d.png'></div>"
    assert [c for _, c in html.images(html.parse(page), "https://x.org/")] == [" abcde ", "around", "around"]


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"documents/doc_{i:04}.txt", f"é {i}") for i in range(50)] + [("documents/none.txt", None)], "path string, content string").repartition(4)
    target = f"file://{tmp_path}/whole"
    files.write_files(spark, rows, target)
    back = {r.path: bytes(r.content).decode() for r in files.read_files(spark, target).collect()}
    assert back == {r.path: r.content for r in rows.collect() if r.content}  # a file source passes over empty files
    assert (tmp_path / "whole" / "documents" / "none.txt").read_bytes() == b""
    assert sorted(os.listdir(tmp_path / "whole")) == ["_SUCCESS", "documents"] and (tmp_path / "whole" / "_SUCCESS").read_text().startswith("51 files")
    bad = rows.unionByName(spark.createDataFrame([("../outside.txt", "x")], "path string, content string"))
    with pytest.raises(Exception, match="not a path inside"):
        files.write_files(spark, bad, f"file://{tmp_path}/half")
    assert [f for _, _, names in os.walk(tmp_path / "half") for f in names] == [] and not (tmp_path / "outside.txt").exists()


def test_export_with_annotations_beside(spark, tmp_path):
    df = spark.createDataFrame([("u", i, 0.5, f"text {i}", {"k": str(i)}) for i in range(3)], "source_url string, item_idx int, score double, t string, m map<string,string>")
    made = records.build_records(df, "text", "now", F.col("t"), F.col("m"))
    target = f"file://{tmp_path}/out"
    files.write_export(spark, made, sinks.document_files(made, ["source_url", "item_idx"]), target, "csv", ["source_url", "item_idx"])
    assert {bytes(r.content).decode() for r in files.read_files(spark, target).collect()} == {"text 0", "text 1", "text 2"}
    assert spark.read.option("header", True).csv(f"{target}/annotations").count() == 3


def test_csv_of_any_width(spark, tmp_path):
    width = 20_000
    rows = [("u", i, 0.5, 'a "b",\nc' if i == 3 else f"t{i}", {f"k{j:05}": f"{i}-{j}" for j in range(i, width, 40)}) for i in range(40)]
    df = spark.createDataFrame(rows, "source_url string, item_idx int, score double, t string, m map<string,string>").repartition(3)
    made = records.build_records(df, "text", "now", F.col("t"), F.col("m"))
    keys = sinks.key_columns(made, ["source_url", "item_idx"])
    assert len(keys) == width + 3 and [r.key for r in sinks.ranked_keys(made, ["source_url", "item_idx"]).orderBy("place").collect()] == keys
    import csv
    import glob

    sinks.write_csv(made, str(tmp_path / "wide"), ["source_url", "item_idx"])
    csv.field_size_limit(10**9)
    found = {}
    for path in glob.glob(str(tmp_path / "wide" / "part-*")):
        with open(path, newline="", encoding="utf-8") as lines:
            for row in csv.DictReader(lines):
                found[row["content"]] = {k.removeprefix("metadata."): v for k, v in row.items() if k.startswith("metadata.k") and v}
    assert found == {t: m for _, _, _, t, m in rows}


def test_variants_keep_types(spark):
    rows = spark.createDataFrame([(1, '{"k": 1, "z": "a"}'), (2, '{"k": 2.5}'), (3, "no json"), (4, None)], "id long, props string")
    made = sinks.typed_metadata(rows, F.col("props"))
    assert [r.t for r in made.orderBy("id").select(F.schema_of_variant("variant").alias("t")).collect()][:2] == ["OBJECT<k: BIGINT, z: STRING>", "OBJECT<k: DECIMAL(2,1)>"]
    assert "z: STRING" in sinks.metadata_schema(made).first().schema


def test_two_runs_equal_one(spark, tmp_path):
    text = lambda i: f"text number {i % 900}"
    items = spark.createDataFrame([(f"u{i:04}", 0, text(i) if i % 10 else None, 0.0) for i in range(2_000)], ITEM)
    store = Seen(spark, f"file://{tmp_path}/seen", blocks=2)  # few blocks: the filter gives false hits
    kept = []
    for part in ("source_url < 'u0700'", "source_url >= 'u0700' and source_url < 'u1000'", "source_url >= 'u1000'"):
        new = clean.exact_dedup(store.unseen(items.where(part)))
        kept += [r.source_url for r in new.collect()]
        store.remember(new)
    assert sorted(kept) == sorted(r.source_url for r in clean.exact_dedup(items).collect())
    fresh = spark.createDataFrame([(f"f{i}", 0, f"fresh {i}", 0.0) for i in range(500)], ITEM)
    wide = Seen(spark, f"file://{tmp_path}/wide")
    wide.remember(items)
    assert wide.may_hold(fresh).where("hit").count() <= 10 and wide.may_hold(items.where("text is not null")).where("not hit").isEmpty()


def test_rounds_of_ranks_read_their_ranks_once_and_deal_no_settled_frame_anew(spark, monkeypatch):
    """The plan of five rounds has an exchange for each of them, not one for each reader of each of them."""
    names = [f"n{i}" for i in range(40)]
    pairs = [(names[i], names[j], 1 + i % 3) for i in range(36) for j in range(i + 1, 36, 5)]
    nodes, edges = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs, "src string, dst string, weight long")
    made, plain = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    monkeypatch.setattr(graph, "LINKS", 50)
    got = {r.node: r.pagerank for r in graph.pagerank(nodes, edges, max_iter=5, tol=None).collect()}
    assert made[-1].count("Exchange hashpartitioning") == 5
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    near = {n: {} for n in names}
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    x = dict.fromkeys(names, 1 / 40)
    for _ in range(5):
        y = dict.fromkeys(names, 0.85 * sum(x[u] for u in names if not near[u]) / 40 + 0.15 / 40)
        for u in names:
            for v, w in near[u].items():
                y[v] += 0.85 * x[u] * w / sum(near[u].values())
        x = y
    assert max(abs(got[u] - x[u]) for u in names) < 1e-12


def test_only_texts_that_cleaning_can_change_go_to_python(spark):
    """Each character left out of the rule stays as it is under NFKC, alone and behind or before any other."""
    second = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    second |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.range(0, 0x110000, 1, 4).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    stays = {r.id for r in rows.where(~F.col("c").rlike(T.CHANGES)).select("id").collect()}
    safe = {c for c in codes if c != 38 and unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second}
    assert set(range(128)) - {38} <= stays <= safe
    words = spark.createDataFrame([("caf\u00e9 \u00fcber \u00df",), ("e\u0301",), ("\ufb01",), ("a &amp; b",)], "t string")
    assert [r[0] for r in words.select(F.col("t").rlike(T.CHANGES)).collect()] == [False, True, True, True]


def test_cleaning_is_worked_out_once_and_collapses_all_runs(spark):
    texts = ["a  b", " a b ", "a\u3000b", "a \u2003 b", "a\tb\x1c\x1dc", "\u00a0a\n\nb\x85", "", "a b c", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_idx int, text string")
    assert [r[0] for r in rows.select(T.collapse(F.col("text"))).collect()] == [None if t is None else " ".join(re.split(r"[\s\x1c-\x1f]+", t)).strip(" ") for t in texts]
    plan = clean.clean_paragraphs(rows, native=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1
    held = rows.select("item_idx", F.col("text").alias("caption"))
    assert {r.item_idx: r.caption for r in clean.clean_captions(held).collect()} == {4: "a b c", 7: "a b c"}
    tails = spark.createDataFrame([("a tower Stock Photos and more",), ("a lake HIGH-RES PICTURES",), ("a high-res tower",)], "caption string")
    assert sorted(r.caption for r in clean.clean_captions(tails).collect()) == ["a high-res tower", "a lake", "a tower"]


def test_pages_are_parsed_some_at_a_time_and_freed(spark):
    """No tree outlives its page, and rows are handed over before the next pages are read."""
    page = "<div>" + "<p>" + "a word " * 12 + "</p>"
    pages = [(f"u{i}", page) for i in range(html.PAGES * 2 + 1)]
    gc.collect()
    gc.disable()
    try:
        batch = pa.RecordBatch.from_pylist([{"url": u, "html": h} for u, h in pages])
        sizes = [b.num_rows for b in html.rows_of(html.EXTRACTORS["text"][0], [("text", pa.string())])(iter([batch]))]
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node)]
    finally:
        gc.enable()
    assert sizes == [html.PAGES, html.PAGES, 1]
    got = html.extract(spark.createDataFrame([*pages, ("none", None), (None, page)], "url string, html string")).collect()
    assert len(got) == len(pages) + 1 and {r.text for r in got} == {("a word " * 12).strip()} and sum(r.source_url is None for r in got) == 1


def test_words_are_found_once_for_words_and_pairs(spark):
    rows = spark.createDataFrame([("a", 0, "Red fox, red fox the den"), ("b", 0, "den"), ("c", 0, ""), ("d", 0, None)], ITEM.replace(", score double", ""))
    counts = tfidf.term_counts(rows, tfidf.KEY, bigrams=True)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {(r.source_url, r.term): r.tf for r in counts.collect()} == {("a", "red"): 2, ("a", "fox"): 2, ("a", "den"): 1, ("a", "red fox"): 2, ("a", "fox red"): 1, ("a", "fox den"): 1, ("b", "den"): 1}
