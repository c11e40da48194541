"""Queries over documents against brute-force versions on small tables, with the edge cases of every operator."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import imatch, jaccard, mixing, quality_classifier, quality_rules, substring
from gleanery.llm.common import among, labelled_sample

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    """Documents with copies, near copies, shared passages, repeats, nulls and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(60, 200))
        if i % 5 == 1:
            w[30:30] = passage
        if i % 7 == 2 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
        if i % 11 == 3 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
        rows.append((i, " ".join(w), "en", f"src{i % 4}" if i % 6 else None, 0))
    rows += [(100, None, "en", "src0", 0), (101, "", "en", "src0", 0), (102, "a b c", "en", "src1", 0), (103, "a b c", "en", "src1", 0), (104, "x " * 300, "en", "src2", 0), (105, "y" * 50_000, "en", "src2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in corpus()}


def test_quality_report_equals_sql(docs):
    frame = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("d", frame)
    cols = ["doc_id", *quality_rules.NAMES, "base_failed", "kept"]
    theirs = con.execute(f"select {', '.join(cols)} from ({quality_rules.REPORT_SQL.replace('{docs}', 'd')})").fetchall()
    ours = [tuple(r) for r in quality_rules.quality_report(docs).select(*cols).collect()]
    assert sorted(ours) == sorted(theirs)
    kept = {r.doc_id for r in quality_rules.quality_filter(docs).collect()}
    assert kept == {r[0] for r in ours if r[-1]}


def test_rule_order_is_rejections_per_cost():
    a, b, c = quality_rules.RULES[:3]
    assert quality_rules.order_rules([(a, 1.0, 0.1), (b, 0.5, 0.1), (c, 1.0, 0.0)]) == (b, a, c)


def test_substring_equals_brute_force(docs, texts):
    w = {i: WORDS.findall(t) for i, t in texts.items()}
    seen = Counter(tuple(x[k : k + 35]) for x in w.values() for k in range(len(x) - 34))
    for r in substring.without_repeats(docs).collect():
        x, gone = w[r.doc_id], set()
        for k in range(len(x) - 34):
            if seen[tuple(x[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        assert (r.n_words, r.n_removed, r.kept) == (len(x), len(gone), " ".join(y for k, y in enumerate(x) if k not in gone))


def test_frequent_keys_are_dealt_and_met(spark):
    rows = spark.createDataFrame([(7, i) for i in range(5_000)] + [(i, i) for i in range(100)] + [(None, 1)] * 3, "k long, v long")
    counts = rows.groupBy("k").count().where("count > 1").cache()
    assert Counter(r.k for r in among(rows, counts, ["k"]).collect()) == {7: 5_001}


def test_substring_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: WORDS.findall(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter(tuple(x[k : k + 35]) for x in docs.values() for k in range(len(x) - 34))
    got = {r.doc_id: tuple(r)[1:] for r in substring.op5_substring_dedup(spark, sf).collect()}
    for i, x in docs.items():
        gone = {k + j for k in range(len(x) - 34) if seen[tuple(x[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(w for k, w in enumerate(x) if k not in gone)
        assert got[i] == (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert len(got) == len(docs)


def test_substring_repeated_null_and_clashing_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long + " tail"), (None, None), (2, ""), (1, "other " * 3)]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("tag", "row", "h", "seeds", "found", "stretches", "whole", "stands", "anchor", "_salt")})
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(made).collect())
    assert got == Counter([(1, 50, 50, ""), (1, 50, 50, ""), (None, 51, 50, "tail"), (None, 0, 0, ""), (2, 0, 0, ""), (1, 3, 0, "other other other")])


def test_substring_rows_without_ids_whose_texts_share_a_hash(spark):
    """Two texts of one 32-bit hash, found by a birthday search: a long one that repeats a passage and a short one that doesn't."""
    passage = " ".join(f"p{i}" for i in range(40))
    long, short = F.concat(F.lit(passage + " "), F.col("id").cast("string")), F.concat(F.lit(" ".join(["s"] * 36) + " "), F.col("id").cast("string"))
    made = spark.range(200_000)
    pair = made.select(F.hash(long).alias("h"), long.alias("a")).join(made.select(F.hash(short).alias("h"), short.alias("b")), "h").first()
    rows = [(None, pair.a), (None, pair.b), (3, passage)]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 41, 40, pair.a.split()[-1]), (None, 37, 36, pair.b.split()[-1]), (3, 40, 40, "")}


def test_substring_empty_table(spark, docs):
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_every_window_hashes_by_content():
    h = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    got = substring.gram_hashes(h, 3, 0x9E3779B97F4A7C15)
    by = {}
    for i in range(298):
        by.setdefault(tuple(h[i : i + 3]), set()).add(got[i])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def brute_links(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in sets}
    best = {}
    for i in sorted(sets):
        if i not in best:
            reach, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - reach:
                    reach.add(j)
                    todo.append(j)
            best |= dict.fromkeys(reach, i)
    return {i: (best[i], len(near[i])) for i in sets}


def test_jaccard_equals_brute_force(docs, texts):
    expected = brute_links(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs.select("doc_id", "text")).collect()} == expected


def test_near_group_in_blocks(spark):
    rng = random.Random(2)
    base = [f"v{rng.randint(0, 999)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randint(0, 149)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    made = jaccard.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = jaccard.set_classes(made)
    found, sets = jaccard.linked_classes(made, classes)
    counts = jaccard.link_counts(found, sets, classes.groupBy("id").agg(F.max("n").alias("n")), block=16, elements=1_500)
    expected = brute_links(dict(rows))
    assert {r.doc_id: r.links for r in counts.join(classes, "id").collect()} == {i: n for i, (_, n) in expected.items() if n}


def test_labels_shorten_where_it_costs_least():
    need = -math.log(1 - jaccard.RECALL)
    gain = [-math.log1p(-(0.8**k)) for k in jaccard.LEVELS]
    assert jaccard.shortened([]) == [] and gain[-1] * jaccard.TREES >= need
    lonely = [(t, [1, 1, 1, 5]) for t in range(4)]
    assert jaccard.shortened(lonely) == []  # long prefixes suffice, the other trees are free
    rng = random.Random(3)
    for _ in range(200):
        nodes = [(t, sorted(rng.choices([1, 2, 3, 50, 900], k=4))) for t in range(rng.randint(1, jaccard.TREES))]
        at = dict(jaccard.shortened(nodes))
        levels = [at.get(t, max(k for k, n in enumerate(sizes) if n == 1) if 1 in sizes else 0) for t, sizes in nodes]
        assert sum(gain[k] for k in levels) + gain[-1] * (jaccard.TREES - len(nodes)) >= need
    crowded = [(t, [2, 900, 900, 900] if t < 5 else [2, 2, 2, 2]) for t in range(jaccard.TREES)]
    assert all(level == 0 for t, level in jaccard.shortened(crowded) if t < 5)


def test_forest_recall_and_links(spark):
    """5,000 documents in near-copy groups around the threshold: classes and links against brute force over an inverted index."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 5_000:
        base = [f"x{rng.randint(0, 4_000)}" for _ in range(rng.randint(40, 90))]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in (t.split(),)}
    index = {}
    for i, x in sets.items():
        for g in x:
            index.setdefault(g, []).append(i)
    near = {i: set() for i in sets}
    for i, x in sets.items():
        near[i] = {j for j, n in Counter(j for g in x for j in index[g]).items() if j != i and n >= 0.8 * (len(x) + len(sets[j]) - n)}
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    links = sum(map(len, near.values()))
    assert links > 3_000 and sum(got.values()) >= 0.999 * links and all(got[i] <= len(near[i]) for i in got)


def test_shared_and_null_ids_stay_apart(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    near = text["a"].replace("a30", "changed")
    rows = [(1, text["a"]), (1, text["b"]), (2, near), (3, text["b"]), (None, text["c"]), (None, text["c"]), (None, None), (None, ""), (4, None)]
    got = Counter(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == Counter([(1, 1, 1), (2, 1, 1), (1, 1, 1), (3, 1, 1), (None, None, 1), (None, None, 1), (None, None, 0), (None, None, 0), (4, 4, 0)])
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_whose_keys_collide_stay_apart(spark):
    """Different rows with one 64-bit key: the tag tells them apart, and each gets its own class and links."""
    words = {k: [f"{k}{i}" for i in range(60)] for k in "ab"}
    near = {k: " ".join(words[k][:30] + ["changed"] + words[k][31:]) for k in "ab"}
    rows = [(1, " ".join(words["a"])), (2, near["a"]), (3, " ".join(words["b"])), (4, near["b"])]
    made = jaccard.keyed(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("key", F.lit(7).cast("long"))
    classes = jaccard.set_classes(made)
    found, _ = jaccard.linked_classes(made, classes)
    assert {r.doc_id: r.class_id for r in jaccard.per_document(classes, found).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r["class"] for r in jaccard.components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_targets_are_filled_by_weight(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 1000), ("n", 1000)], "_s string, source_size long")
    got = {r["_s"]: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["sa"] == 30.0 and got["sb"] == pytest.approx(1980 * 2 / 3) and got["n"] == pytest.approx(1980 / 3)


def mixed(docs, block):
    placed, slots, _ = mixing.mix(docs, block=block)
    return mixing.taken_words(placed.drop("text", "row"), slots, block).select("doc_id", "size", "source_size", "target", "taken", "_s").collect()


def brute_targets(sizes):
    """Targets by source key: shares by weight, those above three times the size set to that, again until none is."""
    order = sorted(sizes, key=lambda s: (s == "n", s))
    weight, fixed, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def check_mix(rows, docs):
    frame = [(r.doc_id, len(WORDS.findall(r.text or "")), "n" if r.source is None else "s" + r.source) for r in docs.select("doc_id", "text", "source").collect()]
    assert Counter((r.doc_id, r["size"], r["_s"]) for r in rows) == Counter(frame)
    sizes = Counter()
    for _, n, s in frame:
        sizes[s] += n
    targets = brute_targets(dict(sizes))
    for s in sizes:
        mine = [r for r in rows if r["_s"] == s]
        assert mine[0].target == pytest.approx(targets[s]) and mine[0].source_size == sizes[s]
        assert targets[s] - 1 < sum(r.taken for r in mine) <= targets[s] + 1e-6
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("block", [8, 64])
def test_mix_meets_targets(docs, block):
    rows = mixed(docs, block)
    check_mix(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed(docs.repartition(5), block)))


def test_mixed_pieces_keep_columns_and_words(docs):
    made = mixing.mixed_pieces(docs, 16)
    assert made.columns == docs.columns
    got = Counter()
    for r in made.collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
    assert got == Counter({r.doc_id: r.taken for r in mixed(docs, 16) if r.taken})


def test_mix_with_clashing_columns(spark, docs):
    names = ("size", "start", "target", "block", "p", "_s", "row", "take", "times", "_i", "a b", "m")
    more = docs.limit(20).withColumns({c: F.lit(f"own {c}") for c in names[:-1]} | {"m": F.create_map(F.lit("k"), F.lit(1))})
    made = mixing.mixed_pieces(more, 16)
    assert made.columns == more.columns and all(r[c] == f"own {c}" for r in made.collect() for c in names[:-1])
    check_mix(mixed(more, 8), more)


def test_empty_mix(docs):
    assert mixing.mixed_pieces(docs.limit(0), 16).count() == 0


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in imatch.edited_fingerprints(docs, docs_per_bucket=7).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert rows[i].n_chars == len(t) and 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_followers_of_null_shared_and_wide_ids(spark):
    """A third of the ids null, a third equal, the rest wider than a double holds, so that quantiles are no row's id: every bucket stays small, followers are right."""
    wide = [(1 << 62) + 5_003 * i for i in range(100)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else wide[i // 3], f"text {i} " + "w" * (i % 17)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = docs.withColumn("th", F.xxhash64("text"))
    for buckets in (1, 2, 30, 200):
        starts = imatch.range_starts(keyed.select("doc_id", "th"), buckets)
        sizes = [r["count"] for r in imatch.in_order(keyed, starts).groupBy("_p").count().collect()]
        assert len(sizes) == len(starts) and sum(sizes) == 300 + len(starts)
        assert max(sizes) <= 301 if buckets == 1 else max(sizes) <= 4 * 300 // buckets + 12
    order = sorted(keyed.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.th))
    expected = []
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a.text) // 2
        expected.append(hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest())
    got = imatch.edited_fingerprints(docs, docs_per_bucket=10).select("edited_sha256").collect()
    assert sorted(r[0] for r in got) == sorted(expected)


def test_fingerprints_null_id_and_single_row(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, "c d e")], "doc_id long, text string")
    assert imatch.edited_fingerprints(rows).count() == 3
    assert imatch.edited_fingerprints(rows.where("doc_id = 1")).first().near_next == 1.0
    assert imatch.edited_fingerprints(rows.limit(0)).count() == 0


def test_tree_paths_become_rules():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 1.5)\n      Predict: 0.0\n     Else (feature 0 > 1.5)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    got = quality_classifier.tree_rules(text)
    assert got == {frozenset([(2, True, 0.5)]), frozenset([(2, True, 0.5), (0, True, 1.5)]), frozenset([(2, True, 0.5), (0, False, 1.5)]), frozenset([(2, False, 0.5)])}


def test_classifier_without_labels(docs):
    train = docs.select(F.lit(None).cast("int").alias("label"), quality_classifier.features(F.col("text")).alias("found"))
    scored = quality_classifier.with_score(docs, quality_classifier.fit(train), out="s")
    assert {round(r.s, 3) for r in scored.collect()} == {0.5}


def test_classifier_held_out(spark, sf):
    got = quality_classifier.op1_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    met = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got.count() == 200 and met >= 0.9


def test_sample_is_bounded(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", 10).count() == 10


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [frame]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    assert all(d.columns == frame.columns for d in seen[1:-1])
    kept = {r.doc_id for r in seen[1].collect()}
    expected = brute_links({r.doc_id: r.text or "" for r in seen[1].collect()})
    assert {r.doc_id for r in seen[2].collect()} == {i for i in kept if expected[i][0] == i}
    assert seen[5].where("not round_trip").isEmpty()


def test_stages_on_edge_cases(spark, docs):
    """Every stage alone on nulls, empties, repeats and clashing names, and on an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = docs.where("doc_id < 20 or doc_id >= 100").unionByName(docs.where("doc_id >= 100")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit(c) for c in ("_key", "key", "row", "class_id", "size", "_stats", "n_words", "a.b")})
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, "")
        rows = made.collect()
        assert (rows or name == "quality_rules") and stage(spark, odd.limit(0), "").count() == 0
        if name != "sentencepiece":
            assert made.columns == odd.columns and all(r["key"] == "key" and r["a.b"] == "a.b" and r["n_words"] == "n_words" for r in rows)
        if name in ("pii", "sentencepiece"):
            assert len(rows) == odd.count()


def test_native_operators_on_edge_cases(spark, docs):
    odd = docs.where("doc_id >= 100").unionByName(docs.where("doc_id >= 100")).withColumns({c: F.lit(c) for c in ("_stats", "_statistics", "n_words", "_lists", "c", "_k")})
    report = quality_rules.quality_report(odd)
    assert report.count() == odd.count() and report.where("_stats = '_stats'").count() == odd.count() and quality_rules.quality_report(odd.limit(0)).count() == 0
    rules = quality_classifier.RuleEnsemble(0.1, ((((0, True, 3.0),), 1.0),))
    scored = quality_classifier.with_score(odd, rules)
    assert scored.where("_statistics = '_statistics' and score between 0 and 1").count() == odd.count() and quality_classifier.with_score(odd.limit(0), rules).count() == 0
    assert imatch.edited_fingerprints(odd).count() == odd.count()


def test_measured_order_beats_the_worst(spark):
    """A cheap rule that rejects half of the rows goes before a dear one that rejects few, whatever the given order."""
    rows = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("word "), 3_000)).otherwise(F.lit("x")).alias("text"))
    dear = quality_rules.Rule("dear", lambda t, s: s("n_repeat_words") + s("n_dup_lines") < -1)
    cheap = quality_rules.Rule("cheap", lambda t, s: s("n_words") < 5)
    measured = quality_rules.measure(rows, (dear, cheap), sample_rows=1_000)
    assert quality_rules.order_rules(measured) == (cheap, dear)
    cost = {rule.name: (seconds, rate) for rule, seconds, rate in measured}
    assert cost["cheap"][1] == pytest.approx(0.5, abs=0.1) and cost["dear"][1] == 0


def brute_kept(rows):
    """How many rows of each (id, text) stay: one row of each class, with the smallest id, null last."""
    far = 1 << 62
    order = sorted(range(len(rows)), key=lambda k: (far if rows[k][0] is None else rows[k][0]))
    links = brute_links({place: rows[k][1] or "" for place, k in enumerate(order)})
    return Counter(far if rows[order[place]][0] is None else rows[order[place]][0] for place, (best, _) in links.items() if best == place)


def test_near_duplicates_by_row(spark):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = text["a"].replace("a30", "changed")
    rows = [(1, text["a"]), (1, text["a"]), (7, near), (7, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["c"] + " more"), (9, text["d"]), (None, text["d"]), (None, None), (None, None), (3, ""), (3, " \n")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 2}", 0) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter(1 << 62 if r.doc_id is None else r.doc_id for r in got) == brute_kept(rows) == {1: 1, 7: 1, 9: 1, 3: 2, 1 << 62: 3}
    assert [r.text for r in got if r.doc_id == 7] == [text["b"]]


def test_run_keeps_one_row_of_each_class(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("doc_id % 4 = 0")
    no_id = some.withColumn("doc_id", F.lit(None).cast("long"))
    shared = docs.where("doc_id % 4 = 1").withColumn("doc_id", F.lit(0).cast("long"))
    docs.unionByName(some).unionByName(no_id).unionByName(no_id).unionByName(shared).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: f"{tmp_path}/out")
    done = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    (out,) = (tmp_path / "out").glob("corpus-*")
    stage = {name: [(r.doc_id, r.text) for r in spark.read.parquet(f"{out}/{name}").collect()] for name in ("quality_rules", "jaccard_join")}
    assert Counter(1 << 62 if i is None else i for i, _ in stage["jaccard_join"]) == brute_kept(stage["quality_rules"])
    assert done and {r.doc_id for r in done} <= {i for i, _ in stage["jaccard_join"]}


def test_mix_keeps_repeated_empty_rows(spark):
    rows = [(1, "", "en", "s", 0)] * 3 + [(None, None, "en", "s", 0)] * 2 + [(2, "a b c", "en", "s", 0)] * 2
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check_mix(mixed(made, 8), made)


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 10, "b": 4_000, "c": 200, "d": 40, None: 63, "e": 65}
    rows = [(i, " ".join(f"{s}{k}" for k in range(n)), "en", s, 0) for i, (s, n) in enumerate(sizes.items())]
    made = spark.createDataFrame(rows, SCHEMA)
    check_mix(mixed(made, 64), made)
    assert {r.source for r in mixing.mixed_pieces(made, 512).collect()} == set(sizes)


def test_band_counts_terms_one_by_one(spark):
    rare = [f"rare{i}" for i in range(3_000)]
    texts = [" ".join(rare[i * 50 : i * 50 + 50] + [f"pair{i // 2}", "every"]) for i in range(60)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = spark.createDataFrame([(f"pair{i}",) for i in range(30)], "w string").select(F.xxhash64("w"))
    expected = {r[0] for r in pairs.collect()}
    assert {r.h for r in imatch.band(made).collect()} == expected
    lists = imatch.lexicon(made)
    assert sorted(h for x in lists.first()[0] for h in x) == sorted(expected)
    kept = imatch.with_components(made, "text", "c", lists).select(F.get("c", F.lit(0)).alias("c"), F.xxhash64(F.array(F.xxhash64(F.concat(F.lit("pair"), F.floor(F.col("doc_id") / 2).cast("string"))))).alias("e"))
    assert all(r.c == r.e for r in kept.collect())


def test_colliding_terms_stay_apart(spark):
    sizes = spark.range(3_000_000).select(F.concat(F.lit("t"), "id").alias("w")).withColumn("b", F.pmod(F.xxhash64("w"), F.lit(1 << 20)))
    a, b = sizes.where(F.col("b") == sizes.where("w = 't0'").first().b).limit(2).collect()
    made = spark.createDataFrame([(1, f"{a.w} x1"), (2, f"{b.w} x2"), (3, "x3")], "doc_id long, text string")
    assert imatch.band(made).count() == 0
    assert not imatch.lexicon(made).first()[0][0]
