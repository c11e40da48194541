"""Hard negatives against all scores."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives as hn


def brute(rows, anchor=lambda i: i is not None and i % 100 == 0, k=5):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256.0 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    by = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = Counter()
    for n, (i, v, label) in enumerate(kept):
        if not anchor(i):
            continue
        every = [(score(v, w), j, other) for m, (j, w, other) in enumerate(kept) if m != n]
        for ps, p, _ in sorted([e for e in every if e[2] == label], key=by)[:k]:
            inside = sorted([e for e in every if e[2] != label and 80 * ps <= 100 * e[0] <= 100 * ps], key=by)[:k]
            out.update((i, p, r, e[1], ps, e[0]) for r, e in enumerate(inside, 1))
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


def of(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("row", "v", "block", "group", "scores")}).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return Counter(tuple(r) for r in hn.op12_hard_negatives(spark, str(folder)).collect())


def test_query_equals_all_scores(spark, tmp_path):
    random.seed(5)
    near = [random.gauss(0, 1) for _ in range(6)]
    rows = [(i, [random.gauss(0, 1) for _ in range(6)], i % 4) for i in range(0, 700)]
    rows += [(1_000 + i, near, 2 if i % 2 else 3) for i in range(150)]  # many equal vectors: ties
    rows += [(100, near, 1), (100, near, 1), (None, near, 1), (None, near, 2), (2_000, None, 1), (2_100, near, None), (2_200, [1.0, None], 1), (2_300, [float("nan")] * 6, 1), (2_400, [float("inf")] * 6, 2)]
    rows += [(2_500, [0.5, 0.5], 1), (2_600, [], 2), (2_700, near + [9.0], 2), (2_800, [0.0] * 6, 3)]
    assert of(spark, rows, tmp_path) == brute(rows)


def test_few_rows_and_none(spark, tmp_path):
    few = [(100, [1.0], 1), (3, [1.0], 1), (4, [0.9], 2), (5, [-1.0], 1), (200, [2.0], 9)]
    assert of(spark, few, tmp_path / "few") == brute(few)
    assert not of(spark, [], tmp_path / "none")


def test_large_components_are_exact(spark, tmp_path):
    random.seed(6)
    rows = [(i, [random.uniform(-1, 1) * 2**21 for _ in range(4)], i % 3) for i in range(120)]
    assert of(spark, rows, tmp_path) == brute(rows)


def test_search_stops_early_and_keeps_ties():
    """Skewed dimensions let the threshold fall before the lists end; ties at the k-th score go by id."""
    random.seed(8)
    x = np.floor(np.array([[256 * 2.0 ** -(i // 3)] + [random.randint(0, 3) for _ in range(2)] for i in range(600)]))
    a = np.array([[100.0, 1.0, 1.0], [100.0, -1.0, 0.0]])
    lists, ids, depth = hn.Lists(x), np.arange(600)[::-1].copy(), np.zeros(2)
    got = hn.search(lists, ids, depth, a, np.ones((600, 2), bool), [[(-np.inf, np.inf)]] * 2)
    for row, (places,) in zip(a, got):
        scores = x @ row
        assert places.tolist() == sorted(range(600), key=lambda i: (-scores[i], ids[i]))[:5]
    assert (depth < 600).all()
