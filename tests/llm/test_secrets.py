"""Secrets: base spans against the patterns, automata against plain likelihoods, the query against both."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import secret_scan as ss

WORDS = {"assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute(text):
    out = []
    for kind, pattern in WORDS.items():
        for m in re.finditer(pattern, text or ""):
            if (len(m[2]) if kind == "assign" else len(m[0])) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ss.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    random.seed(1)
    parts = ["token", "Token", "toKen", "API_KEY", "apikey", "passwd", "ſecret", "=", ": ", '"', "'", " ", "abcdef12", "x1+/_.=-", "AKIA", "A0B1C2D3E4F5G6H7", "0123456789abcdef", "é", "\n", "g", "."]
    for _ in range(4_000):
        text = "".join(random.choices(parts, k=random.randint(1, 14)))
        assert [s[:3] for s in ss.base_spans(text)] == brute(text), text


def test_candidates_touch_no_base_span():
    random.seed(2)
    parts = ["token=", "abcdef12", "0123456789abcdef", "AKIA", "Zz9-", ".", "/", " ", "é", "_"]
    for _ in range(2_000):
        text = "".join(random.choices(parts, k=random.randint(1, 14)))
        base = ss.base_spans(text)
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", text):
            if any(a < m.end() and m.start() < b for a, b, *_ in base):
                continue
            value = m[0].strip("./_-")
            if len(value) >= 16 and re.search("[0-9]", value):
                start = m.start() + len(m[0]) - len(m[0].lstrip("./_-"))
                expected.append((start, start + len(value), value))
        assert [(a, b, v) for a, b, _, v in ss.candidates(text, base)] == expected, text


def keys(n, seed):
    r = random.Random(seed)
    return ["sk_" + "".join(r.choices("0123456789abcdef", k=16)) + "-" + "".join(r.choices("ABCDEFGHIJ0123456789", k=6)) for _ in range(n)]


def others(n, seed):
    r = random.Random(seed)
    return [f"mail{r.randint(0, 99)}.{''.join(r.choices('abcdefghijklmnop', k=9))}.org" if r.random() < 0.5 else "".join(r.choices("0123456789", k=16)) for _ in range(n)]


def test_automaton_is_a_distribution_and_steps_alike():
    made = ss.inferred(keys(300, 3))
    assert np.allclose(np.exp(made.log).sum(axis=1) + np.exp(made.end), 1)
    assert 1 < len(made.end) < 200
    values = keys(40, 4) + others(5, 5) + ["a" * 5_000 + "1"]

    def plain(v):
        q, total = 0, 0.0
        for s in ss.symbols(v):
            total, q = total + made.log[q, s], made.next[q, s]
        return total + made.end[q]

    assert np.allclose(made.likelihoods(values), [plain(v) for v in values]) and len(made.likelihoods([])) == 0


def test_merging_keeps_all_counts():
    tree = ss.PrefixTree(keys(200, 6))
    red = tree.merged()
    assert sum(tree.ended[q] for q in red) == 200
    assert all(tree.passed[q] == tree.ended[q] + sum(n for _, n in tree.edges[q].values()) for q in red)


def test_formats_are_told_apart():
    grammar = ss.learned(keys(400, 7), others(400, 8))
    held, rest = grammar.ratios(keys(200, 9)) >= grammar.threshold, grammar.ratios(others(200, 10)) >= grammar.threshold
    assert held.mean() >= 0.98 and rest.mean() <= 0.02
    assert ss.learned(keys(ss.LEAST - 1, 1), others(50, 1)) is None


@pytest.fixture(scope="module")
def rows():
    given, free, plain = keys(60, 11), keys(10, 12), others(80, 13)
    texts = [f'é token = "{k}" end' for k in given] + [f"see {k}, here" for k in free] + [f"a {o} b" for o in plain]
    made = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, ""), (1, texts[1]), (1, texts[1]), (2_000, "word " * 60_000 + "AKIA" + "Q7" * 8 + " " + "f" * 200_000)]
    return made, set(range(60, 70))


def test_query_finds_formats_without_cues(spark, tmp_path, rows):
    made, free = rows
    spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("found", "kept", "spans", "FOUND_")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = ss.op13_secret_scan(spark, str(tmp_path)).collect()
    texts, said = Counter(), Counter()
    for i, t in made:
        base = brute(t)
        n = Counter(k for *_, k in base)
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        texts[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    for r in got:
        said[(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)] += 1
    assert said == texts
    assert {r.doc_id for r in got if r.n_format} == free
    text = dict(made)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] != "format"] == [[k, str(a), str(b)] for a, b, k in brute(text.get(r.doc_id))] if r.doc_id is not None else not spans
        assert all(text[r.doc_id][int(a) : int(b)].startswith("sk_") for k, a, b in spans if k == "format")


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ss.secret_spans(none, ["doc_id"]).count() == 0
    few = spark.createDataFrame([(1, "run 0123456789abcdefghij end")], "doc_id long, text string")
    assert [r.spans for r in ss.secret_spans(few, ["doc_id"]).collect()] == [[]]
