"""Queries without SQL, over their whole table, against plain computations of all their fixed columns."""

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash

from gleanery.llm import imatch, licenses, pii
from tests.llm.test_spans import brute_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_personal_data(spark, sf, docs):
    for r in pii.op6_pii(spark, sf).collect():
        spans = brute_spans(docs[r.doc_id])
        n = Counter(k for *_, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE_KINDS)
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
        given = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in given} >= {(k, a, b) for a, b, k in spans}


def test_licences(spark, sf, docs):
    for r in licenses.op9_licenses(spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id]))
        places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def of_text(text, seed=42):
    return signed(xxhash.xxh64(text.encode(), seed=seed % (1 << 64)).intdigest())


def of_list(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return signed(h)


def test_fingerprints(spark, sf, docs):
    terms = lambda t: sorted({of_text(w) for w in WORD.findall(t.lower())})
    df = Counter(h for t in docs.values() for h in terms(t))
    n = len(docs)
    inside = {h for h, c in df.items() if max(2.0, imatch.LEAST_SHARE * n) <= c <= max(2.0, imatch.MOST_SHARE * n)}
    part = lambda h, bits: ((h % (1 << 64)) >> bits[0]) & ((1 << bits[1]) - 1)
    some = lambda x: of_list(x) if x else None

    def components(text):
        every = terms(text)
        kept = [h for h in every if h in inside]
        out = [of_list(kept) if kept else of_text("all", of_list(every))]
        out += [some([h for h in kept if part(h, imatch.LEFT_OUT_BITS) != c]) for c in range(imatch.CLASSES)]
        return out + [some([h for h in kept if part(h, bits) == c]) for bits in imatch.SCALES for c in range(imatch.CLASSES)]

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in pairs) / max(1, len(pairs))

    spelled = lambda c: ".".join("-" if x is None else format(x % (1 << 64), "x") for x in c)
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in imatch.op10_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, at in enumerate(order):
        text, following = docs[at], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = components(text), components(edited), components(following)
        r = got[at]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), spelled(a), spelled(b))
        assert (r.near_edited, r.near_next) == (like(a, b), like(a, c))


def test_a_search_for_segmentations_keeps_the_collector_away():
    """Segmenting leaves no cycles, so that the collector is off meanwhile and on again after, also when it fails."""
    import gc

    from gleanery.llm import pieces

    assert pieces.uncollected(lambda: [gc.isenabled()]) == [False] and gc.isenabled()
    with pytest.raises(ZeroDivisionError):
        pieces.uncollected(lambda: [1 / 0])
    assert gc.isenabled()
    found = pieces.Lattice(pieces.load_vocabulary())
    gc.collect()
    found.segment_all(["some words and ünusual ones " * 20, None, ""])
    assert gc.collect() == 0
