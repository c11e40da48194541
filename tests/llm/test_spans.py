"""Personal data, licences, toxicity and pieces: local parsers against brute force, and the Spark queries on edge cases."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import licenses, pieces, pii, toxicity

EDGE = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (3, " \n\t ", "x"), (None, "one two", None), (4, "é" * 9_000 + " end", "y")]
SCHEMA = "doc_id long, text string, source string"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    random.seed(3)
    automaton = pii._automaton()
    parts = ["@", ".", "a", "b-c", "+", "1", "22", "255", "4111 1111 1111 1111", "4111111111111111", " ", "-", "(", ")", "x@y.zz", "1.2.3.4", "+1 (743) 555-3824", "\n", "é"]
    for _ in range(4_000):
        text = "".join(random.choices(parts, k=random.randint(1, 14)))
        found = [s for s in pii.find_spans(text, automaton) if s[2] in pii.BASE_KINDS]
        assert found == brute_spans(text), text


def test_added_kinds_and_redaction():
    text = 'see https://x.org/a?b=1. token = "24be64439e3e49cf46b" iban DE89 3704 0044 0532 0130 00 end'
    spans = pii.find_spans(text, pii._automaton())
    assert [text[a:b] for a, b, k in spans if k in pii.EXTRA_KINDS] == ["https://x.org/a?b=1", "24be64439e3e49cf46b", "DE89 3704 0044 0532 0130 00"]
    assert pii.parse_account("iban DE89 3704 0044 0532 0130 00 end", 4) == (5, 32, "account")
    assert pii.redact("a x@y.zz b", [(2, 8, "email")]) == "a [EMAIL] b"


def test_pii_query_edge_cases(spark):
    rows = spark.createDataFrame(EDGE, SCHEMA).select(F.size(pii.pii_spans("text")).alias("n"), pii.redacted("text").alias("r"), "text").collect()
    assert [r.n for r in rows] == [0] * len(EDGE) and all(r.r == r.text for r in rows)


def test_phrases_by_brute_force():
    random.seed(4)
    phrases = licenses.BASE_PHRASES | licenses.MORE_PHRASES
    automaton = licenses._automaton(phrases)
    vocabulary = ["mit", "License", "cc", "by", "apache", "GNU", "general", "public", "é", "x", "(", ".", "\n"]
    for _ in range(2_000):
        text = " ".join(random.choices(vocabulary, k=random.randint(0, 15)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        n, n_base, first, last, base, *_ = licenses.scan(text, automaton, phrases)
        starts = [i for i, _ in places]
        assert (n, n_base, first, last) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert base == ",".join(sorted({label for _, label in places}))


def choices_of(postfix):
    """The choices that an expression leaves: each is the set of licences that hold together."""
    stack = []
    for token in postfix:
        if token not in licenses.PRECEDENCE:
            stack.append([frozenset([token])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif token == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:
            stack.append([frozenset(f"{x}-with-{y}" for x in a for y in b) for a in left for b in right])
    return stack[0]


def labels_of(line):
    return set(licenses.tag_value(line).named)


def test_expression_values_equal_their_choices():
    random.seed(11)

    def made(depth):
        if not depth or random.random() < 0.3:
            return random.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "LGPL-2.1", "BSD-3-Clause"])
        if random.random() < 0.2:
            return f"{made(0)} WITH {random.choice(['Classpath-exception-2.0', 'LLVM-exception'])}"
        return f"({made(depth - 1)} {random.choice(['AND', 'OR'])} {made(depth - 1)})"

    for _ in range(300):
        line = made(4)
        choices = choices_of(licenses.parse_expression(line))
        got = licenses.tag_value(line)
        free = lambda c: not any(x.startswith(licenses.COPYLEFT) for x in c)
        assert got.named == frozenset().union(*choices) and got.permissive == any(map(free, choices)), line
        assert got.required <= frozenset.intersection(*choices)
    assert licenses.tag_value("MIT OR GPL-2.0").required == frozenset() != licenses.tag_value("MIT AND GPL-2.0").required
    assert licenses.tag_value("(MIT AND X) OR MIT").required == {"mit"}


def test_long_license_text_is_linear():
    import time

    phrases = licenses.BASE_PHRASES | licenses.MORE_PHRASES
    began = time.process_time()
    got = licenses.scan("mit license " * 200_000, licenses._automaton(phrases), phrases)
    assert got[:4] == (400_000, 200_000, 0, 399_998) and time.process_time() - began < 20


def test_expressions():
    assert choices_of(licenses.parse_expression("MIT OR Apache-2.0 AND BSD-3-Clause")) == [frozenset({"mit"}), frozenset({"apache-2.0", "bsd-3-clause"})]
    assert labels_of("(GPL-2.0-only WITH Classpath-exception-2.0)") == {"gpl-2.0-only-with-classpath-exception-2.0"}
    assert labels_of("MIT OR") == labels_of("(MIT") == labels_of("") == {"unparsed"}


def test_notices_in_prose():
    phrases = licenses.BASE_PHRASES | licenses.MORE_PHRASES
    automaton = licenses._automaton(phrases)

    def got(text):
        *_, base, labels, score, required, permissive = licenses.scan(text, automaton, phrases)
        return base, labels, required, permissive, 0 < score < 1

    assert got("Licensed under the Apache License, Version 2.0.") == ("apache", "apache,apache-2.0", "apache-2.0", True, True)
    assert got("the GNU General Public License, version 3 or later") == ("gpl", "gpl,gpl-3.0+", "gpl-3.0+", False, True)
    assert got("under either the MIT or the Apache License") == ("apache", "apache,mit", "", True, True)
    assert got("GPL and MIT License") == ("mit", "gpl,mit", "gpl,mit", False, True)
    assert got("MIT License or the GNU General Public License v2") == ("gpl,mit", "gpl,gpl-2.0,mit", "", True, True)
    assert got("GNU General Public License version 2 with the Classpath exception") == ("gpl", "gpl,gpl-2.0-with-classpath-exception", "gpl-2.0-with-classpath-exception", False, True)
    assert got("Licensed under CC BY-NC 4.0.") == ("cc-by", "cc-by,cc-by-nc,cc-by-nc-4.0", "cc-by-nc-4.0", True, True)
    assert got("All rights reserved.") == ("", "all-rights-reserved", "", None, True)
    assert got("MIT License with or and MIT License with") == ("mit", "mit", "mit", True, True)
    assert got("SPDX-License-Identifier: MIT OR") == ("", "unparsed", "", None, True)


def test_long_chains_of_notices_are_linear():
    import time

    phrases = licenses.BASE_PHRASES | licenses.MORE_PHRASES
    began = time.process_time()
    for text in ("mit license or " * 100_000, "mit or " * 200_000 + "mit license", "the " * 300_000 + "mit license with the " * 50_000):
        assert licenses.scan(text, licenses._automaton(phrases), phrases)[5] == "mit"
    assert time.process_time() - began < 20


def test_license_query_edge_cases(spark):
    rows = spark.createDataFrame([*EDGE, (9, "// SPDX-License-Identifier: MIT", "z")], SCHEMA).select("doc_id", licenses.license_scan("text").alias("s")).collect()
    assert [r.s.score for r in rows] == [0.0] * len(EDGE) + [1.0] and rows[-1].s.labels == "mit" and rows[0].s.first_word is None


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "clown": 2.0, "achli*": 1.0})
    found = toxicity.automaton(lexicon)
    count = lambda t: toxicity.hits(toxicity.fold(t), lexicon, found)
    assert count("1d10t IDIOT$$$ іdіоt") == (3, 9.0)
    assert count("clown fish and clown") == (1, 2.0)
    assert count("achlicher 1000") == (1, 1.0)
    assert count(None) == count("") == (0, 0.0)


def test_folding_of_compatibility_forms_and_marks():
    assert toxicity.fold("ＩＤＩＯＴ i\u0332d\u0332iot") == ["idiot", "idiot"]


def test_exceptions_cover_by_brute_force():
    random.seed(12)
    lexicon = toxicity.Lexicon({"a": 1.0, "b": 2.0, "abcde*": 4.0}, ("a b", "b c a", "x abcdefg"))
    found = toxicity.automaton(lexicon)
    for _ in range(500):
        words = random.choices(["a", "b", "c", "x", "abcdefg"], k=random.randint(0, 12))
        safe = {(i, i + len(p.split())) for p in lexicon.exceptions for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
        kept = [w for i, w in enumerate(words) if w in ("a", "b", "abcdefg") and not any(s <= i < e for s, e in safe)]
        assert toxicity.hits(words, lexicon, found) == (len(kept), sum({"a": 1.0, "b": 2.0, "abcdefg": 4.0}[w] for w in kept))


def test_exceptions_are_learned(spark):
    random.seed(13)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(" ".join([*random.sample(words, 30), random.choice(words), *(["crab apple"] if y == 0 and i % 40 == 0 else ["crab"] * y)]), y) for i in range(240) for y in (i % 2,)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert "crab" in lexicon.weights and "crab apple" in lexicon.exceptions
    assert toxicity.hits(toxicity.fold("crab apple crab"), lexicon, toxicity.automaton(lexicon))[0] == 1


def test_toxicity_held_out(spark, sf):
    got = toxicity.op4_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    met = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert got.count() == 200 and met >= 0.9


def test_toxicity_edge_cases(spark):
    lexicon = toxicity.Lexicon({"vile": 3.0}, (), 1.0, -2.0)
    rows = spark.createDataFrame([*EDGE, (8, "vile " * 200_000, "z")], SCHEMA).select("doc_id", toxicity.toxic_hits("text", lexicon).alias("f")).collect()
    assert [r.f.hits for r in rows] == [0] * len(EDGE) + [200_000]


def test_toxicity_learns(spark):
    random.seed(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(" ".join(random.choices(words, k=40) + ["vile"] * (i % 2)), i % 2) for i in range(120)]
    rows = [(" ".join(random.sample(t.split(), len(t.split()))), y) for t, y in rows]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert "vile" in lexicon.weights
    scored = spark.createDataFrame(rows, "text string, label int").select("label", toxicity.toxicity_score(toxicity.toxic_hits("text", lexicon), lexicon).alias("s"))
    assert all((r.s >= 0.5) == bool(r.label) for r in scored.collect())
    assert toxicity.learn(spark.createDataFrame(rows[:1], "text string, label int")).weights == {}


@pytest.fixture(scope="module")
def small():
    made = [*(f"<0x{i:02X}>" for i in range(256)), "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", ","]
    return pieces.Vocabulary(tuple(made), tuple([0.0] * 256 + [-9.0, -5.0, -6.0, -7.0, -7.5, -4.0, -6.5, -8.0, -3.0]), 0, frozenset(range(256)))


def into_places(lattice, unit):
    into = [[] for _ in range(len(unit) + 1)]
    for end, edge in lattice.edges(unit):
        into[end + 1].append(edge)
    return into


def brute_paths(lattice, unit):
    """Every (cost, ids) of a unit, by cost, then by the ids from the end."""
    into = into_places(lattice, unit)

    def paths(end):
        return [(0.0, ())] if end == 0 else [(c - score, ids + back[::-1]) for length, score, _, back in into[end] for c, ids in paths(end - length)]

    return sorted(paths(len(unit)), key=lambda x: (x[0], x[1][::-1]))


def numbers(packed):
    return tuple(np.frombuffer(packed, np.int32).tolist())


@pytest.fixture(scope="module")
def tied(small):
    return pieces.Vocabulary(small.pieces, tuple([0.0] * 256 + [-2.0, -1.0, -1.0, -2.0, -2.0, -3.0, -4.0, -3.0, -1.0]), 0, small.special)


@pytest.mark.parametrize("n_best", [1, 2, 4, 7])
def test_n_best_equals_all_paths(small, tied, n_best):
    random.seed(6)
    for vocabulary in (small, tied):
        lattice = pieces.Lattice(vocabulary, n_best)
        for _ in range(150):
            unit = "".join(random.choices("▁abé,", k=random.randint(1, 9)))
            expected = brute_paths(lattice, unit)
            best, ids, least = lattice.best(unit)
            assert (best, numbers(ids)) == (-expected[0][0], expected[0][1]) and least == (expected[1][0] - expected[0][0] if len(expected) > 1 else np.inf)
            assert [(best - loss, numbers(x)) for loss, _, x in lattice.search(unit)] == [(-c, ids) for c, ids in expected[:n_best]]


@pytest.mark.parametrize("n_best", [1, 2, 4, 7])
def test_merged_units_equal_whole_search(small, tied, n_best):
    random.seed(7)
    for vocabulary in (small, tied):
        lattice = pieces.Lattice(vocabulary, n_best)
        for _ in range(200):
            text = "".join(random.choices("ab ,é", k=random.randint(1, 12)))
            expected = [(-c, ids) for c, ids in brute_paths(lattice, "▁" + text.replace(" ", "▁"))[:n_best]]
            lists, scores = lattice.segment(text)
            assert [(s, numbers(x)) for s, x in zip(scores, lists)] == expected
            assert all(lattice.decode(numbers(x)) == text for x in lists)


def test_remembered_units_take_bounded_memory():
    lattice = pieces.Lattice(pieces.load_vocabulary())
    random.seed(8)
    text = " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(4, 10))) for _ in range(20_000))
    expected = pieces.Lattice(lattice.vocabulary).segment(text[:5_000])
    tracemalloc.start()
    try:
        lattice.segment(text)
        held = tracemalloc.get_traced_memory()[0] / (len(lattice.known.newer) + len(lattice.known.older))
    finally:
        tracemalloc.stop()
    assert held * pieces.REMEMBERED < 160e6
    assert lattice.segment(text[:5_000]) == expected  # from the table


def test_long_tied_units():
    lattice = pieces.Lattice(pieces.load_vocabulary())
    for text in ("-" * 300, "-" * 20_000, "x" * 20_000, "ab" * 5_000):
        lists, scores = lattice.segment(text)
        assert len(lists) == len({*lists}) == 4 and scores == sorted(scores, reverse=True) and all(lattice.decode(numbers(x)) == text for x in lists)


def test_pieces_round_trip(spark):
    vocabulary = pieces.load_vocabulary()
    texts = [(None,), ("",), ("Hello  world\n",), ("é漢字\U0001f600 x",), (" a" * 3_000,), ("x" * 3_000,), ("x" * 3_000,)]
    rows = spark.createDataFrame(texts, "text string").select("text", pieces.encoded("text", vocabulary).alias("e")).select("text", "e.whole", pieces.decoded(F.get("e.ranked", F.lit(0)), vocabulary).alias("back")).collect()
    assert len(rows) == len(texts) and all(r.whole and r.back == (r.text or "") for r in rows)
    assert spark.createDataFrame([], "text string").select(pieces.encoded("text", vocabulary)).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(pieces.decoded("ids", vocabulary)).first()[0] is None


def test_pieces_query_equals_brute_force(spark, tmp_path):
    """The query's columns from the lattice alone, on texts short enough that every path of each unit can be listed."""
    import hashlib

    texts = ["Hello  world, again", "a▁b", "", None, "x-y", "x-y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lattice = pieces.Lattice(pieces.load_vocabulary())
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    for r in pieces.op3_sentencepiece(spark, str(tmp_path)).collect():
        ways = [(0.0, ())]
        for unit in lattice.cutter.findall("▁" + texts[r.doc_id].replace(" ", "▁")) if texts[r.doc_id] else []:
            each = brute_paths(lattice, unit)[:4]
            ways = sorted(((c + d, ids + more) for c, ids in ways for d, more in each), key=lambda x: (x[0], x[1][::-1]))[:4]
        assert list(r.ranked_sha256) == [sha(ids) for _, ids in ways] and r.ids_sha256 == r.ranked_sha256[0]
        assert (r.n_pieces, r.best_score, r.n_best, r.round_trip) == (len(ways[0][1]), -ways[0][0], len(ways), texts[r.doc_id] != "a▁b")


def test_cues_in_any_case():
    text = 'É K IBAN DE89 3704 0044 0532 0130 00; Password: hunter2hunter2 API_KEY=abcdEFGH1234 TOKEN = "24be64439e3e49cf" see HTTPS://X.org/A?b=1'
    spans = pii.find_spans(text, pii._automaton())
    assert [(text[a:b], k) for a, b, k in spans if k in pii.EXTRA_KINDS] == [
        ("DE89 3704 0044 0532 0130 00", "account"), ("hunter2hunter2", "secret"), ("abcdEFGH1234", "secret"), ("24be64439e3e49cf", "secret"), ("HTTPS://X.org/A?b=1", "url"),
    ]
    assert pii.redact("Password: hunter2hunter2", pii.find_spans("Password: hunter2hunter2", pii._automaton())) == "Password: [SECRET]"
    assert pii.lowered("İ\u212aÀ\ud800Z") == "İ\u212aÀ\ud800z"


def test_long_expressions_are_evaluated():
    line = " AND ".join(f"(L{i} OR M{i})" for i in range(40)) + " AND GPL-2.0-only WITH Classpath-exception-2.0"
    assert labels_of(line) == {f"{x}{i}" for i in range(40) for x in "lm"} | {"gpl-2.0-only-with-classpath-exception-2.0"}
    short = "(A OR B AND C) WITH X OR D"
    assert labels_of(short) == set().union(*choices_of(licenses.parse_expression(short)))


def test_round_trip_of_whole_lists(spark):
    vocabulary = pieces.load_vocabulary()
    rows = spark.createDataFrame([("Hello  world, again\n",), ("a▁b",), ("",)], "text string").select("text", pieces.encoded("text", vocabulary).alias("e")).collect()
    assert [r.e.whole for r in rows] == [True, False, True] and len(rows[0].e.ranked) == pieces.N_BEST == len({tuple(x) for x in rows[0].e.ranked})
    lattice = pieces.Lattice(vocabulary)
    assert all(lattice.decode(x) == rows[0].text for x in rows[0].e.ranked)
