"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms (NFKC) become plain, combining marks go, letters that look like Latin ones
become Latin, and digits and signs inside words become the letters they stand for. One Aho-Corasick automaton then finds lexicon terms and exception phrases in the folded
words; a term inside an exception phrase does not count. The weights found are summed and normalised by length, and a
logistic curve turns the result into a score.

The lexicon is learned: a term is a word or a stem, its weight its smoothed log odds between toxic and clean labelled documents. Support is
the number of different words seen before the term in toxic documents, so a term that only copies of one text share
has next to none. Exception phrases are a given table and those that are learned: a term with the word before or after it
that occurs in clean labelled documents only. Fitting reads at most `max_rows` labelled rows (a parameter), which bounds the
lexicon; nothing else is cut.

Defined cases: null and empty texts have no hits and get the score of a clean text; with one class only every score is
that class's; repeated rows are scored alike; very long texts are read whole, in time linear in their length; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import crc_mod, labelled_sample, settle, table

# Cyrillic and Greek letters that look like Latin ones, and signs used for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁѵαβεικνορτυχ", "abekmhopctyxijsdvabeiknoptux", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("clown fish", "trash can", "trash bin")

#: Lengths of the stems that may be lexicon terms besides whole words.
STEMS = (5, 6, 7, 8)

_FOLD = str.maketrans(HOMOGLYPHS | LEET)
_MARKS = dict.fromkeys(range(0x300, 0x370))
_GLYPHS = str.maketrans(HOMOGLYPHS)
_TOKEN = re.compile(r"[^\W_]+(?:[@$!]+[^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str | None) -> list[str]:
    """Folded words. Digits stand for letters only in words that hold a letter."""
    plain = text or ""
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain).translate(_MARKS)
    found = _TOKEN.findall(plain.lower())
    if not plain.isascii():
        found = [w.translate(_GLYPHS) for w in found]
    return [w if w.isalpha() else w.translate(_FOLD) if _LETTER.search(w) else w for w in found]


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, exception phrases, and the curve from hits to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    intercept: float = 0.0


def terms_of(word: str) -> list[str]:
    """A word and its stems: the word's first letters, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if n < len(word))]


def _terms(texts: pd.Series) -> pd.Series:
    return pd.Series([[x for w in dict.fromkeys(fold(t)) for x in terms_of(w)] for t in texts])


def _contexts(wanted: frozenset[str]):
    """A function from texts to the (word before, term) pairs of the wanted terms."""

    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = fold(t)
            out.append([{"before": b, "term": x} for b, y in dict.fromkeys(zip(["", *w], w)) for x in terms_of(y) if x in wanted])
        return pd.Series(out)

    return found


def pattern(term: str) -> str:
    """What the automaton looks for in folded words joined by single spaces."""
    return f" {term[:-1]}" if term.endswith("*") else f" {term} "


def shortest(weights: dict[str, float], slack: float = 0.7) -> dict[str, float]:
    """The terms without those that a lighter or about equally heavy stem covers already."""
    stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
    bare = lambda t: t.removesuffix("*")
    covered = lambda t, w: any(stems.get(bare(t)[:n], -1e9) >= w - slack for n in STEMS if n < len(bare(t)) or n == len(bare(t)) and not t.endswith("*"))
    return {t: w for t, w in weights.items() if not covered(t, w)}


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in lexicon.weights:
        found.add_word(pattern(term), (term, False, len(pattern(term))))
    for phrase in lexicon.exceptions:
        if words := fold(phrase):
            spelled = f" {' '.join(words)} "
            found.add_word(spelled, (phrase, True, len(spelled)))
    found.make_automaton()
    return found


def hits(folded: list[str], lexicon: Lexicon, found: ahocorasick.Automaton) -> tuple[int, float]:
    """Number and summed weight of the lexicon terms outside exception phrases."""
    if not len(found):
        return 0, 0.0
    kept = [t for _, t in kept_hits(f" {' '.join(folded)} ", found)]
    return len(kept), float(sum(lexicon.weights[t] for t in kept))


def kept_hits(joined: str, found: ahocorasick.Automaton) -> list[tuple[int, str]]:
    """(place, term) of the terms that no exception phrase covers, in a text of folded words between spaces."""
    spans, safe = [], []
    for end, (term, exempt, size) in found.iter(joined):
        (safe if exempt else spans).append((end - size + 1, end, term))
    if safe:
        safe.sort()
        starts, reach = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
        spans = [(a, b, t) for a, b, t in spans if not (k := bisect_right(starts, a)) or reach[k - 1] < b]
    return [(a, t) for a, _, t in spans]


def toxic_hits(text: Column | str, lexicon: Lexicon) -> Column:
    """A struct (hits, weight, n_words) of a text."""

    @pandas_udf("hits long, weight double, n_words long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(lexicon)
        for texts in batches:
            rows = []
            for t in texts:
                w = fold(t)
                rows.append((*hits(w, lexicon, found), len(w)))
            yield pd.DataFrame(rows, columns=["hits", "weight", "n_words"])

    return scan(text)


def normalised(found: Column) -> Column:
    """Weight by length: a hit counts less in a longer text, by the logarithm of its words."""
    return found["weight"] / (F.lit(1.0) + F.log1p(found["n_words"].cast("double")) / F.lit(10.0))


def _phrases(lexicon: Lexicon):
    """A function from texts to the distinct phrases of two words in which a term of the lexicon occurs."""

    def found(texts: pd.Series) -> pd.Series:
        matcher, out = automaton(lexicon), []
        for t in texts:
            joined = f" {' '.join(fold(t))} "
            phrases = {}
            for at, _ in kept_hits(joined, matcher) if len(matcher) else ():
                word = joined[at + 1 : joined.index(" ", at + 1)]
                next_ = at + len(word) + 2
                before, after = joined[joined.rfind(" ", 0, at) + 1 : at] if at else "", joined[next_ : joined.index(" ", next_)] if next_ < len(joined) else ""
                phrases |= dict.fromkeys([f"{before} {word}"] * bool(before) + [f"{word} {after}"] * bool(after))
            out.append(list(phrases))
        return pd.Series(out)

    return found


def learn_exceptions(train: DataFrame, lexicon: Lexicon, least: int = 3) -> tuple[str, ...]:
    """Phrases of a term and the word beside it that occur in `least` clean rows or more and in no toxic one."""
    seen = train.where("label is not null").select(F.col("label").cast("long").alias("label"), F.explode(pandas_udf(_phrases(lexicon), "array<string>")("text")).alias("phrase"))
    counts = seen.groupBy("phrase").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    return tuple(sorted(r["phrase"] for r in counts.where((F.col("pos") == 0) & (F.col("neg") >= least)).collect()))  # of labelled rows only


def learn(train: DataFrame, least_support: int = 8, least_weight: float = 2.5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from a settled table (text, label)."""
    sizes = {int(r[0]): r[1] for r in train.where("label is not null").groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        share = float(next(iter(sizes))) if sizes else 0.0
        return Lexicon({}, exceptions, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    label = F.col("label").cast("long")
    seen = train.where("label is not null").select(label.alias("label"), F.explode(pandas_udf(_terms, "array<string>")("text")).alias("term"))
    counts = seen.groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).where(F.col("pos") >= least_support)
    weight = F.log((F.col("pos") + 0.5) / F.lit(sizes[1] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(sizes[0] + 1.0))
    heavy = counts.withColumn("weight", weight).where(F.col("weight") >= least_weight)
    rows = {r["term"]: r["weight"] for r in heavy.collect() if r["term"]}  # terms of the labelled rows, least_support times or more
    near = pandas_udf(_contexts(frozenset(rows)), "array<struct<before:string,term:string>>")
    pairs = train.where("label = 1").select(F.explode(near("text")).alias("p")).select("p.*").distinct()
    support = {r[0]: r[1] for r in pairs.groupBy("term").count().collect()}  # a row for each of the terms
    lexicon = Lexicon(shortest({t: w for t, w in rows.items() if support.get(t, 0) >= least_support}), exceptions)
    lexicon = Lexicon(lexicon.weights, tuple(dict.fromkeys([*exceptions, *learn_exceptions(train, lexicon)])))
    curve = settle(train.where("label is not null").select(F.col("label").cast("double").alias("y"), normalised(toxic_hits("text", lexicon)).alias("x")))
    fitted = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.001, maxIter=50).fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(curve))
    return Lexicon(lexicon.weights, lexicon.exceptions, float(fitted.coefficients[0]), float(fitted.intercept))


def toxicity_score(found: Column, lexicon: Lexicon) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * normalised(found))))


def op4_toxicity(spark: SparkSession, sf_dir: str, max_rows: int = 10_000) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    lexicon = learn(settle(labelled_sample(docs, labels, "toxic", max_rows).select("text", "label")))
    scored = docs.select("doc_id", toxic_hits("text", lexicon).alias("found")).withColumn("score", toxicity_score(F.col("found"), lexicon))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("found.hits").alias("hits"))
