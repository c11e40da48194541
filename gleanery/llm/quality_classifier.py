"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees grown on labelled documents are cut into root-to-node paths; each path is a rule, a conjunction of
comparisons of statistics. A lasso logistic fit over the rules keeps a few with weights, and the kept rules are compiled
into one Spark column expression, so scoring is a projection inside the JVM.

The trees and weights are fitted on at most `max_rows` labelled rows (a parameter, chosen by a hash of the id, so that
the choice does not depend on order); everything else reads all rows.

Only the statistics that rules with weight use are computed when a table is scored, and the words of a text are found once
for all of them.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; labels that are null are left
out; with no labelled rows, or one class only, every score is the share of label 1 (0.5 with no rows); repeated rows
are scored alike; an empty table gives an empty result; other columns of the input are kept, whatever their names (the
statistics lie in one struct under a name that the input does not have).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import crc_mod, labelled_sample, let, settle, table, unused, words
from gleanery.llm.quality_rules import letters, statistics

Condition = tuple[int, bool, float]  # feature, whether it is at most the bound, bound


def counts(text: Column, found: Column) -> dict[str, Column]:
    """The counts that the statistics are made of, for a text that is not null and its words."""
    count = lambda kind: F.regexp_count(text, F.lit(kind))
    return {
        **statistics(text, found),
        "letters": letters(text),
        "capitals": count(r"\p{Lu}"),
        "digits": count("[0-9]"),
        "shouts": count("[!?]"),
        "stops": count("[.,;:]"),
        "lines": F.size(F.split(text, "\n")),
        "distinct_words": F.size(F.array_distinct(found)),
    }


#: Statistics by name: a count and the count that it is divided by (1 at least), or a count and None for log(1 + count).
STATISTICS: dict[str, tuple[str, str | None]] = {
    "log_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "shouts": ("shouts", "word_chars"),
    "stops": ("stops", "word_chars"),
    "letters": ("letters", "word_chars"),
    "capitals": ("capitals", "letters"),
    "digits": ("digits", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "distinct": ("distinct_words", "n_words"),
    "line_words": ("n_words", "lines"),
}
FEATURES = tuple(STATISTICS)


def features(text: Column, names: tuple[str, ...] = FEATURES) -> Column:
    """A struct of the named statistics of a text; each count they need is found once."""
    whole = F.coalesce(text, F.lit(""))
    needed = sorted({c for n in names for c in STATISTICS[n] if c})

    def value(c: Column, name: str) -> Column:
        part, by = STATISTICS[name]
        return F.log1p(c[part]) if by is None else c[part] / F.greatest(c[by], F.lit(1.0))

    def counted(w: Column) -> Column:
        every = counts(whole, w)
        return let(F.struct(*[every[n].cast("double").alias(n) for n in needed]), lambda c: F.struct(*[value(c, n).alias(n) for n in names]))

    return let(words(whole), counted)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)$")


def tree_rules(description: str) -> set[frozenset[Condition]]:
    """Every root-to-node path in a forest's description, as a set of conditions."""
    found, path = set(), []
    for line in description.split("\n"):
        if m := _SPLIT.match(line):
            depth = len(m[1])
            path = [(d, c) for d, c in path if d < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
            found.add(frozenset(c for _, c in path))
        elif "Tree" in line:
            path = []
    return found


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctive rules."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def used(self) -> tuple[str, ...]:
        """The statistics that the rules compare."""
        numbers = {feature for conditions, _ in self.rules for feature, _, _ in conditions}
        return tuple(FEATURES[i] for i in sorted(numbers))

    def score(self, found: Column) -> Column:
        """The probability of label 1, given a struct of the used statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions, found), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(conditions: tuple[Condition, ...], found: Column) -> Column:
    out = F.lit(True)
    for feature, at_most, bound in conditions:
        x = found[FEATURES[feature]]
        out = out & ((x <= bound) if at_most else (x > bound))
    return out


def with_score(docs: DataFrame, rules: RuleEnsemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs plus the score of each text."""
    names = rules.used()
    if not names:
        return docs.withColumn(out, rules.score(F.lit(None)))
    held = unused(docs, "_statistics")
    return docs.withColumn(held, features(F.col(text_col), names)).withColumn(out, rules.score(F.col(held))).drop(held)


def fit(train: DataFrame, label_col: str = "label", trees: int = 10, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """Fit on a table with the statistics as the struct `found` and a 0/1 label; rows without a label are left out."""
    counts = {int(r[0]): r[1] for r in train.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    if set(counts) != {0, 1}:
        share = 0.5 if not counts else float(next(iter(counts)))
        return RuleEnsemble(math.log((share + 1e-3) / (1 - share + 1e-3)), ())
    data = train.where(F.col(label_col).isNotNull()).withColumn("_y", F.col(label_col).cast("double"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(data.select("_y", "found.*"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=7).fit(assembled)
    rules = sorted((tuple(sorted(r)) for r in tree_rules(forest.toDebugString)), key=lambda r: (len(r), r))
    if not rules:
        share = counts[1] / sum(counts.values())
        return RuleEnsemble(math.log(share / (1 - share)), ())
    ruled = data.select("_y", F.array([holds(r, F.col("found")).cast("double") for r in rules]).alias("_r"))
    from pyspark.ml.functions import array_to_vector

    fitted = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(ruled.select("_y", array_to_vector("_r").alias("_v")))
    weights = fitted.coefficients.toArray()
    return RuleEnsemble(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def op1_quality_classifier(spark: SparkSession, sf_dir: str, max_rows: int = 12_000) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    train = settle(labelled_sample(docs, labels, "quality", max_rows).select("label", features(F.col("text")).alias("found")))
    scored = with_score(docs, fit(train))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
