"""Heuristic quality rules run as a short-circuit cascade of column expressions.

Each rule is a Boolean column that is true for a text to reject. The words of a text are found once and shared by all
rules. Costs and rejection rates of the rules are estimated on a sample drawn over the whole table, and the cascade
evaluates the rules in falling order of rejections per second of cost. The order changes the work, never the verdict: a
text is rejected if and only if some rule rejects it.

Everything is a built-in expression, so the cascade runs inside the JVM without Python workers. Repeated windows are told
by 64-bit hashes of their three words within one text.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike; an empty table
gives an empty result; extra columns of the input pass through unless they bear a name the operator adds (the five
statistics, base_failed, kept), which then is replaced.
"""

from __future__ import annotations

import statistics as st
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import let, table, unused, words

SYMBOLS = r"[#*$%&|<>]"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of the sample on which rules are timed, about, and how often each is timed.
SAMPLE_ROWS, REPEATS = 1_000, 3


def _repeated(found: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array of words.

    Most texts repeat no window: then the distinct window hashes are as many as the windows, and nothing is sorted.
    """
    keys = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(ordered: Column) -> Column:
        same = lambda at, x: F.coalesce(F.get(ordered, at)["key"] == x["key"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(i - 1, x) | same(i + 1, x))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    def counted(k: Column) -> Column:
        placed = F.sort_array(F.transform(k, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(placed, covered))

    return let(keys(found), counted).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def statistics(text: Column, found: Column) -> dict[str, Column]:
    """The base statistics by name of a text that is not null, given its words."""
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": _repeated(found),
    }


@dataclass(frozen=True)
class Rule:
    """A rule by name; `rejects` takes the text and a function that gives a statistic by name."""

    name: str
    rejects: Callable[[Column, Callable[[str], Column]], Column]


def letters(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))


def _count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind))


#: The rules besides the base ones. Shares are whole percentages, so that they are exact.
RULES = (
    Rule("symbols", lambda t, s: F.lit(100) * s("n_symbols") > F.lit(5) * s("word_chars")),
    Rule("duplicate_lines", lambda t, s: F.lit(100) * s("n_dup_lines") > F.lit(30) * F.size(F.split(t, "\n"))),
    Rule("exclamations", lambda t, s: F.lit(100) * _count(t, "!") > F.lit(5) * s("word_chars")),
    Rule("capitals", lambda t, s: F.lit(100) * _count(t, r"\p{Lu}") > F.lit(50) * F.greatest(letters(t), F.lit(1))),
    Rule("no_letters", lambda t, s: F.lit(100) * letters(t) < F.lit(50) * s("word_chars")),
    Rule("giant_words", lambda t, s: s("word_chars") > F.lit(60) * s("n_words")),
)

#: The base rules, in the contract's words: too short, or more than half of the words in repeated windows.
BASE_RULES = (
    Rule("too_short", lambda t, s: s("n_words") < 50),
    Rule("repeats", lambda t, s: F.lit(100) * s("n_repeat_words") > F.lit(50) * s("n_words")),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, text_col: str = "text", repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejection rate) on a sample of about `sample_rows` rows; it settles only the order of evaluation.

    The sample is drawn over the whole table. A rule's cost is the median time of its job less that of a job that finds
    the words and applies no rule, so neither the scheduler nor the shared words count as a rule's cost.
    """
    n_docs = docs.count()
    sample = docs.select(F.coalesce(text_col, F.lit("")).alias("t")).sample(min(1.0, 1.2 * sample_rows / max(n_docs, 1)), seed=11)
    sample = sample.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism)).cache()
    n = max(sample.count(), 1)

    def timed(verdict: Callable[[Column], Column]) -> tuple[float, int]:
        job, took = sample.agg(F.count_if(let(words(F.col("t")), verdict))), []
        for _ in range(repeats):
            began = time.perf_counter()
            hits = job.first()[0]
            took.append(time.perf_counter() - began)
        return st.median(took), hits

    timed(lambda w: F.size(w) < 0)  # so that the first rule does not pay for compilation
    empty, _ = timed(lambda w: F.size(w) < 0)
    found = []
    verdict = lambda rule: lambda w: _verdict(rule, F.col("t"), statistics(F.col("t"), w))
    for rule in rules:
        seconds, hits = timed(verdict(rule))
        found.append((rule, max(seconds - empty, 1e-4), hits / n))
    sample.unpersist()
    return found


def order_rules(measured: list[tuple[Rule, float, float]]) -> tuple[Rule, ...]:
    """Most rejections per cost first; ties keep the given order."""
    return tuple(r for r, _, _ in sorted(measured, key=lambda x: -x[2] / max(x[1], 1e-9)))


def _verdict(rule: Rule, text: Column, stats: dict[str, Column]) -> Column:
    return F.coalesce(rule.rejects(text, stats.__getitem__), F.lit(False))


def cascade(text: Column, rules: tuple[Rule, ...], stats: dict[str, Column]) -> Column:
    """True if a rule rejects the text. CASE WHEN stops at the first rule that does, so later rules cost nothing then."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(_verdict(rule, text, stats), F.lit(True)).otherwise(out)
    return out


def rejected(text: Column, rules: tuple[Rule, ...]) -> Column:
    """True if a rule rejects the text; a statistic is computed only if the cascade reaches a rule that uses it."""
    whole = F.coalesce(text, F.lit(""))
    return let(words(whole), lambda w: cascade(whole, rules, statistics(whole, w)))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects."""
    ordered = order_rules(measure(docs, rules, sample_rows, text_col))
    return docs.where(~rejected(F.col(text_col), ordered))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base statistics, `base_failed` and `kept`."""
    ordered = order_rules(measure(docs, rules, sample_rows, text_col))
    whole, held = F.coalesce(F.col(text_col), F.lit("")), unused(docs, "_stats")
    counted = docs.withColumn(held, let(words(whole), lambda w: F.struct(*[c.alias(k) for k, c in statistics(whole, w).items()])))
    stats = {k: F.col(held)[k] for k in NAMES}
    failed = _verdict(BASE_RULES[0], whole, stats) | _verdict(BASE_RULES[1], whole, stats)
    kept = F.when(failed, F.lit(False)).otherwise(~cascade(whole, ordered, stats))
    return counted.withColumns({**stats, "base_failed": failed, "kept": kept}).drop(held)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_report(docs).select("doc_id", *NAMES, "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
#: Statistics and verdict over a relation `{docs}` with the columns doc_id and text, in DuckDB SQL.
REPORT_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from {{docs}}),
w as (select rid, doc_id, t, regexp_extract_all(t, '{_W}') as ws from d),
win as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
        from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from win) where n > 1),
rep as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from twice) group by rid),
ln as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
s as (select w.rid, w.doc_id, w.t, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
      coalesce(rep.n, 0)::bigint as n_repeat_words
      from w join ln using (rid) left join rep using (rid)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
      length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as letters from s)
select rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 5 * word_chars or 100 * n_dup_lines > 30 * len(string_split(t, chr(10)))
    or 100 * length(regexp_replace(t, '[^!]', '', 'g')) > 5 * word_chars
    or 100 * length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > 50 * greatest(letters, 1)
    or 100 * letters < 50 * word_chars or word_chars > 60 * n_words) as kept
from b
"""

ORACLE_SQL = f"select * exclude (rid) from ({REPORT_SQL.replace('{docs}', 'documents')})"
