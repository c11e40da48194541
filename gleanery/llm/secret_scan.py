"""Secrets by grammar inference.

One pass over the texts finds the base spans (assignments, access keys, hex strings) and all other candidates: runs of
credential characters, SHORTEST or more long, with a digit. The values of base spans are labelled credentials. Of these and of
the other candidates, bounded samples each make a prefix tree over classes of characters; states whose frequencies differ by
less than the Hoeffding bound are merged, red by blue, until a probabilistic automaton is left: one of credentials' formats,
one of all else. Every candidate is then scored whole by the logarithm of the ratio of its likelihoods, and the ones that
reach MARGIN are added as spans of the kind `format`.

Only the samples are bounded: at most SAMPLE distinct values of each side, chosen by a hash of the value, of at most
LONGEST_FIT characters each. All base spans and candidates are found and scored, whatever their number and length.

Defined cases: a null or empty text has no spans; very long texts and runs are read whole, in time linear in their length; a
run that touches a base span is no candidate; spans are given by start, then kind as listed; repeated rows give equal
results; with fewer than LEAST labelled values there is no automaton and no added span; an empty table gives an empty
result; the columns asked for are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import table, unused, written

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "format")
SHORTEST = 16
#: Bounds of the fit: distinct values of each side, characters of a value, and the least number of labelled values.
SAMPLE, LONGEST_FIT, LEAST = 4_000, 256, 20
#: Significance of the test by which states are told apart, and the ratio (a logarithm) that is asked for: odds of 99 to 1.
ALPHA, MARGIN = 0.05, 4.6

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUES = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
_DIGIT = re.compile("[0-9]")

#: Classes of characters, each the symbol of its place.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_SYMBOL = np.zeros(128, np.int8)
for _at, _class in enumerate(CLASSES):
    for _c in _class:
        _SYMBOL[ord(_c)] = _at

Found = tuple[int, int, str, str]


def base_spans(text: str) -> list[Found]:
    """(start, end, kind, value) of the base kinds, each leftmost and non-overlapping."""
    low, out = text.lower(), []
    if any(c in low for c in _CUES):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[Found]) -> Iterator[Found]:
    """Runs of credential characters that touch no base span, without the dots and dashes at their ends."""
    at, reach = 0, 0  # base spans are gone through once, with the furthest end so far
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        value = m[0].rstrip("./_-")
        start = m.start() + len(value) - len(value := value.lstrip("./_-"))
        if reach <= m.start() and len(value) >= SHORTEST and _DIGIT.search(value):
            yield start, start + len(value), "format", value


def symbols(value: str) -> np.ndarray:
    return _SYMBOL[np.frombuffer(value.encode("ascii"), np.uint8)]


class PrefixTree:
    """States with how often they are passed and ended in; an edge holds [state, times]."""

    def __init__(self, values: Iterable[str]) -> None:
        self.passed, self.ended, self.edges = [0], [0], [{}]
        for value in values:
            at = 0
            self.passed[0] += 1
            for s in symbols(value).tolist():
                edge = self.edges[at].get(s)
                if edge is None:
                    edge = self.edges[at][s] = [len(self.passed), 0]
                    self.passed.append(0)
                    self.ended.append(0)
                    self.edges.append({})
                edge[1] += 1
                at = edge[0]
                self.passed[at] += 1
            self.ended[at] += 1

    def compatible(self, red: int, blue: int, alpha: float) -> bool:
        """Whether no frequency of the two states, nor of any two below them, differs by the Hoeffding bound or more."""
        factor = math.sqrt(0.5 * math.log(2 / alpha))
        waiting = [(red, blue)]
        while waiting:
            x, y = waiting.pop()
            n, m = self.passed[x], self.passed[y]
            if factor >= math.sqrt(m):  # so few that no difference counts, nor any below
                continue
            room = factor * (n**-0.5 + m**-0.5)
            if abs(self.ended[x] / n - self.ended[y] / m) >= room:
                return False
            for s in self.edges[x].keys() | self.edges[y].keys():
                p, q = self.edges[x].get(s, (-1, 0)), self.edges[y].get(s, (-1, 0))
                if abs(p[1] / n - q[1] / m) >= room:
                    return False
                if p[1] and q[1]:
                    waiting.append((p[0], q[0]))
        return True

    def merge(self, red: int, blue: int) -> None:
        """Fold the tree below blue into red; the edge that led to blue is the caller's."""
        waiting = [(red, blue)]
        while waiting:
            x, y = waiting.pop()
            self.passed[x] += self.passed[y]
            self.ended[x] += self.ended[y]
            for s, (to, times) in self.edges[y].items():
                edge = self.edges[x].get(s)
                if edge is None:
                    self.edges[x][s] = [to, times]
                else:
                    edge[1] += times
                    waiting.append((edge[0], to))

    def merged(self, alpha: float = ALPHA) -> list[int]:
        """Merge until every state is red; gives the red states. The blue state passed most often goes first."""
        red, known = [0], {0}
        while True:
            blue = [(self.passed[e[0]], -p, -s) for p in red for s, e in self.edges[p].items() if e[0] not in known]
            if not blue:
                return red
            _, p, s = max(blue)
            edge = self.edges[-p][-s]
            for x in red:
                if self.compatible(x, edge[0], alpha):
                    y, edge[0] = edge[0], x
                    self.merge(x, y)
                    break
            else:
                red.append(edge[0])
                known.add(edge[0])


@dataclass(frozen=True)
class Automaton:
    """A probabilistic automaton: the next state and the logarithm of the chance of each symbol, and of ending, by state.

    Symbols never seen in a state lead to the last state, which knows only how frequent symbols are.
    """

    next: np.ndarray
    log: np.ndarray
    end: np.ndarray

    def likelihoods(self, values: list[str]) -> np.ndarray:
        """The logarithm of each value's likelihood; all values step together, the last few one by one."""
        coded = [symbols(v) for v in values]
        order = sorted(range(len(values)), key=lambda i: -len(coded[i]))
        longest = [len(coded[i]) for i in order]
        total, state, at, active = np.zeros(len(values)), np.zeros(len(values), np.int64), 0, len(values)
        while active > 8:
            while active and longest[active - 1] <= at:
                active -= 1
            step = np.fromiter((coded[i][at] for i in order[:active]), np.int64, active)
            total[:active] += self.log[state[:active], step]
            state[:active] = self.next[state[:active], step]
            at += 1
        following, logs = self.next.tolist(), self.log.tolist()
        for r in range(active):
            q, sum_ = int(state[r]), 0.0
            for s in coded[order[r]][at:].tolist():
                sum_ += logs[q][s]
                q = following[q][s]
            total[r] += sum_
            state[r] = q
        out = np.empty(len(values))
        out[order] = total + self.end[state]
        return out


def inferred(values: list[str], alpha: float = ALPHA, add: float = 0.1) -> Automaton:
    """The automaton of values: their prefix tree with compatible states merged, its frequencies smoothed by `add`."""
    tree = PrefixTree(values)
    red = tree.merged(alpha)
    place, k = {q: i for i, q in enumerate(red)}, len(CLASSES)
    times, ends = np.zeros((len(red) + 1, k)), np.zeros(len(red) + 1)
    to = np.full((len(red) + 1, k), len(red))
    for q, i in place.items():
        ends[i] = tree.ended[q]
        for s, (target, n) in tree.edges[q].items():
            times[i, s], to[i, s] = n, place[target]
    times[-1], ends[-1] = times.sum(axis=0), ends.sum()
    n = times.sum(axis=1) + ends + add * (k + 1)
    return Automaton(to, np.log((times + add) / n[:, None]), np.log((ends + add) / n))


@dataclass(frozen=True)
class Grammar:
    """Formats of credentials and of all else, and the ratio of likelihoods (logarithm) from which on a candidate is added."""

    credential: Automaton
    other: Automaton
    threshold: float = MARGIN

    def ratios(self, values: list[str]) -> np.ndarray:
        return self.credential.likelihoods(values) - self.other.likelihoods(values)


def learned(credentials: list[str], others: list[str]) -> Grammar | None:
    """The grammar of labelled values and other candidates; None with too few labels.

    Some of the others are credentials without a cue. Those likelier under the credentials' automaton than under the first
    one of all others are left out of the second.
    """
    if len(credentials) < LEAST:
        return None
    made = inferred(credentials)
    mixed = Grammar(made, inferred(others)).ratios(others)
    return Grammar(made, inferred([v for v, r in zip(others, mixed) if r <= 0]))


_FOUND = "array<struct<start:int,end:int,kind:string,value:string>>"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            rows.append([{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in (*base, *(candidates(text, base) if text else ()))])
        yield pd.Series(rows, dtype=object)


def scanned(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(keep…, found): base spans and candidates of every text, written once to the shared folder."""
    found = unused(docs, "found")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    return written(docs.select(kept, pandas_udf(_scan, _FOUND)(F.col(f"`{text_col}`")).alias(found)).withColumnRenamed(found, "found"))


def samples(rows: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most `most` distinct labelled values and as many candidates, by the order of a hash; no longer than LONGEST_FIT."""
    values = rows.select(F.explode("found").alias("f")).select((F.col("f.kind") != "format").alias("labelled"), F.col("f.value").alias("value"))
    distinct = values.where(F.length("value") <= LONGEST_FIT).distinct()
    first = lambda labelled: [r.value for r in distinct.where(F.col("labelled") == labelled).orderBy(F.xxhash64("value"), "value").limit(most).collect()]
    return first(True), first(False)


SPANS = "array<struct<start:int,end:int,kind:string,ratio:double>>"


def secret_spans(docs: DataFrame, keep: list[str], text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """(kept, spans): the columns to keep, as a struct, and each text's secrets; the grammar is learned here if none is given."""
    rows = scanned(docs, keep, text_col)
    grammar = grammar or learned(*samples(rows))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            asked = [f["value"] for row in found for f in row if f["kind"] == "format"] if grammar else []
            ratio = iter(grammar.ratios(asked).tolist() if asked else ())
            out = []
            for row in found:
                spans = []
                for f in row:
                    r = next(ratio) if grammar and f["kind"] == "format" else None
                    if f["kind"] != "format" or r is not None and r >= grammar.threshold:
                        spans.append({"start": f["start"], "end": f["end"], "kind": f["kind"], "ratio": r})
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pd.Series(out, dtype=object)

    return rows.select("kept", pandas_udf(judge, SPANS)("found").alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("kept.doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
