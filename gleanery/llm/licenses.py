"""Licence scans: notices and identifier tags found by Aho-Corasick, licence expressions by a shunting-yard parser.

A text is lower-cased (A-Z) and cut into words; one automaton runs over the words joined by single spaces, so a
phrase matches however its words are separated. Tags are searched in the text itself; the rest of a tag's line is an
expression of identifiers, `and`, `or`, `with` and brackets. Notices in prose are expressions too: a notice phrase with its
version ("version 3 or later") is an operand, `and` and `or` tie it to a notice or a licence's short name beside it ("the MIT
or Apache license"), and "with the … exception" belongs to the operand before it; the same parser reads them. A value says which licences are named, which of them hold
whatever is chosen (`required`), and whether some choice is free of copyleft (`permissive`); expressions of any length
are evaluated in one walk.

Defined cases: a null or empty text has no words and score 0; tags that do not parse give the label `unparsed`, which
counts as one more phrase; several tags and notices hold together; without any `required` is empty and `permissive` null; very long texts are read
whole, in time linear in their length; repeated rows give equal results; an empty table gives an empty result; other
columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import table

# The phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases that the method adds.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
TAG = "spdx-license-identifier:"
TAG_WORDS = "spdx license identifier"
#: Starts of the names of licences with copyleft.
COPYLEFT = ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cddl", "cc-by-sa", "osl", "sspl")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Names of licences in short, and of copyright notices that are no licence.
SHORT_NAMES = frozenset({"mit", "apache", "bsd", "isc", "gpl", "lgpl", "agpl", "mpl", "epl"})
NO_LICENSE = frozenset({"all-rights-reserved"})
ARTICLES = frozenset({"the", "a", "an", "either"})
LATER = (("or", "later"), ("or", "newer"), ("or", "any", "later", "version"), ("or", "any", "later"))
#: Words that an exception's name may have.
EXCEPTION_WORDS = 4
_NUMBER = re.compile(r"v?([0-9]{1,3})")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in (*phrases, TAG_WORDS):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def parse_expression(line: str) -> list | None:
    """Postfix tokens of a licence expression by the shunting-yard method; None if it does not parse."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the token before was an operand
    for token in _TOKEN.findall(line):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            waiting.append(token)
        elif token == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand or not re.fullmatch(r"[A-Za-z0-9.+:-]+", token):
            return None
        else:
            out.append(low)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


@dataclass(frozen=True)
class Value:
    """What an expression says: the licences it names, those that hold in every choice, and whether a choice has no copyleft."""

    named: frozenset[str]
    required: frozenset[str]
    permissive: bool


def value(postfix: list[str]) -> Value:
    """The value of an expression, without listing its choices."""
    stack: list[Value] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(Value(frozenset([token]), frozenset([token]), not token.startswith(COPYLEFT)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            pairs = lambda a, b: frozenset(f"{x}-with-{y}" for x in a for y in b)
            stack.append(Value(pairs(left.named, right.named), pairs(left.required, right.required), left.permissive))
        elif token == "and":
            stack.append(Value(left.named | right.named, left.required | right.required, left.permissive and right.permissive))
        else:
            stack.append(Value(left.named | right.named, left.required & right.required, left.permissive or right.permissive))
    return stack[0]


UNPARSED = Value(frozenset(["unparsed"]), frozenset(), False)


def tag_value(line: str) -> Value:
    postfix = parse_expression(line)
    return UNPARSED if postfix is None else value(postfix)


class Notices:
    """Licence expressions that the words around notice phrases make; found: the end and the label by the first word of a phrase."""

    def __init__(self, words: list[str], found: dict[int, tuple[int, str]]):
        self.words, self.found = words, found

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def operand(self, i: int) -> tuple[int, str] | None:
        """Where the licence named from word i on ends, and its identifier with its version; None if there is none."""
        while self.word(i) in ARTICLES:
            i += 1
        if i in self.found:
            end, name = self.found[i]
        elif self.word(i) in SHORT_NAMES:
            end, name = i + 1, self.word(i)
        else:
            return None
        at = end + 1 if self.word(end) == "version" else end
        if major := _NUMBER.fullmatch(self.word(at)):
            minor = _NUMBER.fullmatch(self.word(at + 1))
            end, name = at + (2 if minor else 1), f"{name}-{major[1]}.{minor[1] if minor else 0}"
            for later in LATER:
                if tuple(self.words[end : end + len(later)]) == later:
                    return end + len(later), f"{name}+"
        return end, name

    def exception(self, i: int) -> tuple[int, str] | None:
        """The name of the exception after the word `with` at i, and where it ends."""
        begin = i + 1
        while self.word(begin) in ARTICLES:
            begin += 1
        for k in range(begin + 1, begin + 1 + EXCEPTION_WORDS):
            if self.word(k) == "exception" and all(w.isascii() for w in self.words[begin:k]):
                return k + 1, "-".join(self.words[begin : k + 1])
        return None

    def expression(self, i: int) -> tuple[int, list[str]]:
        """Where the expression that begins at word i ends, and its tokens."""
        end, name = self.operand(i)
        tokens = [name]
        while (link := self.word(end)) in PRECEDENCE:
            following = self.exception(end) if link == "with" else self.operand(end + 1)
            if following is None or link == "with" and tokens[-2:-1] == ["with"]:
                break
            end = following[0]
            tokens += [link, following[1]]
        return end, tokens

    def values(self) -> list[Value]:
        """The values of all expressions, from left to right; each phrase belongs to one."""
        out, done = [], 0
        for i in sorted(self.found):
            if i < done:
                continue
            while True:  # short names before the phrase, tied to it
                j = i - 1
                while j > done and self.word(j) in ARTICLES:
                    j -= 1
                if j - 1 < done or self.word(j) not in ("and", "or") or self.word(j - 1) not in SHORT_NAMES:
                    break
                i = j - 1
            done, tokens = self.expression(i)
            postfix = parse_expression(" ".join(tokens))
            if postfix is not None:
                out.append(value(postfix))
        return out


def scan(text: str | None, automaton: ahocorasick.Automaton, phrases: dict[str, str]) -> tuple:
    """(words, places, first, last, base labels, labels, score, required, permissive) of a text."""
    low = (text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower()
    words = _WORD.findall(low)
    joined = f" {' '.join(words)} "
    places, base, more, tagged, hits = [], set(), set(), False, []
    for end, phrase in automaton.iter(joined):
        if phrase == TAG_WORDS:
            tagged = True
            continue
        if phrase in BASE_PHRASES:
            places.append(end - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
        more.add(phrases[phrase])
        if phrases[phrase] not in NO_LICENSE:
            hits.append((end - len(phrase) - 1, phrase))
    tags, at = [], low.find(TAG) if tagged else -1
    while at >= 0:
        end = low.find("\n", at)
        tags.append(tag_value(low[at + len(TAG) : end if end >= 0 else len(low)].strip().removesuffix("*/").removesuffix("-->")))
        at = low.find(TAG, end) if end >= 0 else -1
    first = last = None
    notices = []
    if places or hits:  # a phrase stands at the space before its first word; the i-th word begins at the i-th space
        spaces = list(accumulate((len(w) + 1 for w in words), initial=0))
        if places:
            first, last = bisect_left(spaces, min(places)), bisect_left(spaces, max(places))
        found: dict[int, tuple[int, str]] = {}
        for place, phrase in hits:  # a longer phrase from the same word ends later and takes its place
            i = bisect_left(spaces, place)
            found[i] = (i + phrase.count(" ") + 1, phrases[phrase])
        notices = Notices(words, found).values()
    more = more.union(*[v.named for v in tags + notices])
    values = [v for v in tags if v is not UNPARSED] + notices
    required = frozenset().union(*[v.required for v in values])
    permissive = all(v.permissive for v in values) if values else None
    score = 1.0 if any(v is not UNPARSED for v in tags) else 1.0 - 0.5 ** (len(places) + len(more - base))
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, ",".join(sorted(required)), permissive


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, permissive boolean"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    phrases = BASE_PHRASES | MORE_PHRASES
    automaton = _automaton(phrases)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for texts in batches:
        rows = pd.DataFrame([scan(t, automaton, phrases) for t in texts], columns=names)
        yield rows.astype({"first_word": "Int64", "last_word": "Int64", "permissive": "boolean"})


def license_scan(text: Column | str) -> Column:
    """A struct of the scan's columns."""
    return pandas_udf(_scan, SCHEMA)(text)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", license_scan("text").alias("s")).select("doc_id", "s.*")
