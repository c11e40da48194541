"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-digit pairs, digits, URL schemes and identifier cues, these last two
in any mix of upper and lower case. A local
parser then grows each anchor to both sides, checks the candidate (domain labels, address parts, Luhn, digit counts,
IBAN remainder) and gives its boundaries. Texts without an anchor cost one pass of the automaton.

The four base kinds are leftmost and non-overlapping per kind. The method adds the kinds url, account and secret.

Defined cases: a null or empty text has no spans; very long texts are read whole, in time linear in their length;
repeated rows give equal results; other columns of the input are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("url", "account", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey")
ACCOUNT_CUES = ("iban",)

_DIGITS = "0123456789"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS
_LOCAL = frozenset(_ALNUM + "._%+-")
_LABEL = frozenset(_ALNUM + "-")
_NUMBER = frozenset(_DIGITS)
_PHONE = frozenset(_DIGITS + " ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>")
_VALUE = re.compile(r"[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_\-./+]{8,})")
_IBAN = re.compile(r"[ \t]*[=:]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30})")

Span = tuple[int, int, str]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keys in (("at", ("@",)), ("digit", _DIGITS), ("plus", [f"+{d}" for d in _DIGITS]), ("url", SCHEMES), ("secret", CUES), ("account", ACCOUNT_CUES)):
        for key in keys:
            found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset, end: int | None = None) -> int:
    """The first place from `at` on whose character is not allowed."""
    n = len(text) if end is None else end
    while at < n and text[at] in allowed:
        at += 1
    return at


def parse_email(text: str, at: int, floor: int) -> Span | None:
    """Grow an at-sign to a local part, not before floor, and a domain of two labels or more."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end, dots = _run(text, at + 1, _LABEL), 0
    if end == at + 1:
        return None
    while end < len(text) and text[end] == "." and (last := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = last, dots + 1
    return (start, end, "email") if dots else None


def parse_ips(text: str, start: int) -> tuple[list[Span], int]:
    """Addresses in the chain of digit runs joined by single dots that begins at start, and the end of the chain."""
    runs, at = [], start
    while True:
        end = _run(text, at, _NUMBER)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _NUMBER:
            at = end + 1
        else:
            break
    spans = []
    for i in range(0, len(runs) - 3, 4):
        four = runs[i : i + 4]
        if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or 0) <= 255 for a, b in four):
            spans.append((four[0][0], four[3][1], "ip"))
    return spans, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def parse_card(text: str, start: int) -> tuple[Span | None, int]:
    """Digits from start on, apart by at most one space or hyphen; and where they end."""
    at = start + 1
    while at < len(text):
        if text[at] in _NUMBER:
            at += 1
        elif text[at] in " -" and at + 1 < len(text) and text[at + 1] in _NUMBER:
            at += 2
        else:
            break
    if at - start < 14:
        return None, at
    digits = text[start:at].replace(" ", "").replace("-", "")
    return ((start, at, "card") if 14 <= len(digits) <= 19 and luhn(digits) else None), at


def parse_phone(text: str, start: int) -> tuple[Span | None, int]:
    """A plus and a digit grown over digits and separators to the last digit; and where scanning goes on."""
    end = _run(text, start + 2, _PHONE)
    while end > start + 3 and text[end - 1] not in _NUMBER:
        end -= 1
    if end <= start + 3:
        return None, start + 1
    digits = sum(c in _NUMBER for c in text[start:end])
    return ((start, end, "phone") if 10 <= digits <= 15 else None), end


def iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def parse_account(text: str, at: int) -> Span | None:
    """An IBAN after its cue: the longest prefix of the candidate whose remainder is right."""
    if not (m := _IBAN.match(text, at)):
        return None
    start, end = m.span(1)
    while end - start >= 15:
        value = text[start:end].replace(" ", "")
        if text[end - 1] != " " and 15 <= len(value) <= 34 and iban_ok(value):
            return start, end, "account"
        end -= 1
    return None


def lowered(text: str) -> str:
    """The text with A-Z in lower case and all else as it is, so that offsets stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # where each kind's scan stands
    for last, (kind, size) in automaton.iter(lowered(text)):
        at = last - size + 1
        if kind == "at":
            if at >= done["email"] and (span := parse_email(text, at, done["email"])):
                spans.append(span)
                done["email"] = span[1]
        elif kind == "digit":
            if at >= done["ip"]:
                found, done["ip"] = parse_ips(text, at)
                spans += found
            if at >= done["card"]:
                span, done["card"] = parse_card(text, at)
                spans += [span] if span else []
        elif kind == "plus":
            if at >= done["phone"]:
                span, done["phone"] = parse_phone(text, at)
                spans += [span] if span else []
        elif kind == "url":
            end = last + 1
            if at >= done["url"]:
                while end < len(text) and text[end] not in _URL_END:
                    end += 1
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1:
                    spans.append((at, end, "url"))
                done["url"] = end
        elif kind == "secret":
            if at >= done["secret"] and (m := _VALUE.match(text, last + 1)):
                spans.append((*m.span(1), "secret"))
                done["secret"] = m.end(1)
        elif at >= done["account"] and (span := parse_account(text, last + 1)):
            spans.append(span)
            done["account"] = span[1]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN_TYPE = "array<struct<start:int,end:int,kind:string>>"


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for texts in batches:
        yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t, automaton)] if t else [] for t in texts])


def pii_spans(text: Column) -> Column:
    """Spans of personal data as an array of (start, end, kind); code points, end exclusive."""
    return pandas_udf(_spans, SPAN_TYPE)(text)


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for texts in batches:
        yield pd.Series([redact(t, find_spans(t, automaton)) if t else t for t in texts])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts, grown over the others."""
    out, at, reach = [], 0, 0
    for start, end, kind in spans:
        if start >= reach:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    return pandas_udf(_redacted, "string")(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii_spans("text").alias("found"))
    joined = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
