"""Text expressions: cleaning, boilerplate tests, tokens."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.stopwords import ENGLISH

MIN_LENGTH = 60
MAX_SPECIAL = 0.35
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Runs of white space that are not one plain space; graphic ASCII is told first, as it is cheap to.
RUNS = r"(?U)(?=[^!-~])(?:[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+)"
#: An ampersand, or a character that NFKC may change or join to the one before: beyond ASCII, and not in these ranges, which are
#: left as they are whatever stands beside them (Latin and Cyrillic letters, kana, Han and Hangul, common signs).
STABLE = r"\x80-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u2010\u2012-\u2016\u2018-\u2023\u3001-\u3003\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3"
CHANGES = rf"[^\x00-%'-\x7F](?<![{STABLE}])"
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Prefixes of navigation text, junk words and tails of captions.
NAV_PREFIX = r"(?i)^(home|about|contact|menu|navigation|skip to|cookie|privacy|terms|subscribe|sign up|log in|login|search|all rights reserved|copyright|[0-9]{4}[-–][0-9]{4})"
JUNK_CAPTION = ("istock", "getty", "shutterstock", "stock images", "stock pictures", "royalty-free", "premium high-res", "download free")
CAPTION_TAIL = r"(?i)(stock pictures, royalty-free photos & images|royalty-free images|stock photos|high-res pictures).*"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, RUNS, " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def decode_and_normalise(text: Column) -> Column:
    """Entities decoded, tags as spaces, NFKC. Spark has no entity table and no Unicode normaliser, so this is a Python function;
    it is sent only the texts that hold an ampersand or a character that NFKC may change; letters with accents, say, it does not.
    Rows go to it a hundred at a time: an Arrow batch of 10,000 whole texts takes gigabytes in Python."""
    tag = re.compile("<[^>]+>")

    def decode(text: str | None) -> str | None:
        return None if text is None else unicodedata.normalize("NFKC", tag.sub(" ", html.unescape(text)))

    changes = text.rlike(CHANGES)
    return F.when(changes, F.udf(decode, "string", useArrow=False)(F.when(changes, text))).otherwise(strip_tags(text))


def clean_text(text: Column, native: bool = False) -> Column:
    """Entities, tags, NFKC and white space in this order; native skips entities and NFKC and stays in the JVM."""
    return collapse(strip_tags(text) if native else decode_and_normalise(text))


def special_share(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    return F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{N}\s]")) / F.greatest(F.length(text), F.lit(1))


def is_navigation(text: Column) -> Column:
    return text.rlike(NAV_PREFIX)


def is_paragraph(text: Column, min_length: int = MIN_LENGTH, max_special: float = MAX_SPECIAL) -> Column:
    """Whether a cleaned text is long enough, no navigation and mostly words."""
    return (F.length(text) >= min_length) & ~is_navigation(text) & (special_share(text) <= max_special)


def content_hash(text: Column) -> Column:
    return F.sha1(F.lower(strip(text)).cast("binary"))


def tokens(text: Column, stop: tuple[str, ...] = ENGLISH) -> Column:
    """Lower-case runs of two or more word characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def with_bigrams(found: Column) -> Column:
    """Tokens followed by their adjacent pairs. Give it a column that holds the tokens: an expression is worked out four times."""
    ahead = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
    pairs = F.transform(F.arrays_zip(found.alias("a"), ahead.alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))  # null for the last token
    return F.concat(found, F.filter(pairs, lambda x: x.isNotNull()))


def is_junk_caption(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in JUNK_CAPTION:
        out = out | low.contains(phrase)
    return out
