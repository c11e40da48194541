"""Search hits from stored result pages, by a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gleanery.sources.html import Node, parse

# Classes of a result, its title link and its address link.
RESULT, TITLE, ADDRESS = "result__body", "result__a", "result__url"


def _with_class(node: Node, name: str, kind: str) -> Iterator[Node]:
    return (x for x in node.walk() if x.name == name and kind in x.values.get("class", "").split())


def hits(html: str) -> Iterator[tuple[int, str, str]]:
    """(position, title, href) of the results of a page; one without a title link is passed over, an empty link falls back to the address link."""
    for position, result in enumerate(_with_class(parse(html), "div", RESULT)):
        title = next(_with_class(result, "a", TITLE), None)
        if title is not None:
            address = next(_with_class(result, "a", ADDRESS), None)
            yield position, title.text(), title.values.get("href") or (address.values.get("href", "") if address is not None else "")


@udtf(returnType="position int, title string, href string")
class ResultHits:
    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        try:
            yield from hits(html or "")
        except (ValueError, RecursionError):
            return


def stored_hits(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without their HTML, joined with the hits of each: position, title, href, as rank_sources() takes them."""
    found = pages.lateralJoin(ResultHits(F.col(html_col).outer()))
    return found.drop(html_col)
