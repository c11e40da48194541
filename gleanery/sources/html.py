"""Extraction of items from pages: a tolerant walk of the HTML, once per page, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
# Subtrees that hold no text of the page, and the limits of the extractors.
NOISE = frozenset(["script", "style", "nav", "footer", "header", "aside", "form"])
MIN_PARAGRAPH, MIN_CAPTION, CAPTION, CONTEXT, HEADING, ITEM, HEADERS = 50, 5, 200, 300, 50, 50, 10
AUDIO_ENDS = (".mp3", ".wav", ".ogg")


class Node:
    """An element: its name, attributes, parent, and children that are elements or strings."""

    __slots__ = ("children", "name", "parent", "values")

    def __init__(self, name: str, values: dict, parent: Node | None) -> None:
        self.name, self.values, self.parent, self.children = name, values, parent, []

    def walk(self, without: frozenset = frozenset()) -> Iterator[Node]:
        """All elements below in document order, without the subtrees named."""
        waiting = [x for x in reversed(self.children) if isinstance(x, Node)]
        while waiting:
            node = waiting.pop()
            if node.name not in without:
                yield node
                waiting += [x for x in reversed(node.children) if isinstance(x, Node)]

    def strings(self, without: frozenset = frozenset()) -> Iterator[str]:
        waiting = list(reversed(self.children))
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in without:
                waiting += reversed(x.children)

    def text(self, between: str = "", without: frozenset = frozenset()) -> str:
        return between.join(s for x in self.strings(without) if (s := x.strip()))

    def above(self, *names: str) -> Node | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node


class Tree(HTMLParser):
    """Builds nodes; an end tag without a start is ignored, and a paragraph ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":
            self._close("p")
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _close(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def paragraphs(root: Node, url: str) -> Iterator[tuple]:
    for node in root.walk(NOISE):
        if node.name in ("p", "article", "section") and len(text := node.text(" ", NOISE)) >= MIN_PARAGRAPH:
            yield (text,)


def images(root: Node, url: str) -> Iterator[tuple]:
    for node in root.walk():
        if node.name == "img" and (src := node.values.get("src")):
            caption = node.values.get("alt", "")
            if not caption and (near := node.above("figure", "div", "p")):
                caption = near.text()[:CAPTION]
            address = urljoin(url, src)
            if len(caption) > MIN_CAPTION and address.startswith("http"):
                yield address, caption


def audio(root: Node, url: str) -> Iterator[tuple]:
    for node in root.walk():
        if node.name in ("audio", "source", "a") and (link := node.values.get("src") or node.values.get("href")) and link.split("?")[0].endswith(AUDIO_ENDS):
            near = node.above("div", "p", "article")
            address = urljoin(url, link)
            if address.startswith("http"):
                yield address, near.text()[:CONTEXT] if near else ""


def list_after(root: Node) -> dict[int, Node]:
    """The nearest list or paragraph after each heading among its siblings, from one walk backwards over each parent's children."""
    found = {}
    for parent in (root, *root.walk()):
        near = None
        for x in reversed(parent.children):
            if isinstance(x, Node):
                if x.name in ("h2", "h3", "h4") and near is not None:
                    found[id(x)] = near
                elif x.name in ("ul", "ol", "p"):
                    near = x
    return found


def header_edges(root: Node, url: str) -> Iterator[tuple]:
    following = list_after(root)
    for node in root.walk():
        if node.name in ("h2", "h3", "h4") and 1 <= len(name := node.text()) <= HEADING:
            near = following.get(id(node))
            if near is not None and near.name != "p":
                for item in near.walk():
                    if item.name == "li" and (text := item.text()[:ITEM]):
                        yield name, text, "contains/relates_to"


def table_rows(root: Node, url: str, first_row_headers: bool = False) -> Iterator[tuple]:
    for table in (x for x in root.walk() if x.name == "table"):
        cells = [x for x in table.walk() if x.name in ("th", "td")]
        rows = [x for x in table.walk() if x.name == "tr"]
        if first_row_headers and rows:
            cells = [x for x in rows[0].walk() if x.name in ("th", "td")]
        names = [x.text() or f"feature_{i}" for i, x in enumerate(cells if first_row_headers else cells[:HEADERS])]
        for row in rows[1:]:
            found = [x.text() for x in row.walk() if x.name == "td"]
            if found and len(found) <= len(names):
                yield (dict(zip(names, found)),)


EXTRACTORS: dict[str, tuple[Callable, str]] = {
    "text": (paragraphs, "text string"),
    "image_cnn": (images, "image_url string, caption string"),
    "audio": (audio, "audio_url string, context_transcript string"),
    "header_edges": (header_edges, "source_node string, target_node string, relationship_type string"),
    "network": (table_rows, "row map<string,string>"),
}
EXTRACTORS["graph_gnn"] = EXTRACTORS["text"]
#: Pages whose rows are held at once.
PAGES = 50


def found_in(made: Callable, html: str | None, url: str | None) -> list[tuple]:
    """The items of a page; none where it cannot be read. Its tree is taken apart, as a node and its parent keep each other."""
    root = None
    try:
        root = parse(html or "")
        return list(made(root, url or ""))
    except (ValueError, RecursionError):
        return []
    finally:
        for node in list(root.walk()) if root else ():
            node.parent = None


def rows_of(made: Callable, columns: list[tuple[str, pa.DataType]]) -> Callable:
    """The function of a task: Arrow batches of pages to batches of their items, from PAGES pages each."""
    schema = pa.schema([("source_url", pa.string()), ("item_idx", pa.int32()), *columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                pages = zip(part.column("url").to_pylist(), part.column("html").to_pylist())
                out = [(url, i, *item) for url, html in pages for i, item in enumerate(found_in(made, html, url))]
                values = zip(*out) if out else [()] * len(schema)
                plain = [[list(x.items()) if isinstance(x, dict) else x for x in v] for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(plain, schema)], schema=schema)

    return rows


def extract(pages: DataFrame, modality: str = "text") -> DataFrame:
    """(source_url, item_idx, …) of pages (url, html). A page that cannot be read, or holds no item, gives no row."""
    made, columns = EXTRACTORS[modality]
    typed = [(name, pa.map_(pa.string(), pa.string()) if kind.startswith("map") else pa.string()) for name, kind in (c.split() for c in columns.split(", "))]
    return pages.select("url", "html").mapInArrow(rows_of(made, typed), f"source_url string, item_idx int, {columns}")
