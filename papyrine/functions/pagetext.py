"""Abstracts from saved web pages.

Web pages are rarely well-formed, so the tree is built by the standard library's forgiving parser inside Arrow
batches; Spark spreads the pages over tasks. ``page_paragraphs`` is the expression-only form.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyrine.functions.text import squeeze

MIN_LENGTH = 50  # an abstract must be longer than this
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = {"script", "style", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4"}


class _Comment(str):
    """A comment: found by searches for a string, but no part of any text."""


class _Node:
    __slots__ = ("name", "classes", "parent", "children")

    def __init__(self, name: str, classes: str, parent: _Node | None):
        self.name, self.classes, self.parent = name, classes, parent
        self.children: list[_Node | str] = []

    def places(self) -> Iterator[tuple[_Node, str]]:
        """(element, string) of every string and comment below this node, in document order."""
        stack = [(self, iter(self.children))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield node, child
            else:
                stack.append((child, iter(child.children)))

    def walk(self) -> Iterator[_Node | str]:
        """Everything below this node in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            yield child
            if isinstance(child, _Node):
                stack.append(iter(child.children))

    def named(self, name: str) -> Iterator[_Node]:
        return (n for n in self.walk() if isinstance(n, _Node) and n.name == name)

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                if not isinstance(child, _Comment):
                    yield child
            elif child.name not in _SILENT:
                stack.append(iter(child.children))

    def text(self) -> str:
        """The trimmed strings below this node, without scripts, put together without blanks."""
        return "".join(s.strip() for s in self.strings())


class _Tree(HTMLParser):
    """Tree in which an end tag closes the nearest open element of its name and stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", "", None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs).get("class") or "", self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(_Node(tag, dict(attrs).get("class") or "", self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)

    def handle_comment(self, data):
        self.open.children.append(_Comment(data))


def _paragraph_text(node: _Node) -> str | None:
    """Non-blank paragraphs joined by a blank; None when the node has no paragraph at all."""
    paragraphs = [p.text() for p in node.named("p")]
    return " ".join(p for p in paragraphs if p) if paragraphs else None


def _from_class(root: _Node) -> str | None:
    box = next((d for d in root.named("div") if "abstract-text" in d.classes.split()), None)
    if box is None:
        return None
    paragraphs = _paragraph_text(box)
    return box.text() if paragraphs is None else paragraphs


def _from_heading(root: _Node) -> str | None:
    for head in root.named("h3"):
        if "abstract" in "".join(head.strings()).lower():
            paragraphs = _paragraph_text(head.parent)
            if paragraphs is not None:
                return paragraphs
    return None


def _from_class_part(root: _Node) -> str | None:
    box = next((d for d in root.named("div") if "abstract" in " ".join(d.classes.split()).lower()), None)
    return None if box is None else box.text().replace("Abstract", "").strip()


def _from_siblings(root: _Node) -> str | None:
    """Non-blank paragraphs after an element that holds the word, up to the next heading; the first string in document
    order that leads to a paragraph counts, comments included."""
    for node, string in root.places():
        if node.parent is None or "Abstract" not in string:
            continue
        found, after = [], False
        for sibling in node.parent.children:
            if sibling is node:
                after = True
            elif after and isinstance(sibling, _Node):
                if sibling.name in _HEADINGS:
                    break
                if sibling.name == "p":
                    found.append(sibling.text())
        if found:
            return " ".join(t for t in found if t)
    return None


def extract_abstract(page: str | None) -> str | None:
    """Abstract of one page: first way that yields more than 50 characters, leading 'Abstract' removed."""
    if not page:
        return None
    tree = _Tree()
    tree.feed(page)
    tree.close()
    for way in (_from_class, _from_heading, _from_class_part, _from_siblings):
        text = (way(tree.root) or "").strip()
        if len(text) > MIN_LENGTH:
            return text.removeprefix("Abstract").strip()
    return None


@F.pandas_udf(StringType())
def _extract(pages: pd.Series) -> pd.Series:
    return pages.map(extract_abstract, na_action="ignore")


def with_abstract(pages: DataFrame, html: str = "html", out: str = "abstract") -> DataFrame:
    """Add the extracted abstract. Pages that never name an abstract skip the parser."""
    marked = F.when(F.contains(F.lower(F.col(html)), F.lit("abstract")), F.col(html))
    return pages.withColumn(out, _extract(marked))


def page_paragraphs(html: Column) -> Column:
    """Text of all closed paragraphs by pattern alone: tags removed, white space collapsed, joined by a blank."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    texts = F.transform(blocks, lambda b: squeeze(F.regexp_replace(b, "<[^>]*>", " ")))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")
