"""Main text of web pages by composite text density.

For every node of a page's tree: C characters and T tags under it, LC and LT of them in links. Its density is
``C / T * log(C * T / (LC * LT))`` with the base ``ln(C / (C - LC) * LC + LCb / Cb * C + e)`` (b: the body), so text
with few tags and few links is dense. The node whose children's densities have the largest sum holds the article.
The smallest density on its path to the body is the threshold for what stands beside that path: a neighbour as dense
belongs to the article as well. Elements that are never text of the article (scripts, forms, navigation, and blocks
whose class says nothing else than advert, sidebar, comments and the like) count for nothing. A class that says notice,
header, related and the like is a hint only: such a block goes if it stands outside the page's article element or
beside the chosen subtree, or is less dense than half the threshold. Words in a longer name, as in ``social-history``, say nothing.

Pages are independent: one pass in Arrow batches, no shuffle, each page read whole. Parsing takes time in proportion to
the page, however broken it is: open elements are found by name, and a quote that never closes is no quote.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r""">|=\s*(["'])""")  # a quote counts where a value begins
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
THIN = 0.5  # of the threshold: a block of the article is less dense than the whole, which has more tags to share
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

# The elements of HTML by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = set("head script style noscript template iframe object svg math nav footer aside form button select textarea dialog menu audio video canvas map".split())
# Words in class, id or role: of blocks that are never the article, and of blocks that mostly aren't.
CERTAIN = set(
    "ad ads advert advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription comment comments disqus replies respond pagination pager toolbar".split()
)
HINT = set("banner header notice notices notification alert dialog signup login share sharing social related recommended widget reply search copyright".split())
# Words that say where or how a block stands.
LAYOUT = set("site page main top bottom left right inner outer list item items area section box block container wrapper wrap bar slot unit body form link links thread group panel has is the".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}, "optgroup": {"select"}, "body": set()}


class Page:
    """The tree of one page: names, parents, marks and text pieces in document order."""

    def __init__(self, source: str):
        self.name, self.parent, self.mark = ["#root"], [-1], [0]  # mark: 2 never the article, 1 a hint
        self.pieces: list[tuple[int, str]] = []  # (node, text); a node's own start and end are pieces "" in order
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # places of open elements on the stack, by name
        self.blocks: list[int] = []  # of those that are not inline
        self.quoted = {q: source.rfind(q) for q in "\"'"}  # no quote closes behind its last one
        self.plain = False
        last, at, size = source.rfind(">"), 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                break
            self.text(source[at:start])
            closing = source.startswith("/", start + 1)
            named = NAMED.match(source, start + 1 + closing)
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            elif named is None:
                if start < last and source[start + 1 : start + 2] in ("!", "?", "/"):
                    at = source.index(">", start) + 1
                else:
                    self.text("<")
                    at = start + 1
            else:
                tag, end = named.group().lower(), self.tag_end(source, named.end())
                attributes, at = source[named.end() : end], min(end + 1, size)
                if closing:
                    self.close(tag)
                    continue
                self.open(tag, attributes)
                if tag in RAW:
                    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    if tag not in NEVER and tag != "title":
                        self.text(source[at : found.start() if found else size])
                    end = source.find(">", found.end()) if found else -1
                    at = end + 1 if end >= 0 else size
                    self.close(tag)
        else:
            return
        self.text(source[at:])

    def tag_end(self, source: str, at: int) -> int:
        """Place of the ">" that ends a tag. Where values in quotes reach to the end of the page, none are meant."""
        begin = at
        while not self.plain:
            m = STOP.search(source, at)
            if m is None:
                self.plain = True
            elif m.group(1) is None:
                return m.start()
            elif m.end() <= self.quoted[m.group(1)]:
                at = source.index(m.group(1), m.end()) + 1
            else:
                at = m.end()
        end = source.find(">", begin)
        return end if end >= 0 else len(source)

    def text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.shut({"p"}, {"button", "table", "td", "th", "li"})
        if tag in SAME:
            self.shut(SAME[tag], WALLS[tag])
        node = len(self.name)
        self.name.append(tag)
        self.parent.append(self.stack[-1])
        self.mark.append(2 if tag in NEVER else 0 if tag in ("html", "body", "main", "article") else self.marked(attributes))
        self.pieces.append((node, ""))
        if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P):
            self.places.setdefault(tag, []).append(len(self.stack))
            if tag not in INLINE:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def marked(self, attributes: str) -> int:
        mark = 0
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return 2
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return 2
                continue
            for token in value.split():
                words = {w.lower() for w in NAME.findall(token)}
                if words and words <= CERTAIN | HINT | LAYOUT:
                    mark = max(mark, 2 if words & CERTAIN else 1 if words & HINT else 0)
        return mark

    def place(self, names: set[str]) -> int:
        """The highest place on the stack of an open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def shut(self, names: set[str], walls: set[str]) -> None:
        """Close the open element of each of these names, if none of the walls is nearer."""
        wall, names = self.place(walls), set(names)
        while (k := self.place(names)) > wall:
            names.discard(self.name[self.stack[k]])
            self.drop(k)

    def drop(self, k: int) -> None:
        """Close the element at place ``k`` and all in it."""
        for node in reversed(self.stack[k:]):
            self.pieces.append((node, ""))
            self.places[self.name[node]].pop()
            if self.name[node] not in INLINE:
                self.blocks.pop()
        del self.stack[k:]

    def close(self, tag: str) -> None:
        """An end tag: nothing if no such element is open, or if an inline one would end a block."""
        k = self.place({tag})
        if k and not (tag in INLINE and self.blocks and self.blocks[-1] > k):
            self.drop(k)

    def statistics(self, out: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, characters in links and links under every node, without those that are out."""
        n, name, parent = len(self.name), self.name, self.parent
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or name[i] == "a"
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if text and not out[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                links[node] += size if in_link[node] else 0
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if not out[i]:
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (name[i] == "a")
        return chars, tags, links, link_tags

    def main_text(self) -> str:
        n = len(self.name)
        name, parent = self.name, self.parent
        # A block that holds an article, main or h1 is no block beside the article, whatever its class says.
        holds = [False] * n
        told = "article" in name or "main" in name
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i] or name[i] in ("article", "main", "h1")
        out = [False] * n
        in_article = [False] * n
        for i in range(1, n):
            p = parent[i]
            in_article[i] = in_article[p] or name[i] in ("article", "main")
            side = self.mark[i] == 2 and (name[i] in NEVER or not holds[i])
            side |= name[i] == "header" and not in_article[p]
            side |= self.mark[i] == 1 and told and not holds[i] and not in_article[p]
            out[i] = out[p] or side
        chars, tags, links, link_tags = self.statistics(out)
        body = next((i for i in range(n) if name[i] == "body"), 0)
        if not chars[body]:
            body = 0
        if not chars[body]:
            return ""
        ratio = links[body] / chars[body]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not out[i]:
                density[i] = composite_density(chars[i], tags[i], links[i], link_tags[i], ratio)
                if i and name[i] not in INLINE:  # inline parts are text of their block
                    total[parent[i]] += density[i]
        best = max((i for i in range(n) if not out[i] and chars[i]), key=lambda i: (total[i], -i))
        if total[best] == 0:
            best = body
        # A single leaf block is its own best; the block itself counts, not one of its inline parts.
        while best and name[best] in INLINE:
            best = parent[best]
        path, i = [], best
        while i > 0 and i != body:
            path.append(i)
            i = parent[i]
        threshold = min((density[i] for i in path), default=0.0)
        chosen = [False] * n
        on_path = set(path) | {body, 0}
        for i in range(1, n):
            p = parent[i]
            beside = p in on_path and p != 0 and i not in on_path and path and threshold > 0 and density[i] >= threshold and name[i] not in INLINE
            chosen[i] = i == best or chosen[p] or (beside and not self.mark[i])
        if best in (0, body):
            chosen = [True] * n
            threshold = density[best]
        # Hints: what the class marks goes, with all in it, where it is much less dense than the article's path.
        for i in range(1, n):
            hinted = self.mark[i] == 1 and not holds[i] and i not in on_path
            out[i] = out[i] or out[parent[i]] or (hinted and (density[i] < THIN * threshold or not chosen[i]))
        parts: list[str] = []
        for node, text in self.pieces:
            if not chosen[node] or out[node]:
                continue
            if text:
                parts.append(text)
            elif name[node] not in INLINE:
                parts.append(" ")
        return " ".join("".join(parts).split())


def composite_density(chars: int, tags: int, links: int, link_tags: int, ratio: float) -> float:
    """Density of a node from its characters, tags, characters in links and links; ``ratio`` is that of the body."""
    t, lc, lt = max(1, tags), max(1, links), max(1, link_tags)
    base = math.log(chars / max(1, chars - links) * links + ratio * chars + math.e)
    return chars / t * math.log(max(1.0, chars * t / (lc * lt))) / base


def main_text(source: str | None) -> str:
    """The article's text: blocks in page order, white space as one space. Empty for null, empty or textless pages."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text. Ids and urls may be null and rows may repeat; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
