"""Main text of web pages: a tree of blocks, from which frames are removed by their share of the page's text and of link text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset({"script", "style", "noscript", "template", "svg"})
FRAMES = frozenset({"nav", "header", "footer", "aside"})
LINES = frozenset({"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "main", "ul", "ol", "table", "form", "title"} | FRAMES)
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Names of frames in class, id and role; such a block also needs LINKS of its text in links.
NAMES = re.compile(r"(?i)\b(?:nav(?:bar|igation)?|menu|breadcrumbs?|footer|header|sidebar|cookies?|share|social|search|banner|toolbar)\b")
#: A block with this share of the page's text, or more, is content whatever it is.
SHARE = 0.5
LINKS = 0.5


class Blocks(HTMLParser):
    """The blocks of a page in order, each with its parent, and the pieces of text with their blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.framed, self.named = [-1], [""], [False], [False]
        self.open = [0]
        self.pieces: list[tuple[int, bool, str]] = []  # block, within a link, text
        self.skipped = self.links = 0
        self.og, self.titles = "", {"h1": [], "title": []}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            given = dict(attrs)
            if given.get("property") == "og:title" and not self.og:
                self.og = given.get("content") or ""
        if tag in LINES:
            self.pieces.append((self.open[-1], False, "\n"))
        if tag in VOID:
            return
        self.skipped += tag in SKIPPED
        self.links += tag == "a"
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.framed.append(tag in FRAMES)
        self.named.append(tag not in FRAMES and tag not in ("html", "body", "a") and bool(NAMES.search(names.replace("_", "-"))))
        self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or all(self.tag[b] != tag for b in self.open):
            return
        while self.tag[self.open[-1]] != tag:
            self._close()
        self._close()
        if tag in LINES:
            self.pieces.append((self.open[-1], False, "\n"))

    def _close(self) -> None:
        tag = self.tag[self.open.pop()]
        self.skipped -= tag in SKIPPED
        self.links -= tag == "a"

    def handle_data(self, data: str) -> None:
        for name, said in self.titles.items():
            if any(self.tag[b] == name for b in self.open):
                said.append(data)
        if not self.skipped and all(self.tag[b] != "title" for b in self.open[-2:]):
            self.pieces.append((self.open[-1], self.links > 0, data))


def _plain(text: str) -> str:
    return " ".join(text.split())


def main_text(source: str | None) -> tuple[str, str]:
    """(title, text) of a page.

    The title is og:title, else the first h1's, else title's. A frame by its tag goes if it holds under SHARE of the page's text, a frame by its name if it also has LINKS
    of its text in links; what is in doubt stays. Where that leaves nothing, the block with most text outside of links that was to go stays.
    """
    page = Blocks()
    page.feed(source or "")
    page.close()
    n = len(page.tag)
    chars, linked = [0] * n, [0] * n
    for block, in_link, text in page.pieces:
        size = len("".join(text.split()))
        chars[block] += size
        linked[block] += size * in_link
    for b in range(n - 1, 0, -1):  # from the leaves up: a block comes after its parent
        chars[page.parent[b]] += chars[b]
        linked[page.parent[b]] += linked[b]
    whole = chars[0]
    gone = [False] * n
    tops = []
    for b in range(1, n):
        small = chars[b] < SHARE * whole
        drops = small and (page.framed[b] or (page.named[b] and linked[b] >= LINKS * chars[b] > 0))
        gone[b] = gone[page.parent[b]] or drops
        if drops and not gone[page.parent[b]]:
            tops.append(b)
    if whole and not any(text.strip() and not gone[block] for block, _, text in page.pieces):
        kept = max(tops, key=lambda b: (chars[b] - linked[b], chars[b], -b))
        inside = [False] * n
        for b in range(1, n):
            inside[b] = b == kept or inside[page.parent[b]]
            gone[b] = gone[b] and not inside[b]
    lines = (_plain(x) for x in "".join(text for block, _, text in page.pieces if not gone[block]).split("\n"))
    title = next((t for t in (_plain(page.og), _plain("".join(page.titles["h1"])), _plain("".join(page.titles["title"]))) if t), "")
    return title, "\n".join(x for x in lines if x)


def html_to_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text) of pages; a parser for each page, so one Arrow pass. Null and empty pages have empty titles and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(source) for source in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in range(2))], names=["key", "title", "text"])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(run, "key long, title string, text string").withColumnRenamed("key", key)
